"""Append and resume: work through newly arrived files once each, and go on after a stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shortlens.sources.files import PAYLOAD_OPTIONS


def append_new(
    spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, progress: str
) -> None:
    """Run `transform` over the files of `source` that earlier calls have not seen and append the rows to `target`.

    `progress` is the folder that remembers what is done, so a restart repeats and loses nothing. Returns when all present
    files are done.
    """
    arrived = spark.readStream.schema(schema).options(**PAYLOAD_OPTIONS).csv(source)
    writer = transform(arrived).writeStream.format("parquet").option("checkpointLocation", progress)
    writer.trigger(availableNow=True).start(target).awaitTermination()
