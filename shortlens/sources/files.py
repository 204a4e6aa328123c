"""Tables in and out of files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlens.runtime import as_list, small_table

# Quotes inside a quoted cell are doubled, cells may span lines, and no cell is cut at a length limit. A bare empty cell is
# null; the mark that stands for it while reading cannot occur in text, so a quoted empty cell stays empty text.
PAYLOAD_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "lineSep": "\n",
    "multiLine": True,
    "maxCharsPerColumn": -1,
    "header": False,
    "nullValue": "\u0000",
}
# A file with multi-line cells is read by one task, so writers keep files short.
PAYLOAD_ROWS_PER_FILE = 100_000


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def save(df: DataFrame, path: str, partition_by=None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*as_list(partition_by))
    writer.parquet(path)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """One address per line, no header."""
    return spark.read.schema("url string").csv(path, header=False)


def read_payload_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows whose cells hold whole documents: quoted, many lines long, of any length.

    A file with multi-line cells cannot be split, so parallelism is by file; `append_csv` writes one file per task.
    """
    return spark.read.schema(schema).options(**PAYLOAD_OPTIONS).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Add rows next to those already there; line breaks and quotes in cells survive a read with `read_payload_csv`.

    Null is written bare and the empty text quoted, so the two stay apart.
    """
    bounded = df.write.mode("append").option("maxRecordsPerFile", PAYLOAD_ROWS_PER_FILE)
    bounded.options(quote='"', escape='"', emptyValue='""', nullValue="", header=False).csv(path)


def write_answers(df: DataFrame, path: str, append: bool = False) -> None:
    """Answers with a header line in each part, read back with header=True; appending repeats no header inside a part."""
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def from_rows(spark: SparkSession, rows: Sequence, schema) -> DataFrame:
    """Driver rows with a declared schema; nothing is inferred."""
    return small_table(spark, rows, schema)


def to_json_col(column) -> Column:
    return F.to_json(column)


def from_json_col(column, schema) -> Column:
    return F.from_json(column, schema)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by=None) -> DataFrame:
    """Read the stored table when it is whole, else compute and store it first. One folder per category.

    Only a folder with the writer's success mark counts as whole. Folders are named by copies of the category columns, so
    that the columns themselves keep their values, types and places.
    """
    folders = {f"_folder_{c}": c for c in as_list(partition_by or [])}
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        save(build().withColumns({name: F.col(c) for name, c in folders.items()}), path, list(folders))
    return spark.read.parquet(path).drop(*folders)


def preview(df: DataFrame, n: int, order_by) -> DataFrame:
    """The first n rows in a stated order; a top-n per task, never a full collect."""
    return df.orderBy(*as_list(order_by)).limit(n)
