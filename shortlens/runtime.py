"""Session helpers shared by every operator: where to cut lineage, what may be broadcast, when a group is hot."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table built on the driver may be broadcast up to this many rows; larger ones are left to the optimizer.
BROADCAST_ROWS = 100_000
# A group with more rows than this never goes to one task whole.
HOT_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A local session without one gets a fresh folder, since driver and executors share the machine there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="shortlens-")
    context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder nobody else uses. The folder of the application goes when its driver ends."""
    context = spark.sparkContext
    home = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/shortlens-{context.applicationId}")
    files = home.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(home)
    files.deleteOnExit(home)
    return f"{home.toString()}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute `df` once into reliable storage, so a lost executor costs a read and values cannot change between uses.

    Later steps read only the columns they need.
    """
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_dealt(df: DataFrame, key: str, parts: int) -> tuple[DataFrame, Callable[[], None]]:
    """`df` in reliable storage, bucketed by `key`: grouping by it reads the table without a shuffle, as often as it is read.

    The second value drops the table's name once nothing reads it any more; its files are scratch.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "dealt")
    name = f"shortlens_dealt_{uuid.uuid4().hex}"
    # One file for each bucket.
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).saveAsTable(name)
    return spark.table(name), lambda: spark.sql(f"DROP TABLE IF EXISTS {name}")


def small_table(spark: SparkSession, rows: Sequence, schema) -> DataFrame:
    """A table from driver rows; broadcast only while its known length is within the bound."""
    df = spark.createDataFrame(list(rows), schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest group; counts combine before the shuffle."""
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return top or 0


def as_list(value) -> list:
    return [value] if isinstance(value, str) or not isinstance(value, Sequence) else list(value)
