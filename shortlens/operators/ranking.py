"""Windows, sorts, limits and positions that hold up when one group has most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlens.runtime import HOT_ROWS, as_list, largest_group, settle


def with_position(df: DataFrame, keys, order, into: str = "position", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number the rows of each group from 1 in a total order.

    While the biggest group is within `hot_rows`, a plain window does it. Beyond that the table is range-partitioned by
    (keys, order), each slice numbers its own rows, and slices add the row counts of the slices before them, so a hot
    group is spread over many tasks.
    """
    keys, order = as_list(keys), as_list(order)
    if largest_group(df, keys) <= hot_rows:
        return df.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    numbered = settle(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    slices = numbered.groupBy(*keys, "_slice").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_k_slice"),
        "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
    )
    match = F.col("_slice") == F.col("_k_slice")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    position = F.col("_row") - F.col("_first") + F.col("_before") + 1
    return numbered.join(offsets, match).select(*df.columns, position.cast("bigint").alias(into))


def top_words(df: DataFrame, cluster: str, word: str, n: int, start: int = 0, weight: str | None = None) -> DataFrame:
    """(cluster, word, count, rank): the most frequent words of each cluster, ties in word order.

    Counting combines before the shuffle and the rank limit is applied before the sort of a whole cluster. `weight` names
    a column of counts already made.
    """
    counts = df.groupBy(cluster, word).agg((F.sum(weight) if weight else F.count("*")).alias("count"))
    ranked = Window.partitionBy(cluster).orderBy(F.desc("count"), F.asc(word))
    ranked = counts.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= start + n)
    return ranked.filter(F.col("rank") > start)


def with_occurrences(df: DataFrame, column: str, into: str = "occurrences") -> DataFrame:
    """How often the row's value occurs. Counted first, then joined, so a frequent value never gathers in one task."""
    counts = df.groupBy(F.col(column).alias("_value")).agg(F.count("*").alias(into))
    return df.join(counts, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")


def index_distinct(df: DataFrame, category: str, column: str, into: str = "index", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number the distinct values of each category from 0 in value order."""
    values = df.select(category, column).distinct()
    return with_position(values, category, column, into, hot_rows).withColumn(into, F.col(into) - 1)


def top_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.groupBy(column).count().orderBy(F.desc("count"), F.asc(column)).limit(n)


def head(df: DataFrame, n: int, order_by) -> DataFrame:
    return df.orderBy(*as_list(order_by)).limit(n)


def sample_n(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """A repeatable sample of n rows: the first n by a seeded hash of the key."""
    dice = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(dice, key).limit(n)


def first_n(array: Column, n: int, start: int = 0) -> Column:
    return F.slice(array, start + 1, n)


def round_robin(df: DataFrame, key, index: str) -> DataFrame:
    """Every company's item 0, then every company's item 1, and so on."""
    return df.orderBy(index, *as_list(key))
