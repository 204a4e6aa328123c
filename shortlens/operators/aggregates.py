"""Group statistics. Every count combines on the map side; lists of hot groups come in bounded chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlens.operators.ranking import with_position
from shortlens.runtime import as_list, settle

# A nested row holds at most this many items; the next ones are the key's next row, numbered by `chunk`.
CHUNK_ROWS = 10_000


def row_count(df: DataFrame, into: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(into))


def share(df: DataFrame, predicate: Column, into: str = "share") -> DataFrame:
    """Part of all rows that meet the predicate (unknown counts as not), and the same in percent to two digits."""
    part = F.count_if(predicate) / F.nullif(F.count("*"), F.lit(0))
    return df.agg(part.alias(into)).withColumn("percent", F.round(F.round(F.col(into), 4) * 100, 2))


def group_count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def _spread(size: Column) -> dict[str, Column]:
    """Total, mean, median and sample variance of list sizes. The median keeps one counter per distinct size."""
    return {
        "total": F.sum(size),
        "mean": F.avg(size),
        "median": F.percentile(size, 0.5),
        "variance": F.var_samp(size),
    }


def list_stats(sizes: DataFrame, size: str, by=None) -> DataFrame:
    """Keys, total, mean, median and sample variance of list sizes, optionally per group. One member: variance null."""
    spread = [c.alias(name) for name, c in _spread(F.col(size)).items()]
    return sizes.groupBy(*(as_list(by) if by else [])).agg(F.count("*").alias("keys"), *spread)


def size_stats(df: DataFrame, key) -> DataFrame:
    """`list_stats` of the number of rows per key."""
    return list_stats(df.groupBy(*as_list(key)).agg(F.count("*").alias("_size")), "_size")


def extent(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("lowest"), F.max(column).alias("highest"))


def chunk_size(chunk_rows: int | None = None) -> int:
    return chunk_rows or CHUNK_ROWS


def nest(df: DataFrame, key, order, columns: Sequence[str], into: str = "items", chunk_rows: int | None = None) -> DataFrame:
    """(key…, chunk, items): the rows of each key as ordered lists of structs.

    `chunk` is part of the result's key at every group size: chunk c holds the rows at the places c * `chunk_rows` and
    following, so a row's place in its group is chunk * chunk_rows + its place in the list, and sizes add up over chunks.
    Nothing is dropped. The input is computed once; a hot key is numbered over many tasks.
    """
    keys, order = as_list(key), as_list(order)
    rows = settle(df.select(*dict.fromkeys([*keys, *order, *columns])))
    numbered = with_position(rows, keys, order, "_position")
    numbered = numbered.withColumn("chunk", F.floor((F.col("_position") - 1) / chunk_size(chunk_rows)))
    item = F.struct(*[F.col(c) for c in columns]).alias("_item")
    grouped = numbered.groupBy(*keys, "chunk").agg(F.collect_list(F.struct("_position", item)).alias("_rows"))
    if any("map<" in df.schema[c].dataType.simpleString() for c in columns):
        # Maps have no order, so only the positions are compared, with the place of their row.
        sorted_places = F.sort_array(F.transform("_rows", lambda r, i: F.struct(r["_position"], i.alias("_at"))))
        items = F.transform(sorted_places, lambda p: F.get(F.col("_rows"), p["_at"])["_item"])
    else:
        items = F.transform(F.sort_array("_rows"), lambda r: r["_item"])
    return grouped.select(*keys, "chunk", items.alias(into))


def list_sizes(nested: DataFrame, key, column: str, into: str = "n") -> DataFrame:
    """(key…, n): items per key, summed over its chunks."""
    return nested.groupBy(*as_list(key)).agg(F.sum(F.size(column)).cast("bigint").alias(into))


def collect_ordered(df: DataFrame, key, column: str, order, into: str = "items", chunk_rows: int | None = None) -> DataFrame:
    """(key…, chunk, items): `nest` of a single column, as a plain array."""
    nested = nest(df, key, order, [column], into, chunk_rows)
    return nested.withColumn(into, F.transform(into, lambda r: r[column]))


def group_means(df: DataFrame, keys, vector: str, into: str = "centroid") -> DataFrame:
    """(keys…, members, centroid): size and element-wise mean vector per group in one pass; sums combine on the map side.

    Null vectors are left out; a group without any other has a null mean.
    """
    dense = array_to_vector(F.col(vector).cast("array<double>"))
    summary = Summarizer.metrics("count", "mean").summary(dense).alias("_s")
    known = df.filter(F.col(vector).isNotNull()).groupBy(*as_list(keys)).agg(summary)
    return known.select(*as_list(keys), F.col("_s.count").alias("members"), vector_to_array("_s.mean").alias(into))


def centroids(df: DataFrame, keys, vector: str, into: str = "centroid") -> DataFrame:
    """Element-wise mean vector per group."""
    return group_means(df, keys, vector, into).drop("members")


def field_value_counts(df: DataFrame, columns: Sequence[str], normalize=lambda c: c) -> DataFrame:
    """(topic, value, n): how often each value occurs in each topic."""
    pairs = F.array(*[F.struct(F.lit(c).alias("topic"), normalize(F.col(c).cast("string")).alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("topic", "value").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int, by=None) -> DataFrame:
    """(by…, bin, lower, upper, n): equal-width bins over each group's own range, the last one closed, empty ones with 0."""
    by = as_list(by) if by else []
    value = F.col(column).cast("double")
    known = df.filter(value.isNotNull())
    span = known.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_rows"))
    flat = F.col("_hi") == F.col("_lo")
    span = span.filter("_rows > 0").select(
        *by,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    if by:
        ranged = known.join(span, by)
    else:
        lo, hi = span.first() or (None, None)
        ranged = known.withColumn("_lo", F.lit(lo).cast("double")).withColumn("_hi", F.lit(hi).cast("double"))
    part = F.floor((value - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    counts = ranged.select(*by, F.least(part, F.lit(bins - 1)).cast("int").alias("bin")).groupBy(*by, "bin").agg(
        F.count("*").alias("n")
    )
    frame = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return frame.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("_lo") + width * F.col("bin")).alias("lower"),
        (F.col("_lo") + width * (F.col("bin") + 1)).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def hiring_rate(companies: DataFrame, keys, hiring: str = "hiring", jobs: str = "jobs") -> DataFrame:
    """Per key: companies, known answers, hiring ones, their share, and the spread of job counts. Null answers stay out."""
    posted = F.when(F.col(jobs) > 0, F.col(jobs))
    spread = [c.alias("jobs" if name == "total" else f"jobs_{name}") for name, c in _spread(posted).items()]
    known, yes = F.count(hiring), F.count_if(F.col(hiring))
    answers = [F.count("*").alias("companies"), known.alias("known"), yes.alias("hiring")]
    return companies.groupBy(*as_list(keys)).agg(*answers, F.try_divide(yes, known).alias("rate"), *spread)


def occurrences(column: Column, needle: str) -> Column:
    """How often a literal text occurs, overlaps not counted."""
    return F.try_divide(F.length(column) - F.length(F.replace(column, F.lit(needle), F.lit(""))), F.lit(len(needle))).cast("bigint")


def confident_centers(df: DataFrame, x: str, y: str, prob: str, min_prob: float = 0.99, cluster: str = "cluster") -> DataFrame:
    """Mean position of the sure members of each cluster; null when it has none."""
    sure = F.col(prob) > min_prob
    return df.groupBy(cluster).agg(F.avg(F.when(sure, F.col(x))).alias("x"), F.avg(F.when(sure, F.col(y))).alias("y"))


def cluster_summary(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    c = F.col(cluster)
    return df.agg(
        F.count_distinct(F.when(c != -1, c)).alias("clusters"),
        F.count_if(c != -1).alias("clustered"),
        F.count_if(c == -1).alias("noise"),
    )


def run_totals(df: DataFrame, done: Column, failed: Column) -> DataFrame:
    return df.agg(F.sum(done.cast("bigint")).alias("scraped"), F.sum(failed.cast("bigint")).alias("failed"))


def keys_in_use(df: DataFrame, map_col: str) -> DataFrame:
    return df.select(F.explode(F.map_keys(map_col)).alias("key")).distinct()
