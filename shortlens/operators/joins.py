"""Joins. The optimizer picks the strategy; skewed keys are split by adaptive execution at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlens.runtime import as_list


def join(df: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    return df.join(other, on, how)


def join_on_vector(df: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Match on the whole vector value. Prefer an id; this serves tables that carry none.

    Repeated rows of `other` count once, so equal vectors on both sides do not multiply.
    """
    return df.join(other.distinct(), column, "inner")


def attach(df: DataFrame, labels: DataFrame, key) -> DataFrame:
    """Add label columns, keeping every row."""
    return df.join(labels, as_list(key), "left")


def attach_centroid(df: DataFrame, centroids: DataFrame, keys=("cluster", "category")) -> DataFrame:
    return df.join(centroids, list(keys), "left")


def merge_outer(a: DataFrame, b: DataFrame, key) -> DataFrame:
    return a.join(b, as_list(key), "outer")


def not_in(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Rows of `a` whose key is absent from `b`; repeated rows of `a` stay repeated."""
    return a.join(b.select(*as_list(key)), as_list(key), "left_anti")


def missing_ids(df: DataFrame, column: str) -> DataFrame:
    """Ids between the smallest and the largest that no row has. Two numbers come back; the range itself is distributed."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    every = df.sparkSession.range(lo or 0, -1 if hi is None else hi + 1)
    every = every.select(F.col("id").cast(df.schema[column].dataType).alias(column))
    return every.join(df.select(column).distinct(), column, "left_anti")


def enrich_by_position(parsed: DataFrame, raw: DataFrame, key, position) -> tuple[DataFrame, DataFrame]:
    """(enriched, misses): add the raw fields stored under the same key and index; list parsed rows without a raw one."""
    keys = [*as_list(key), *as_list(position)]
    return parsed.join(raw, keys, "left"), parsed.join(raw.select(*keys), keys, "left_anti")


def lookup_first(df: DataFrame, meta: DataFrame, key: str, order: str) -> DataFrame:
    """Add the first matching metadata row per key. Reducing to one row happens before the shuffle."""
    fields = [c for c in meta.columns if c not in (key, order)]
    first = meta.groupBy(key).agg(F.min_by(F.struct(*fields), order).alias("hit"))
    return df.join(first, key, "left").select(*df.columns, *[F.col("hit").getField(c).alias(c) for c in fields])


def upsert(base: DataFrame, newer: DataFrame, key) -> DataFrame:
    """One row per key, the newer attempt winning."""
    keys = as_list(key)
    fields = [c for c in base.columns if c not in keys]
    both = base.withColumn("_attempt", F.lit(0)).unionByName(newer.withColumn("_attempt", F.lit(1)))
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*fields), "_attempt").alias("_row"))
    return latest.select(*keys, *[F.col("_row").getField(c).alias(c) for c in fields])


def lookup(df: DataFrame, table: DataFrame, key) -> DataFrame:
    """Values from a small table, null where the key is unknown."""
    return df.join(table, as_list(key), "left")
