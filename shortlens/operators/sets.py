"""Set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlens.operators.filters import UNLABELLED


def supplement(df: DataFrame, missing: DataFrame, key: str, words: str, default: str = UNLABELLED) -> DataFrame:
    """Give clusters without words the default word, as an array like the others.

    Further columns of `df` (the chunk of a nested table) stay; a new row has 0 in `chunk` and null in the rest.
    """
    new = missing.select(key, F.array(F.lit(default)).alias(words))
    if "chunk" in df.columns:
        new = new.withColumn("chunk", F.lit(0).cast(df.schema["chunk"].dataType))
    return df.unionByName(new, allowMissingColumns=True)


def symmetrize(pairs: DataFrame, left: str = "id1", right: str = "id2") -> DataFrame:
    """Every edge in both directions."""
    other = {left: right, right: left}
    return pairs.unionByName(pairs.select(*[F.col(other.get(c, c)).alias(c) for c in pairs.columns]))


def flatten_lists(column) -> Column:
    return F.flatten(column)


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct() if columns else df.distinct()
