"""Row filters and column shaping. Everything stays a Catalyst expression, so filters reach the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shortlens.runtime import as_list, small_table

OLDEST_DATE = "1800-01-01"
UNLABELLED = "Unlabelled"


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where none of the columns is null."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def where(df: DataFrame, predicate: str) -> DataFrame:
    return df.filter(predicate)


def exclude_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Drop rows holding one of the values. Null compares as unknown, so null rows go as well."""
    return df.filter(~F.col(column).isin(list(values)))


def map_values(
    df: DataFrame, column: str, mapping: Mapping[str, str], into: str, unknown: str = "error", default: str | None = None
) -> DataFrame:
    """Roll a category up through a table. A key missing from it fails the job, becomes null, or takes the default."""
    table = small_table(df.sparkSession, list(mapping.items()), f"`{column}` string, `{into}` string")
    joined = df.join(table, column, "left")
    miss = F.col(into).isNull() & F.col(column).isNotNull()
    if unknown == "error":
        problem = F.raise_error(F.concat(F.lit("no group for "), F.col(column))).cast("string")
        return joined.withColumn(into, F.when(miss, problem).otherwise(F.col(into)))
    if unknown == "default":
        return joined.withColumn(into, F.when(miss, F.lit(default)).otherwise(F.col(into)))
    return joined


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def rename_fields(struct: Column, mapping: Mapping[str, str]) -> Column:
    """A struct rebuilt with new field names, in the order of the table."""
    return F.struct(*[struct.getField(old).alias(new) for old, new in mapping.items()])


def tag(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def row_key(*columns: str) -> Column:
    return F.concat_ws("_", *columns)


def contains_col(whole: Column, part: Column) -> Column:
    return F.contains(whole, part)


def fresh(df: DataFrame, date_col: str, limit: str = OLDEST_DATE) -> DataFrame:
    """Rows dated on or after the limit; an undated row counts as oldest. A typed date compares as stored, so scans skip."""
    kind = df.schema[date_col].dataType
    text = isinstance(kind, T.StringType)
    value = F.try_to_date(F.col(date_col), "yyyy-MM-dd") if text else F.col(date_col)
    bound = F.lit(limit).cast("date" if text else kind)
    recent = value >= bound
    return df.filter(recent | value.isNull() if limit <= OLDEST_DATE else recent)


def page_status(html: Column, wall: str, button: str) -> tuple[Column, Column]:
    """(status, error_code): a sign-in wall is error 0, otherwise the button decides. Patterns are regular expressions."""
    walled = html.rlike(wall)
    status = F.when(walled, F.lit(None)).when(html.rlike(button), F.lit("Jobs found!")).otherwise(F.lit("No jobs"))
    return F.when(html.isNotNull(), status), F.when(walled, F.lit(0))


def status_to_bool(column: Column, yes: str = "Jobs found!", no: str = "No jobs") -> Column:
    return F.when(column == yes, F.lit(True)).when(column == no, F.lit(False))


def denoise(df: DataFrame, min_soft: float = 0.004, min_prob: float = 0.2) -> DataFrame:
    """Settle confidences after new points were assigned.

    `soft_prob_initial` is the value before assignment and stays as the soft one. Where it was 0, the assigned confidence
    becomes the probability. A point is noise when its initial value is above 0 but weak, or its probability is weak.
    """
    initial = F.col("soft_prob_initial")
    probability = F.when(initial == 0, F.col("soft_probability")).otherwise(F.col("probability"))
    weak = (initial > 0) & (initial < min_soft) | (probability < min_prob)
    settled = {
        "probability": probability,
        "soft_probability": initial,
        "soft_cluster": F.when(weak, F.lit(-1)).otherwise(F.col("soft_cluster")),
    }
    return df.withColumns(settled).drop("soft_prob_initial")


def overlay(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def gate_labels(df: DataFrame, layers: Sequence[str], prob: str, min_prob: float, keep_last: int = 2) -> DataFrame:
    """Hide the label of unsure points on every layer but the last ones."""
    gated = list(layers)[: max(len(layers) - keep_last, 0)]
    sure = F.col(prob) >= min_prob
    return df.withColumns({c: F.when(sure, F.col(c)).otherwise(F.lit(UNLABELLED)) for c in gated})


def min_length(column: Column, n: int) -> Column:
    return F.length(column) >= n


def short_and_repeated(df: DataFrame, value: str, count: str, max_len: int = 50, min_count: int = 2) -> DataFrame:
    return df.filter((F.length(value) <= max_len) & (F.col(count) >= min_count))


def only_clusters(df: DataFrame, ids: Sequence[int] | None = None, noise: bool = False, column: str = "cluster") -> DataFrame:
    kept = df if noise else df.filter(F.col(column) != -1)
    return kept if ids is None else kept.filter(F.col(column).isin(list(ids)))


def after_cursor(df: DataFrame, index: str, number: str, at_index: int, at_number: int) -> DataFrame:
    """Rows still to do when work goes round by index, then by company number."""
    later = F.col(index) > at_index
    same_round = (F.col(index) == at_index) & (F.col(number) >= at_number)
    return df.filter(later | same_round)


def retryable(df: DataFrame, reason: str, settled: Sequence[str]) -> DataFrame:
    """Failures worth another try: those whose reason is not settled."""
    return exclude_values(df, reason, settled)


def only_categories(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(as_list(names)))


def null_count(df: DataFrame, column: str, into: str = "nulls") -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias(into))
