"""Which companies are worth collecting, and which of them hire."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlens.functions.fixed_values import INDUSTRY_GROUPS, SMALL_COMPANY_SIZES
from shortlens.operators.aggregates import hiring_rate
from shortlens.operators.filters import exclude_values, map_values, require, status_to_bool
from shortlens.operators.joins import upsert


def target_companies(
    companies: DataFrame,
    group: str = "Technology",
    groups: Mapping[str, str] = INDUSTRY_GROUPS,
    small: Sequence[str] = SMALL_COMPANY_SIZES,
    unknown: str = "error",
) -> DataFrame:
    """Companies of one industry group that say what they do and are not small. Rows without industry or size go."""
    known = require(exclude_values(companies, "company_size", list(small)), "industries", "about")
    grouped = map_values(known, "industries", groups, "meta_industry", unknown)
    return grouped.filter(F.col("meta_industry") == group).drop("meta_industry").select(*companies.columns)


def hiring_answers(first: DataFrame, second: DataFrame) -> DataFrame:
    """(url, hiring): the second attempt wins; an error is unknown."""
    return upsert(first, second, "url").select("url", status_to_bool(F.col("status")).alias("hiring"))


def hiring_by(companies: DataFrame, answers: DataFrame, jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How likely companies of each kind hire, and how many posts they have. `jobs` has one row per post with its url."""
    counts = jobs.groupBy("url").agg(F.count("*").alias("jobs"))
    return hiring_rate(companies.join(answers, "url", "left").join(counts, "url", "left"), list(keys))
