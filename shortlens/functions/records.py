"""Semi-structured replies: find, parse, check against the declared topics, repair."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shortlens.functions.fixed_values import JUNK_PHRASES, TOPICS
from shortlens.functions.text import is_junk
from shortlens.functions.vectors import bound_once
from shortlens.operators.aggregates import chunk_size, nest
from shortlens.runtime import as_list

JOB_TYPE = """struct<
    title_and_summary:string, company_overview:string, responsibilities:array<string>,
    qualifications_and_skills:array<string>, education:string, benefits:array<string>, application:string,
    contact_info:string, title:string, description:string, location:string, post_time:string,
    criterias:map<string,string>, job_url:string, posted:date, benefit_badge:string>"""


def first_object(c: Column, quoted: bool = False) -> Column:
    """The first balanced {…} block. A } before it, or no end, gives null. With `quoted`, braces in quotes do not count."""

    marks = re.compile(r"[{}\\\"']" if quoted else r"[{}]", re.DOTALL)

    def scan(text):
        if text is None:
            return None
        depth, start, quote, past = 0, None, None, 0
        for found in marks.finditer(text):
            at, ch = found.start(), found.group()
            if at < past:
                continue
            if ch == "\\":
                past = at + 2
            elif quote:
                quote = None if ch == quote else quote
            elif ch in "\"'":
                quote = ch if depth else None
            elif ch == "{":
                start = at if depth == 0 else start
                depth += 1
            else:
                depth -= 1
                if depth < 0:
                    return None
                if depth == 0:
                    return text[start : at + 1]
        return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(scan).astype(object)

    return run(c)


def literal_to_json(c: Column) -> Column:
    """A printed Python value, or JSON, as JSON text; null when it is neither. Only literals are read, nothing is executed."""

    def one(text):
        for read in (ast.literal_eval, json.loads):
            try:
                return json.dumps(read(text), ensure_ascii=False, allow_nan=False)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                continue
        return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore").astype(object)

    return run(c)


def parse_literal(c: Column, schema: str, plain: bool = False) -> Column:
    """Printed Python dict or list to a typed value. `plain` text, without None, True or False, needs no Python."""
    if plain:
        return F.from_json(c, schema, {"allowSingleQuotes": "true"})
    return F.from_json(literal_to_json(c), schema)


def criteria_map(names: Column, values: Column) -> Column:
    """Names to values; of a repeated name the last value stays, whatever the session's rule for repeated keys."""

    def last_ones(pairs: Column) -> Column:
        later = lambda i: F.slice(F.transform(pairs, lambda p: p["name"]), i + 2, F.size(pairs))
        return F.filter(pairs, lambda p, i: ~F.array_contains(later(i), p["name"]))

    return F.map_from_entries(bound_once(F.arrays_zip(names.alias("name"), values.alias("value")), last_ones))


def unnest(
    df: DataFrame, key, column: str, position: str = "pos", into: str = "item", chunk: str | None = None, chunk_rows: int | None = None
) -> DataFrame:
    """(key…, pos, item). With the `chunk` column of a nested table, positions run on through the chunks of a key."""
    rows = df.select(*as_list(key), *as_list(chunk or []), F.posexplode(column).alias(position, into))
    if chunk is None:
        return rows
    return rows.withColumn(position, F.col(chunk) * chunk_size(chunk_rows) + F.col(position)).drop(chunk)


def field_of(array: Column, field: str) -> Column:
    return F.transform(array, lambda r: r[field])


def first_of(array: Column) -> Column:
    return F.get(array, F.lit(0))


def with_defaults(topics: Column, defaults: Mapping[str, str]) -> Column:
    """One struct field per declared topic of a map, its default where the topic is missing."""
    return F.struct(*[F.coalesce(F.try_element_at(topics, F.lit(t)), F.lit(d)).alias(t) for t, d in defaults.items()])


def _is_list(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("ARRAY")


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def repair_record(payload: Column, topics: Mapping[str, tuple[str, bool]] = TOPICS, per_item: bool = False) -> Column:
    """JSON text to a struct with one typed field per topic.

    A topic that is missing, of the wrong type, or junk becomes its default: empty text or empty list. One junk item
    empties the whole list unless `per_item`, which drops only such items.
    """
    return bound_once(_topic_values(payload, topics), lambda record: _repaired(record, topics, per_item))


def _topic_values(payload: Column, topics: Mapping) -> Column:
    """The declared topics of a JSON record, each as it came."""
    return F.from_json(payload, "struct<" + ",".join(f"`{t}`:variant" for t in topics) + ">")


def _repaired(record: Column, topics: Mapping[str, tuple[str, bool]], per_item: bool) -> Column:
    fields = []
    for topic, (name, listed) in topics.items():
        value = record[topic]
        if listed:
            items = F.try_variant_get(value, "$", "array<string>")
            if per_item:
                good = F.filter(items, lambda i: ~is_junk(i))
            else:
                printed = F.replace(F.lower(F.concat_ws("', '", items)), F.lit("."), F.lit(""))
                good = F.when(~printed.rlike("|".join(JUNK_PHRASES)), items)
            fixed = F.coalesce(F.when(_is_list(value), good), F.array().cast("array<string>"))
        else:
            said = F.try_variant_get(value, "$", "string")
            fixed = F.coalesce(F.when(_is_text(value) & ~is_junk(said), said), F.lit(""))
        fields.append(fixed.alias(name))
    return F.struct(*fields)


def violations(df: DataFrame, key, payload: str, topics: Mapping[str, tuple[str, bool]] = TOPICS) -> DataFrame:
    """(key…, topic, problem): topics that are not declared, and declared ones of the wrong type."""
    record = F.col("_record")
    listed = [t for t, (_, is_list) in topics.items() if is_list]
    plain = [t for t, (_, is_list) in topics.items() if not is_list]
    rows = df.select(*as_list(key), F.explode(F.from_json(payload, "map<string,variant>")).alias("topic", "_record"))
    problem = (
        F.when(F.col("topic").isin(listed), F.when(~F.coalesce(_is_list(record), F.lit(False)), F.lit("wrong type")))
        .when(F.col("topic").isin(plain), F.when(~F.coalesce(_is_text(record), F.lit(False)), F.lit("wrong type")))
        .otherwise(F.lit("unknown topic"))
    )
    return rows.withColumn("problem", problem).filter("problem is not null").select(*as_list(key), "topic", "problem")


def to_jobs_parsed(df: DataFrame, key: str = "url", order: str = "idx", job_type: str = JOB_TYPE) -> DataFrame:
    """(url, chunk, jobs_parsed), none of them nullable: each company's posts in index order, cast to the declared type.

    (url, chunk) is the key, see `nest`. Posts without a url are gathered under the empty one.
    """
    wanted = T.DataType.fromDDL(job_type)
    empty = F.lit(None)
    post = F.struct(*[(F.col(f.name) if f.name in df.columns else empty).try_cast(f.dataType).alias(f.name) for f in wanted])
    url = F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key)
    nested = nest(df.select(url, order, post.alias("_post")), key, order, ["_post"], "jobs_parsed")
    posts = F.transform("jobs_parsed", lambda r: r["_post"])
    chunk = F.coalesce("chunk", F.lit(0).cast("bigint")).alias("chunk")
    return nested.select(F.coalesce(key, F.lit("")).alias(key), chunk, F.coalesce(posts, F.array()).alias("jobs_parsed"))
