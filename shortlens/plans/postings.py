"""From stored replies to the nested table of posts, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlens.functions.records import first_object, literal_to_json, repair_record, to_jobs_parsed, violations
from shortlens.operators.joins import enrich_by_position
from shortlens.runtime import settle


def reply_json(payload: Column, quoted: bool = True) -> Column:
    """The dictionary inside a reply, as JSON text; null when there is none."""
    return literal_to_json(first_object(payload, quoted))


def posts_table(replies: DataFrame, raw: DataFrame, per_item: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(jobs_parsed, misses, violations, failures) from replies (idx, url, payload) and raw posts (url, idx, raw fields).

    Posts meet their raw fields on the stored index, so a failed reply shifts nothing. Failures (idx, url, payload, reason)
    are the replies that give no post: without text, without a dictionary in it, or with one that cannot be read.
    """
    # Replies are parsed once; the table, the misses and the violations read the stored result.
    found = first_object(F.col("payload"), True)
    read = replies.select("url", "idx", F.col("payload").alias("_raw"), found.alias("_found"))
    read = settle(read.withColumn("payload", literal_to_json(F.col("_found"))))
    parsed = read.filter("payload is not null").select("url", "idx", "payload")
    no_text, no_object = F.col("_raw").isNull(), F.col("_found").isNull()
    reason = F.when(no_text, "no reply").when(no_object, "no dictionary").otherwise("unreadable dictionary")
    failures = read.filter("payload is null").select("idx", "url", F.col("_raw").alias("payload"), reason.alias("reason"))
    fixed = parsed.select("url", "idx", repair_record(F.col("payload"), per_item=per_item).alias("r")).select("url", "idx", "r.*")
    enriched, misses = enrich_by_position(fixed, raw, "url", "idx")
    return to_jobs_parsed(enriched), misses, violations(parsed, ["url", "idx"], "payload"), failures
