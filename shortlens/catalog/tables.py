"""Sources, sinks, filters and column shaping (A1-A12, B1-B22)."""

from pyspark.sql import functions as F

from shortlens import sources as src
from shortlens.catalog.registry import chunk_sql, query
from shortlens.operators import filters as flt
from shortlens.operators.aggregates import nest
from shortlens.plans.companies import target_companies
from shortlens.runtime import scratch_path, settle

SEGMENTS = {
    "AUTOMOBILE": "Transportation and Logistics",
    "BUILDING": "Real Estate and Construction",
    "FURNITURE": "Manufacturing",
    "HOUSEHOLD": "Retail and Consumer Goods",
    "MACHINERY": "Technology",
}
SEGMENT_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENTS.items()) + " END"


def size_band():
    """Company size from the account balance; unknown below zero."""
    b = F.col("c_acctbal")
    return (
        F.when(b < 0, F.lit(None))
        .when(b < 1000, "None")
        .when(b < 2000, "1 employee")
        .when(b < 4000, "2-10 employees")
        .otherwise("11+ employees")
    )


BAND_SQL = """CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 1000 THEN 'None' WHEN c_acctbal < 2000 THEN '1 employee'
    WHEN c_acctbal < 4000 THEN '2-10 employees' ELSE '11+ employees' END"""


@query("a1_parquet_scan", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(t):
    return src.load(t.spark, t.directory, "supplier")


@query("a2_read_urls", "SELECT url FROM pages")
def _(t):
    path = scratch_path(t.spark, "urls")
    src.write_lines(t("pages"), "url", path)
    return src.read_urls(t.spark, path)


@query("a3_read_payload_csv", "SELECT doc_id, text, length(text) AS n FROM documents")
def _(t):
    path = scratch_path(t.spark, "payload")
    src.append_csv(t("documents").select("doc_id", "text"), path)
    back = src.read_payload_csv(t.spark, path, "doc_id bigint, text string")
    return back.withColumn("n", F.length("text").cast("bigint"))


@query("a4_append_csv", "SELECT event_id, event_type, props FROM events")
def _(t):
    path, events = scratch_path(t.spark, "append"), t("events").select("event_id", "event_type", "props")
    src.append_csv(events.filter("event_type <=> 'error'"), path)
    src.append_csv(events.filter("not event_type <=> 'error'"), path)
    return src.read_payload_csv(t.spark, path, "event_id bigint, event_type string, props string")


@query(
    "a5_write_answers",
    """SELECT c_name AS url, CASE WHEN n > 10 THEN true WHEN n IS NULL THEN NULL ELSE false END AS hiring
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
)
def _(t):
    path = scratch_path(t.spark, "answers")
    counts = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    answers = t("customer").join(counts, "c_custkey", "left").select(F.col("c_name").alias("url"), (F.col("n") > 10).alias("hiring"))
    src.write_answers(answers, path)
    return t.spark.read.schema("url string, hiring boolean").option("header", True).csv(path)


@query("a6_write_lines", "SELECT url AS value FROM pages")
def _(t):
    path = scratch_path(t.spark, "lines")
    src.write_lines(t("pages"), "url", path)
    return t.spark.read.text(path)


@query(
    "a7_save",
    f"""SELECT o_custkey, chunk, count(*) AS n, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS statuses
    FROM (SELECT *, {chunk_sql("o_custkey", "o_orderkey")} AS chunk FROM orders) GROUP BY 1, 2""",
)
def _(t):
    path = scratch_path(t.spark, "nested")
    nested = nest(t("orders"), "o_custkey", "o_orderkey", ["o_orderstatus"], "posts")
    src.save(nested.withColumn("_folder", F.col("chunk")), path, partition_by="_folder")
    back = t.spark.read.parquet(path)
    statuses = F.array_join(F.transform("posts", lambda p: p["o_orderstatus"]), "")
    return back.select("o_custkey", "chunk", F.size("posts").cast("bigint").alias("n"), statuses.alias("statuses"))


@query("a8_from_rows", f"SELECT c_custkey, {SEGMENT_SQL} AS field FROM customer")
def _(t):
    table = src.from_rows(t.spark, list(SEGMENTS.items()), "c_mktsegment string, field string")
    return t("customer").join(table, "c_mktsegment", "left").select("c_custkey", "field")


@query(
    "a9_json_column",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS again FROM events""",
)
def _(t):
    parsed = t("events").withColumn("p", src.from_json_col("props", "k bigint"))
    return parsed.select("event_id", F.col("p.k").alias("k"), src.to_json_col(F.col("p")).alias("again"))


@query("a10_materialize", "SELECT p_type, p_name, count(*) AS n FROM part GROUP BY 1, 2")
def _(t):
    path = scratch_path(t.spark, "stored")
    build = lambda: t("part").groupBy("p_type", "p_name").agg(F.count("*").alias("n"))
    src.materialize(t.spark, path, build, "p_type")
    return src.materialize(t.spark, path, build, "p_type").select("p_type", "p_name", "n")


@query(
    "a11_reuse_computed",
    """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, n, n - (SELECT min(n) FROM c) AS above_least FROM c""",
)
def _(t):
    counts = settle(t("events").groupBy("user_id").agg(F.count("*").alias("n")))
    return counts.withColumn("above_least", F.col("n") - counts.agg(F.min("n")).scalar())


@query(
    "a12_preview",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
def _(t):
    return src.preview(t("orders").select("o_orderkey", "o_totalprice"), 20, [F.desc("o_totalprice"), "o_orderkey"])


def titles(t):
    """Parts with the vector of the same number, null where there is none."""
    vectors = t("embeddings").withColumnRenamed("vec_id", "p_partkey")
    return t("part").join(vectors, "p_partkey", "left")


TITLES = "part LEFT JOIN embeddings ON p_partkey = vec_id"


@query("b1_require", f"SELECT p_partkey, p_name, label FROM {TITLES} WHERE label IS NOT NULL AND p_name IS NOT NULL")
def _(t):
    return flt.require(titles(t), "label", "p_name").select("p_partkey", "p_name", "label")


@query("b2_where", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'")
def _(t):
    return flt.where(t("customer"), "c_mktsegment == 'MACHINERY'").select("c_custkey", "c_name")


@query(
    "b3_exclude_values",
    f"""SELECT c_custkey, size_band FROM (SELECT c_custkey, {BAND_SQL} AS size_band FROM customer)
    WHERE size_band NOT IN ('None', '2-10 employees', '1 employee')""",
)
def _(t):
    banded = t("customer").select("c_custkey", size_band().alias("size_band"))
    return flt.exclude_values(banded, "size_band", ["None", "2-10 employees", "1 employee"])


@query("b4_null_count", f"SELECT count(*) FILTER (WHERE label IS NULL) AS nulls FROM {TITLES}")
def _(t):
    return flt.null_count(titles(t), "label")


@query("b5_map_values", f"SELECT c_custkey, c_mktsegment, {SEGMENT_SQL} AS meta_industry FROM customer")
def _(t):
    return flt.map_values(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", SEGMENTS, "meta_industry")


@query(
    "b5_map_values_default",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Technology' ELSE 'Miscellaneous' END AS meta_industry
    FROM customer""",
)
def _(t):
    only = {"MACHINERY": "Technology"}
    mapped = flt.map_values(t("customer"), "c_mktsegment", only, "meta_industry", "default", "Miscellaneous")
    return mapped.select("c_custkey", "meta_industry")


@query("b6_select_drop", "SELECT p_partkey, p_name, p_type FROM part")
def _(t):
    return t("part").select("p_partkey", "p_name", "p_type", "p_size").drop("p_size")


@query(
    "b7_rename",
    f"""SELECT o_custkey AS company, chunk, string_agg(o_orderstatus || ':' || o_orderpriority, ',' ORDER BY o_orderkey) AS posts
    FROM (SELECT *, {chunk_sql("o_custkey", "o_orderkey")} AS chunk FROM orders) GROUP BY 1, 2""",
)
def _(t):
    nested = nest(t("orders"), "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"], "posts")
    named = {"o_orderstatus": "status", "o_orderpriority": "priority"}
    renamed = flt.rename(nested, {"o_custkey": "company"}).withColumn("posts", F.transform("posts", lambda p: flt.rename_fields(p, named)))
    text = F.array_join(F.transform("posts", lambda p: F.concat_ws(":", p["status"], p["priority"])), ",")
    return renamed.select("company", "chunk", text.alias("posts"))


@query("b8_tag", "SELECT vec_id, label, 'all' AS category FROM embeddings")
def _(t):
    return flt.tag(t("embeddings").select("vec_id", "label"), "category", "all")


@query("b9_row_key", "SELECT conv_id || '_' || turn AS key, role FROM conversations")
def _(t):
    return t("conversations").select(flt.row_key("conv_id", "turn").alias("key"), "role")


@query(
    "b10_contains_col",
    "SELECT p_partkey, p_name FROM part WHERE contains(p_name, CASE WHEN p_size % 2 = 0 THEN 'red' ELSE 'bolt' END)",
)
def _(t):
    wanted = F.when(F.col("p_size") % 2 == 0, "red").otherwise("bolt")
    return t("part").filter(flt.contains_col(F.col("p_name"), wanted)).select("p_partkey", "p_name")


@query(
    "b11_fresh",
    """SELECT o_orderkey FROM orders
    WHERE coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, DATE '1800-01-01') >= DATE '1998-06-01'""",
)
def _(t):
    dated = t("orders").withColumn("posted", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    return flt.fresh(dated, "posted", "1998-06-01").select("o_orderkey")


@query(
    "b12_page_status",
    """SELECT page_id, CASE WHEN html LIKE '%lang="de"%' THEN NULL WHEN regexp_matches(html, '<b>[A-M]') THEN 'Jobs found!'
    ELSE 'No jobs' END AS status, CASE WHEN html LIKE '%lang="de"%' THEN 0 END AS error_code FROM pages""",
)
def _(t):
    status, code = flt.page_status(F.col("html"), 'lang="de"', "<b>[A-M]")
    return t("pages").select("page_id", status.alias("status"), code.alias("error_code"))


@query(
    "b13_status_to_bool",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS hiring FROM orders",
)
def _(t):
    return t("orders").select("o_orderkey", flt.status_to_bool(F.col("o_orderstatus"), "O", "F").alias("hiring"))


SCORES = """SELECT vec_id, label AS cluster, label AS soft_cluster, CASE WHEN vec_id % 5 = 0 THEN 0.0
    ELSE abs(CAST(embedding[1] AS DOUBLE)) END AS soft_prob_initial, abs(CAST(embedding[2] AS DOUBLE)) AS soft_probability,
    abs(CAST(embedding[3] AS DOUBLE)) * 4 AS probability FROM embeddings"""


def scores(t):
    """Confidences read from the first vector components."""
    part = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    return t("embeddings").select(
        "vec_id",
        F.col("label").alias("cluster"),
        F.col("label").alias("soft_cluster"),
        F.when(F.col("vec_id") % 5 == 0, 0.0).otherwise(part(0)).alias("soft_prob_initial"),
        part(1).alias("soft_probability"),
        (part(2) * 4).alias("probability"),
    )


@query(
    "b14_denoise",
    f"""WITH s AS ({SCORES}), p AS (SELECT vec_id, cluster, soft_cluster, soft_prob_initial AS sp,
    CASE WHEN soft_prob_initial = 0 THEN soft_probability ELSE probability END AS pr FROM s)
    SELECT vec_id, CAST(CASE WHEN pr < 0.2 OR (sp > 0 AND sp < 0.04) THEN -1 ELSE soft_cluster END AS INTEGER) AS soft_cluster,
    round(pr, 6) AS probability, round(sp, 6) AS soft_probability FROM p""",
)
def _(t):
    out = flt.denoise(scores(t), min_soft=0.04, min_prob=0.2)
    return out.select("vec_id", "soft_cluster", F.round("probability", 6).alias("probability"), F.round("soft_probability", 6).alias("soft_probability"))


@query("b15_overlay", f"SELECT p_partkey, coalesce(label, p_size) AS value FROM {TITLES}")
def _(t):
    return titles(t).select("p_partkey", flt.overlay(F.col("p_size"), F.col("label")).alias("value"))


@query("b16_fill", f"SELECT p_partkey, coalesce(label, -1) AS label, coalesce(vec_id IS NOT NULL, false) AS known FROM {TITLES}")
def _(t):
    joined = titles(t).withColumn("known", F.when(F.col("label").isNotNull(), F.lit(True)))
    return flt.fill(flt.fill(joined, {"label": -1}), {"known": False}).select("p_partkey", "label", "known")


@query(
    "b17_gate_labels",
    f"""SELECT p_partkey, CASE WHEN abs(embedding[1]) >= 0.05 THEN p_type ELSE 'Unlabelled' END AS layer_0,
    p_brand AS layer_1, p_name AS layer_2 FROM {TITLES} WHERE label IS NOT NULL""",
)
def _(t):
    rows = flt.require(titles(t), "label").select(
        "p_partkey",
        F.abs(F.col("embedding")[0].cast("double")).alias("prob"),
        F.col("p_type").alias("layer_0"),
        F.col("p_brand").alias("layer_1"),
        F.col("p_name").alias("layer_2"),
    )
    return flt.gate_labels(rows, ["layer_0", "layer_1", "layer_2"], "prob", 0.05).drop("prob")


@query(
    "b18_length_filters",
    r"""SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '\s+')) AS w FROM documents)
    WHERE length(w) >= 3 GROUP BY 1 HAVING length(w) <= 12 AND count(*) > 1""",
)
def _(t):
    found = t("documents").select(F.explode(F.split("text", r"\s+")).alias("word"))
    counts = found.filter(flt.min_length(F.col("word"), 3)).groupBy("word").agg(F.count("*").alias("n"))
    return flt.short_and_repeated(counts, "word", "n", max_len=12)


@query("b19_only_clusters", "SELECT vec_id, label FROM embeddings WHERE label IN (1, 4, 7)")
def _(t):
    marked = t("embeddings").select("vec_id", "label")
    return flt.only_clusters(marked, [1, 4, 7], column="label")


@query("b19_drop_noise", "SELECT vec_id, label - 1 AS cluster FROM embeddings WHERE label - 1 <> -1")
def _(t):
    return flt.only_clusters(t("embeddings").select("vec_id", (F.col("label") - 1).alias("cluster")))


@query(
    "b20_after_cursor",
    "SELECT conv_id, turn FROM conversations WHERE turn > 1 OR (turn = 1 AND conv_id >= 60)",
)
def _(t):
    return flt.after_cursor(t("conversations").select("conv_id", "turn"), "turn", "conv_id", 1, 60)


@query("b21_retryable", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'")
def _(t):
    return flt.retryable(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["4-NOT SPECIFIED"])


@query("b22_only_categories", "SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def _(t):
    return flt.only_categories(t("part").select("p_partkey", "p_type"), "p_type", ["PROMO", "SMALL"])


@query(
    "target_companies",
    f"""SELECT c_name AS url FROM (SELECT *, {BAND_SQL} AS company_size FROM customer) JOIN nation ON c_nationkey = n_nationkey
    WHERE c_mktsegment = 'MACHINERY' AND company_size = '11+ employees' AND n_regionkey > 0""",
)
def _(t):
    companies = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_name").alias("url"),
        F.col("c_mktsegment").alias("industries"),
        size_band().alias("company_size"),
        F.when(F.col("n_regionkey") > 0, F.col("n_name")).alias("about"),
    )
    return target_companies(companies, groups=SEGMENTS).select("url")
