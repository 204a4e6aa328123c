"""Joins, aggregates, windows, sorts and set operations (C, D, E, F, G)."""

from pyspark.sql import functions as F

from shortlens.catalog.registry import chunk_sql, query
from shortlens.catalog.tables import BAND_SQL, SCORES, scores, size_band
from shortlens.functions.text import norm_content
from shortlens.operators import aggregates as agg
from shortlens.operators import filters as flt
from shortlens.operators import joins as jn
from shortlens.operators import neighbors as nb
from shortlens.operators import ranking as rk
from shortlens.operators import sets as st

COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
# Mean of each vector component per label, then the vector again.
CENTROIDS = """parts AS (SELECT label, unnest(generate_series(1, 64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
    means AS (SELECT label, i, avg(x) AS m FROM parts GROUP BY 1, 2),
    cents AS (SELECT label, list(m ORDER BY i) AS c FROM means GROUP BY 1)"""


def r6(column):
    return F.round(column, 6)


@query("c1_inner_join", "SELECT p_partkey, p_name, label FROM part JOIN embeddings ON p_partkey = vec_id")
def _(t):
    vectors = t("embeddings").select(F.col("vec_id").alias("p_partkey"), "label")
    return jn.join(t("part").select("p_partkey", "p_name"), vectors, "p_partkey")


@query(
    "c2_join_on_vector",
    "SELECT a.vec_id, b.label FROM embeddings a JOIN (SELECT DISTINCT embedding, label FROM embeddings) b ON a.embedding = b.embedding",
)
def _(t):
    left, right = t("embeddings").select("vec_id", "embedding"), t("embeddings").select("embedding", "label")
    return jn.join_on_vector(left, right, "embedding").select("vec_id", "label")


@query(
    "c3_attach_labels",
    """SELECT p_partkey, p_type, n, priciest FROM part LEFT JOIN (SELECT p_type, count(*) AS n, max(p_retailprice) AS priciest
    FROM part WHERE p_type <> 'PROMO' GROUP BY 1) USING (p_type)""",
)
def _(t):
    labels = t("part").filter("p_type <> 'PROMO'").groupBy("p_type").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("priciest"))
    return jn.attach(t("part").select("p_partkey", "p_type"), labels, "p_type")


KEYED = "SELECT vec_id, label, vec_id % 3 AS category, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings"


@query(
    "c4_attach_centroid",
    f"""WITH k AS ({KEYED}) SELECT vec_id, label, category, round(m, 6) AS centre FROM k LEFT JOIN
    (SELECT label, category, avg(x) AS m FROM k WHERE label <> 3 GROUP BY 1, 2) USING (label, category)""",
)
def _(t):
    keyed = t("embeddings").withColumn("category", F.col("vec_id") % 3)
    cents = agg.centroids(keyed.filter("label <> 3"), ["label", "category"], "embedding")
    joined = jn.attach_centroid(keyed, cents, ["label", "category"])
    return joined.select("vec_id", "label", "category", r6(F.get("centroid", F.lit(0))).alias("centre"))


@query(
    "c5_merge_outer",
    "SELECT coalesce(vec_id, doc_id) AS id, label, quality FROM embeddings FULL JOIN labels ON vec_id = doc_id",
)
def _(t):
    answers = t("labels").select(F.col("doc_id").alias("id"), "quality")
    return jn.merge_outer(t("embeddings").select(F.col("vec_id").alias("id"), "label"), answers, "id")


@query(
    "c6_pairs_within",
    f"""SELECT a.label, a.vec_id AS id1, b.vec_id AS id2, round({COSINE}, 6) AS similarity FROM embeddings a JOIN embeddings b
    ON a.label = b.label AND a.vec_id < b.vec_id WHERE {COSINE} >= 0.15""",
)
def _(t):
    found = nb.pairs(t("embeddings"), "vec_id", "embedding", "cosine", 0.15, within="label")
    return found.select("label", "id1", "id2", r6("similarity").alias("similarity"))


@query(
    "c7_centroid_distances",
    f"""WITH {CENTROIDS}, d AS (SELECT a.label AS cluster, b.label AS neighbor, list_distance(a.c, b.c) AS distance
    FROM cents a JOIN cents b ON a.label <> b.label)
    SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY distance, neighbor) AS INTEGER) AS rank, neighbor,
    round(distance, 6) AS distance FROM d""",
)
def _(t):
    cents = agg.centroids(t("embeddings").withColumnRenamed("label", "cluster"), "cluster", "embedding")
    return nb.centroid_distances(cents, 9).withColumn("distance", r6("distance"))


@query("c8_not_in", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)")
def _(t):
    known = t("embeddings").select(F.col("vec_id").alias("p_partkey"))
    return jn.not_in(t("part").select("p_partkey", "p_name"), known, "p_partkey")


@query(
    "c9_missing_ids",
    """SELECT i AS doc_id FROM (SELECT unnest(generate_series(min(doc_id), max(doc_id))) AS i FROM labels)
    WHERE i NOT IN (SELECT doc_id FROM labels)""",
)
def _(t):
    return jn.missing_ids(t("labels"), "doc_id")


REPLIES = "SELECT conv_id, turn, length(text) AS reply_chars FROM conversations WHERE role = 'assistant'"
ASKED = "SELECT conv_id, turn + 1 AS turn, text FROM conversations WHERE role = 'user'"


def replies_and_questions(t):
    """Answers at their position, and the questions stored for that position."""
    talks = t("conversations")
    replies = talks.filter("role = 'assistant'").select("conv_id", "turn", F.length("text").cast("bigint").alias("reply_chars"))
    asked = talks.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), "text")
    return replies, asked


@query("c10_enrich_by_position", f"SELECT conv_id, turn, reply_chars, text FROM ({REPLIES}) LEFT JOIN ({ASKED}) USING (conv_id, turn)")
def _(t):
    return jn.enrich_by_position(*replies_and_questions(t), "conv_id", "turn")[0]


@query("c10_position_misses", f"SELECT conv_id, turn, reply_chars FROM ({REPLIES}) ANTI JOIN ({ASKED}) USING (conv_id, turn)")
def _(t):
    return jn.enrich_by_position(*replies_and_questions(t), "conv_id", "turn")[1]


@query(
    "c11_lookup_first",
    """SELECT c_custkey, o_orderpriority, o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, o_orderpriority, o_totalprice
    FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) ON c_custkey = o_custkey""",
)
def _(t):
    meta = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority", "o_totalprice")
    return jn.lookup_first(t("customer").select("c_custkey"), meta, "c_custkey", "o_orderkey")


@query(
    "c12_upsert",
    """SELECT coalesce(n.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN b.o_orderstatus
    ELSE 'retried' END AS status FROM orders b FULL JOIN
    (SELECT * FROM orders WHERE o_orderpriority = '5-LOW') n ON b.o_orderkey = n.o_orderkey""",
)
def _(t):
    base = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    newer = t("orders").filter("o_orderpriority = '5-LOW'").select("o_orderkey", F.lit("retried").alias("status"))
    return jn.upsert(base, newer, "o_orderkey")


@query(
    "c13_lookup",
    "SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey",
)
def _(t):
    names = t("nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return jn.lookup(t("customer").select("c_custkey", "c_nationkey"), names, "c_nationkey").select("c_custkey", "n_name")


SIMILAR = f"""SELECT a.vec_id AS id1, b.vec_id AS id2, {COSINE} AS similarity FROM embeddings a JOIN embeddings b
    ON a.vec_id < b.vec_id WHERE {COSINE} >= 0.35"""


@query("c14_similar_pairs", f"SELECT id1, id2, round(similarity, 6) AS similarity FROM ({SIMILAR})")
def _(t):
    return nb.similar_pairs(t("embeddings"), "vec_id", "embedding", 0.35, copies=True).withColumn("similarity", r6("similarity"))


@query("c14_similar_pairs_approx")
def _(t):
    """Not in SQL: random directions. tests/ holds it against all pairs."""
    return nb.pairs(t("embeddings"), "vec_id", "embedding", "cosine", 0.35, approx=True).withColumn("similarity", r6("similarity"))


@query(
    "c14_near_pairs",
    """SELECT a.vec_id AS id1, b.vec_id AS id2, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)
    AS distance FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
    WHERE list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) <= 1.14""",
)
def _(t):
    return nb.near_pairs(t("embeddings"), "vec_id", "embedding", 1.14).withColumn("distance", r6("distance"))


@query("d1_row_count", "SELECT count(*) AS n FROM lineitem")
def _(t):
    return agg.row_count(t("lineitem"))


@query(
    "d2_share",
    """SELECT round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0 END), 6) AS share,
    round(round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0 END), 4) * 100, 2) AS percent FROM orders""",
)
def _(t):
    return agg.share(t("orders"), F.col("o_orderstatus") == "O").withColumn("share", r6("share"))


@query("d3_distinct", "SELECT DISTINCT p_type, p_name FROM part")
def _(t):
    return st.distinct(t("part"), "p_type", "p_name")


@query("d4_group_count", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return agg.group_count(t("events"), "event_type", "user_id")


@query(
    "d5_size_stats",
    """SELECT count(*) AS keys, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, CAST(median(n) AS DOUBLE) AS median,
    round(var_samp(n), 6) AS variance FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""",
)
def _(t):
    stats = agg.size_stats(t("orders"), "o_custkey")
    return stats.withColumns({"mean": r6("mean"), "variance": r6("variance")})


@query("d6_extent", "SELECT min(p_size) AS lowest, max(p_size) AS highest FROM part")
def _(t):
    return agg.extent(t("part"), "p_size")


@query(
    "d7_collect_ordered",
    f"""SELECT p_type, chunk, string_agg(p_name, ',' ORDER BY n DESC, p_name) AS names
    FROM (SELECT *, {chunk_sql("p_type", "n DESC, p_name")} AS chunk FROM
    (SELECT p_type, p_name, count(*) AS n FROM part GROUP BY 1, 2)) GROUP BY 1, 2""",
)
def _(t):
    counts = t("part").groupBy("p_type", "p_name").agg((-F.count("*")).alias("less"))
    listed = agg.collect_ordered(counts, "p_type", "p_name", ["less", "p_name"])
    return listed.select("p_type", "chunk", F.array_join("items", ",").alias("names"))


@query(
    "d8_centroids",
    """SELECT label, i, round(avg(x), 6) AS mean FROM (SELECT label, unnest(generate_series(0, 63)) AS i,
    unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1, 2""",
)
def _(t):
    cents = agg.centroids(t("embeddings"), "label", "embedding")
    return cents.select("label", F.posexplode("centroid").alias("i", "m")).select("label", F.col("i").cast("bigint").alias("i"), r6("m").alias("mean"))


@query(
    "d9_nest",
    f"""SELECT l_orderkey, chunk, string_agg(l_linenumber || ':' || l_returnflag, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_returnflag) AS items FROM (SELECT *, {chunk_sql("l_orderkey", "l_linenumber, l_partkey, l_suppkey, l_returnflag")} AS chunk
    FROM lineitem) GROUP BY 1, 2""",
)
def _(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
    nested = agg.nest(t("lineitem"), "l_orderkey", order, ["l_linenumber", "l_returnflag"])
    text = F.transform("items", lambda i: F.concat_ws(":", i["l_linenumber"], i["l_returnflag"]))
    return nested.select("l_orderkey", "chunk", F.array_join(text, " ").alias("items"))


@query(
    "d9_nest_in_chunks",
    """WITH p AS (SELECT l_returnflag, l_orderkey, l_partkey, l_linenumber, (row_number() OVER (PARTITION BY l_returnflag
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1) // 1000 AS chunk FROM lineitem)
    SELECT l_returnflag, chunk, count(*) AS n, min(l_orderkey) AS first_order, max(l_orderkey) AS last_order FROM p GROUP BY 1, 2""",
)
def _(t):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    nested = agg.nest(t("lineitem"), "l_returnflag", order, ["l_orderkey"], chunk_rows=1000)
    keys = F.transform("items", lambda i: i["l_orderkey"])
    ends = {"first_order": F.array_min(keys), "last_order": F.array_max(keys)}
    return nested.select("l_returnflag", "chunk", F.size("items").cast("bigint").alias("n"), *[c.alias(k) for k, c in ends.items()])


@query(
    "d10_field_value_counts",
    """WITH v AS (SELECT 'o_orderstatus' AS topic, lower(o_orderstatus) AS value FROM orders UNION ALL
    SELECT 'o_orderpriority', lower(o_orderpriority) FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders)
    SELECT topic, value, count(*) AS n FROM v WHERE length(value) <= 50 GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _(t):
    counts = agg.field_value_counts(t("orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"], norm_content)
    return flt.short_and_repeated(counts, "value", "n")


def jobs_by_segment(t):
    counts = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("jobs"))
    return counts.join(t("customer").select("c_custkey", "c_mktsegment"), "c_custkey")


JOBS = "SELECT c_mktsegment, count(*) AS jobs FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment"


def histogram_sql(bins, by):
    group = f"{by}, " if by else ""
    return f"""WITH j AS ({JOBS}), s AS (SELECT {group} min(jobs) AS a, max(jobs) AS b FROM j {f'GROUP BY {by}' if by else ''}),
    w AS (SELECT {group} CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM s),
    f AS (SELECT {group} lo, hi, CAST(i AS INTEGER) AS bin FROM w, unnest(generate_series(0, {bins - 1})) AS g(i)),
    c AS (SELECT {group} CAST(least(floor((jobs - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
    FROM j JOIN w {f'USING ({by})' if by else 'ON true'} GROUP BY {group} bin)
    SELECT {f'f.{by}, ' if by else ''} f.bin, round(lo + (hi - lo) / {bins} * f.bin, 6) AS lower,
    round(lo + (hi - lo) / {bins} * (f.bin + 1), 6) AS upper, coalesce(n, 0) AS n
    FROM f LEFT JOIN c ON f.bin = c.bin {f'AND f.{by} = c.{by}' if by else ''}"""


@query("d11_histogram", histogram_sql(20, None))
def _(t):
    bins = agg.histogram(jobs_by_segment(t), "jobs", 20)
    return bins.withColumns({"lower": r6("lower"), "upper": r6("upper")})


@query("d11_histogram_by_segment", histogram_sql(50, "c_mktsegment"))
def _(t):
    bins = agg.histogram(jobs_by_segment(t), "jobs", 50, by="c_mktsegment")
    return bins.withColumns({"lower": r6("lower"), "upper": r6("upper")})


@query(
    "d12_hiring_rate",
    f"""WITH o AS (SELECT o_custkey, count(*) AS jobs, max(o_orderdate) >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 180 DAY
    AS hiring FROM orders GROUP BY 1), c AS (SELECT n_name, {BAND_SQL} AS size_band, hiring, jobs FROM customer
    JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON c_custkey = o_custkey)
    SELECT n_name, size_band, count(*) AS companies, count(hiring) AS known, count(*) FILTER (WHERE hiring) AS hiring,
    round(count(*) FILTER (WHERE hiring) / nullif(count(hiring), 0), 6) AS rate, CAST(sum(jobs) AS BIGINT) AS jobs,
    round(avg(jobs), 6) AS jobs_mean, CAST(median(jobs) AS DOUBLE) AS jobs_median, round(var_samp(jobs), 6) AS jobs_variance
    FROM c WHERE size_band IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    orders = t("orders")
    latest = orders.agg(F.max("o_orderdate")).scalar()
    since = F.expr("INTERVAL 180 DAYS")
    activity = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("jobs"), F.max("o_orderdate").alias("last")
    )
    active = activity.select("c_custkey", "jobs", (F.col("last") >= latest - since).alias("hiring"))
    companies = t("customer").withColumn("size_band", size_band()).withColumnRenamed("c_nationkey", "n_nationkey")
    companies = flt.require(companies, "size_band").join(t("nation").select("n_nationkey", "n_name"), "n_nationkey")
    rates = agg.hiring_rate(companies.join(active, "c_custkey", "left"), ["n_name", "size_band"])
    return rates.withColumns({c: r6(c) for c in ("rate", "jobs_mean", "jobs_variance")})


@query(
    "d13_occurrences",
    """SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents""",
)
def _(t):
    return t("documents").select("doc_id", agg.occurrences(F.col("text"), "the").alias("n"))


@query(
    "d13_occurrences_total",
    "SELECT CAST(sum((length(text) - length(replace(text, 'the', ''))) // 3) AS BIGINT) AS n, count(*) AS lines FROM documents",
)
def _(t):
    return t("documents").agg(F.sum(agg.occurrences(F.col("text"), "the")).alias("n"), F.count("*").alias("lines"))


@query(
    "d14_confident_centers",
    f"""SELECT s.cluster, round(avg(CAST(embedding[1] AS DOUBLE)) FILTER (WHERE probability > 0.5), 6) AS x,
    round(avg(CAST(embedding[2] AS DOUBLE)) FILTER (WHERE probability > 0.5), 6) AS y
    FROM ({SCORES}) s JOIN embeddings USING (vec_id) GROUP BY 1""",
)
def _(t):
    xy = t("embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("px"), F.col("embedding")[1].cast("double").alias("py"))
    centers = agg.confident_centers(scores(t).join(xy, "vec_id"), "px", "py", "probability", 0.5)
    return centers.select("cluster", r6("x").alias("x"), r6("y").alias("y"))


@query(
    "d15_mean_intra_similarity",
    f"""SELECT a.label, (SELECT count(*) FROM embeddings e WHERE e.label = a.label) AS members, round(avg({COSINE}), 6)
    AS mean_similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""",
)
def _(t):
    return nb.mean_intra_similarity(t("embeddings"), "label", "embedding").withColumn("mean_similarity", r6("mean_similarity"))


@query(
    "d16_cluster_summary",
    """SELECT count(DISTINCT label) FILTER (WHERE label > 2) AS clusters, count(*) FILTER (WHERE label > 2) AS clustered,
    count(*) FILTER (WHERE label <= 2) AS noise FROM embeddings""",
)
def _(t):
    marked = t("embeddings").select(F.when(F.col("label") <= 2, -1).otherwise(F.col("label")).alias("cluster"))
    return agg.cluster_summary(marked)


@query(
    "d17_run_totals",
    """SELECT count(*) FILTER (WHERE event_type = 'purchase') AS scraped, count(*) FILTER (WHERE event_type = 'error') AS failed
    FROM events""",
)
def _(t):
    kind = F.col("event_type")
    return agg.run_totals(t("events"), kind == "purchase", kind == "error")


@query("d18_keys_in_use", "SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def _(t):
    return agg.keys_in_use(t("events").select(F.from_json("props", "map<string,string>").alias("m")), "m")


@query(
    "e1_nearest_cluster",
    f"""WITH {CENTROIDS} SELECT a.label AS cluster, b.label AS neighbor, round(list_distance(a.c, b.c), 6) AS distance
    FROM cents a JOIN cents b ON a.label <> b.label
    QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY list_distance(a.c, b.c), b.label) = 1""",
)
def _(t):
    cents = agg.centroids(t("embeddings").withColumnRenamed("label", "cluster"), "cluster", "embedding")
    return nb.nearest_cluster(cents).withColumn("distance", r6("distance"))


@query(
    "e2_top_words",
    """SELECT p_type, word, count(*) AS count, CAST(row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, word) AS INTEGER)
    AS rank FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1, 2 QUALIFY rank BETWEEN 2 AND 6""",
)
def _(t):
    found = t("part").select("p_type", F.explode(F.split("p_name", " ")).alias("word"))
    return rk.top_words(found, "p_type", "word", 5, start=1)


@query("e3_with_occurrences", "SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS occurrences FROM part")
def _(t):
    return rk.with_occurrences(t("part").select("p_partkey", "p_name"), "p_name")


INDEXED = """SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_name) - 1 AS index
    FROM (SELECT DISTINCT p_type, p_name FROM part)"""


@query("e4_index_distinct", INDEXED)
def _(t):
    return rk.index_distinct(t("part"), "p_type", "p_name")


@query("e4_index_distinct_hot", INDEXED)
def _(t):
    return rk.index_distinct(t("part"), "p_type", "p_name", hot_rows=10)


@query(
    "e5_knn",
    """SELECT a.vec_id AS id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS INTEGER) AS rank,
    b.vec_id AS neighbor, round(d, 6) AS distance FROM (SELECT a.vec_id AS x, b.vec_id AS y,
    list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b
    ON a.vec_id <> b.vec_id) JOIN embeddings a ON a.vec_id = x JOIN embeddings b ON b.vec_id = y QUALIFY rank <= 3""",
)
def _(t):
    return nb.knn(t("embeddings"), "vec_id", "embedding", 3).withColumn("distance", r6("distance"))


@query(
    "e6_best_match",
    f"""WITH s AS ({SIMILAR}), both_ways AS (SELECT id1 AS id, id2 AS match, similarity FROM s UNION ALL SELECT id2, id1, similarity FROM s)
    SELECT id, match, round(similarity, 6) AS similarity FROM both_ways
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, match DESC) = 1""",
)
def _(t):
    found = nb.similar_pairs(t("embeddings"), "vec_id", "embedding", 0.35, copies=True)
    return nb.best_match(found).withColumn("similarity", r6("similarity"))


@query("f1_sort_counts", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY user_id, n DESC")
def _(t):
    return agg.group_count(t("events"), "user_id", "event_type").orderBy("user_id", F.desc("n"))


@query("f2_sort_by_cluster", "SELECT label, vec_id FROM embeddings ORDER BY label")
def _(t):
    return t("embeddings").select("label", "vec_id").orderBy("label")


@query("f3_top_counts", "SELECT user_id, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return rk.top_counts(t("events"), "user_id", 10)


@query("f4_head", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10")
def _(t):
    return rk.head(t("orders").select("o_orderkey", "o_custkey"), 10, "o_orderkey")


@query("f5_sample_n", "SELECT p_partkey, p_name FROM part ORDER BY md5(p_partkey || ':42'), p_partkey LIMIT 100")
def _(t):
    return rk.sample_n(t("part").select("p_partkey", "p_name"), 100, "p_partkey", 42)


@query(
    "f6_first_n",
    "SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 3, 7), ' ') AS words FROM documents",
)
def _(t):
    return t("documents").select("doc_id", F.array_join(rk.first_n(F.split("text", " "), 5, start=2), " ").alias("words"))


@query("f7_round_robin", "SELECT conv_id, turn, role FROM conversations ORDER BY turn, conv_id")
def _(t):
    return rk.round_robin(t("conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("f8_category_order", "SELECT p_type, count(DISTINCT p_name) AS titles FROM part GROUP BY 1 ORDER BY 1")
def _(t):
    return t("part").groupBy("p_type").agg(F.count_distinct("p_name").alias("titles")).orderBy("p_type")


@query(
    "g1_supplement",
    f"""SELECT i AS doc_id, coalesce(chunk, 0) AS chunk, coalesce(words, 'Unlabelled') AS words FROM
    (SELECT unnest(generate_series(min(doc_id), max(doc_id))) AS i FROM labels) LEFT JOIN
    (SELECT doc_id, chunk, string_agg(quality || ' ' || toxic, ',' ORDER BY quality, toxic) AS words FROM
    (SELECT *, {chunk_sql("doc_id", "quality, toxic")} AS chunk FROM labels) GROUP BY 1, 2) ON i = doc_id""",
)
def _(t):
    marks = t("labels").withColumn("mark", F.concat_ws(" ", "quality", "toxic"))
    listed = agg.collect_ordered(marks, "doc_id", "mark", ["quality", "toxic"], "words")
    full = st.supplement(listed, jn.missing_ids(listed, "doc_id"), "doc_id", "words")
    return full.select("doc_id", "chunk", F.array_join("words", ",").alias("words"))


@query(
    "g2_symmetrize",
    f"""WITH s AS ({SIMILAR}) SELECT id1, id2, round(similarity, 6) AS similarity FROM s UNION ALL
    SELECT id2, id1, round(similarity, 6) FROM s""",
)
def _(t):
    found = nb.similar_pairs(t("embeddings"), "vec_id", "embedding", 0.35, copies=True)
    return st.symmetrize(found).withColumn("similarity", r6("similarity"))


@query(
    "g3_flatten_lists",
    f"""SELECT l_orderkey, chunk, string_agg(l_returnflag || l_linestatus, '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS marks
    FROM (SELECT *, {chunk_sql("l_orderkey", "l_linenumber, l_partkey, l_suppkey")} AS chunk FROM lineitem) GROUP BY 1, 2""",
)
def _(t):
    marks = t("lineitem").withColumn("pair", F.array("l_returnflag", "l_linestatus"))
    listed = agg.collect_ordered(marks, "l_orderkey", "pair", ["l_linenumber", "l_partkey", "l_suppkey"])
    return listed.select("l_orderkey", "chunk", F.array_join(st.flatten_lists("items"), "").alias("marks"))


@query("g4_distinct_status", "SELECT DISTINCT o_orderstatus FROM orders")
def _(t):
    return st.distinct(t("orders"), "o_orderstatus")


