"""Vector functions and the text-clustering dataflows (H11, H12, H37-H40, I1-I19)."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shortlens.catalog.registry import query
from shortlens.catalog.relational import CENTROIDS, COSINE, r6
from shortlens.catalog.tables import titles
from shortlens.catalog.text import stopped_sql, whitelist_sql
from shortlens.functions import vectors as vec
from shortlens.operators.aggregates import centroids
from shortlens.operators.joins import attach
from shortlens.plans import clusters as cl
from shortlens.plans import embedding as em
from shortlens.plans import hierarchy as hi
from shortlens.plans import model as dm
from shortlens.plans import naming as nm
from shortlens.plans import quality as ql
from shortlens.plans.layout import neighbor_map
from shortlens.plans.publish import map_points
from shortlens.runtime import scratch_path
from shortlens.sources import from_rows

LEXICON = [("bolt", "NN"), ("gear", "NN"), ("ring", "NN"), ("plate", "VB"), ("rod", "NNS"), ("red", "JJ"), ("cold", "JJ")]
LEMMAS = [("bolt", "fastener"), ("rod", "bar"), ("hot", "warm"), ("old", "aged")]
NOUNS = "('bolt', 'gear', 'ring', 'rod')"


def lexicon(t):
    return from_rows(t.spark, LEXICON, "word string, pos string")


def lemmas(t):
    return from_rows(t.spark, LEMMAS, "word string, lemma string")


TAGGED = f"""tagged AS (SELECT p_partkey, p_type, p_name, CASE WHEN b IN {NOUNS} AND a IN {NOUNS} THEN p_name WHEN b IN {NOUNS} THEN b
    WHEN a IN {NOUNS} THEN a ELSE p_name END AS kept FROM (SELECT *, string_split(p_name, ' ')[1] AS a,
    string_split(p_name, ' ')[2] AS b FROM part))"""
LEMMA_SQL = "CASE w WHEN 'bolt' THEN 'fastener' WHEN 'rod' THEN 'bar' WHEN 'hot' THEN 'warm' WHEN 'old' THEN 'aged' ELSE w END"


@query("h11_keep_pos", f"WITH {TAGGED} SELECT p_partkey, kept AS p_name FROM tagged")
def _(t):
    return nm.keep_pos(t("part").select("p_partkey", "p_name"), "p_name", lexicon(t))


@query("h12_lemmatize", f"SELECT p_partkey, {LEMMA_SQL} AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)")
def _(t):
    found = t("part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return nm.lemmatize(found, "word", lemmas(t))


def with_centroid(t):
    rows = t("embeddings")
    return rows.join(centroids(rows, "label", "embedding"), "label")


DOUBLES = "CAST(embedding AS DOUBLE[])"


@query("h37_cosine", f"WITH {CENTROIDS} SELECT vec_id, round(list_cosine_similarity({DOUBLES}, c), 6) AS similarity FROM embeddings JOIN cents USING (label)")
def _(t):
    return with_centroid(t).select("vec_id", r6(vec.cosine(F.col("embedding"), F.col("centroid"))).alias("similarity"))


@query(
    "h38_euclidean",
    f"""WITH {CENTROIDS} SELECT vec_id, round(list_distance({DOUBLES}, c), 6) AS distance,
    round(1 - list_distance({DOUBLES}, c), 6) AS similarity FROM embeddings JOIN cents USING (label)""",
)
def _(t):
    a, b = F.col("embedding"), F.col("centroid")
    return with_centroid(t).select("vec_id", r6(vec.euclidean(a, b)).alias("distance"), r6(vec.euclidean_sim(a, b)).alias("similarity"))


@query(
    "h39_l2_normalize",
    f"""WITH {CENTROIDS} SELECT label, i, round(m / sqrt(list_dot_product(c, c)), 6) AS x FROM means JOIN cents USING (label)""",
)
def _(t):
    cents = centroids(t("embeddings"), "label", "embedding")
    units = vector_to_array(vec.to_vector(vec.l2_normalize(F.col("centroid"))))
    rows = cents.select("label", F.posexplode(units).alias("i", "x"))
    return rows.select("label", (F.col("i") + 1).cast("bigint").alias("i"), r6("x").alias("x"))


@query(
    "h40_argmax",
    """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS at,
    round(CAST(list_max(embedding) AS DOUBLE), 6) AS top FROM embeddings""",
)
def _(t):
    e = F.col("embedding")
    return t("embeddings").select("vec_id", vec.argmax(e).cast("bigint").alias("at"), r6(F.array_max(e).cast("double")).alias("top"))


CLEANED = stopped_sql(whitelist_sql("lower(text)"))


@query(
    "i1_embed_sentences",
    f"""SELECT doc_id AS index, c AS sentence_cleaned, 256 AS dims, CASE WHEN len(list_filter(string_split_regex(c, '\\s'), lambda w: w <> ''))
    > 0 THEN true ELSE false END AS has_words FROM (SELECT doc_id, {CLEANED} AS c FROM documents)""",
)
def _(t):
    rows = t("documents").select(F.col("doc_id").alias("index"), F.col("text").alias("sentence"))
    out = em.embed_sentences(rows)
    spoken = F.size(F.filter(F.split("sentence_cleaned", r"\s"), lambda w: w != "")) > 0
    return out.select("index", "sentence_cleaned", F.size("embedding").alias("dims"), spoken.alias("has_words"))


@query(
    "i2_embed_by_category",
    """SELECT p_type, p_name AS sentence_cleaned, count(*) AS n, 1.0::DOUBLE AS length FROM part GROUP BY 1, 2""",
)
def _(t):
    rows = t("part").select("p_type", F.col("p_partkey").alias("index"), F.col("p_name").alias("sentence"))
    out = em.embed_sentences(rows, category="p_type", stopwords=False)
    return out.groupBy("p_type", "sentence_cleaned").agg(
        F.count("*").alias("n"), F.round(F.avg(vec.norm(F.col("embedding"))), 6).alias("length")
    )


@query("i3_pca")
def _(t):
    low = em.pca(t("embeddings"), "embedding", 50)
    return low.select("vec_id", F.size("embedding_pca").alias("dims"), r6(vec.norm(F.col("embedding_pca"))).alias("length"))


@query(
    "i3_pca_full_width",
    """SELECT a.vec_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS distance
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(t):
    """At full width the projection only turns the points: distances between them stay."""
    turned = em.pca(t("embeddings"), "embedding", 64).select("vec_id", "embedding_pca")
    after = turned.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding_pca").alias("after"))
    distance = F.round(vec.euclidean(F.col("embedding_pca"), F.col("after")), 5)
    return turned.join(after, "vec_id").select("vec_id", distance.alias("distance"))


@query("i4_project_2d")
def _(t):
    return em.project_2d(t("embeddings"), "embedding").select("vec_id", r6(F.abs("x")).alias("x"), r6(F.abs("y")).alias("y"))


@query("i4_neighbor_map")
def _(t):
    """Not in SQL: gradient steps. tests/ measures how far neighbours stay together."""
    return neighbor_map(t("embeddings"), "vec_id", "embedding").select("vec_id", r6("x").alias("x"), r6("y").alias("y"))


def chains_sql(edges):
    """Components of an edge list (id1, id2) in both directions, labelled by the smallest member."""
    return f"""e AS MATERIALIZED ({edges}), walk(id, spot) AS (SELECT DISTINCT id1, id1 FROM e UNION
    SELECT walk.id, e.id2 FROM walk JOIN e ON walk.spot = e.id1), comp AS (SELECT id, min(spot) AS c FROM walk GROUP BY 1)"""


# Clusters are numbered in order of their smallest id.
NUMBER = "dense_rank() OVER (ORDER BY c) - 1 AS number"


def on_text_ids(sql):
    return sql.replace("embeddings", "named")


LINKED = f"SELECT a.vec_id AS id1, b.vec_id AS id2 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {COSINE} >= 0.35"
MEAN_SIM = f"""sims AS (SELECT x.c, avg({COSINE}) AS s FROM comp x JOIN comp y ON x.c = y.c AND x.id < y.id
    JOIN embeddings a ON a.vec_id = x.id JOIN embeddings b ON b.vec_id = y.id GROUP BY 1)"""


@query(
    "i5_similarity_clusters",
    f"""WITH RECURSIVE {chains_sql(LINKED)}, {MEAN_SIM}, kept AS (SELECT id, c FROM comp JOIN sims USING (c) WHERE s >= 0.2)
    SELECT vec_id, coalesce(number, -1) AS cluster FROM embeddings LEFT JOIN (SELECT id, {NUMBER} FROM kept) ON vec_id = id""",
)
def _(t):
    return cl.similarity_clusters(t("embeddings"), "vec_id", "embedding", 0.35, 0.2)


def with_text_ids(t):
    return t("embeddings").withColumn("vec_id", F.concat_ws("_", F.lit("vector"), "vec_id"))


TEXT_IDS = "named AS MATERIALIZED (SELECT 'vector_' || vec_id AS vec_id, embedding FROM embeddings)"


@query(
    "i5_similarity_clusters_text_ids",
    f"""WITH RECURSIVE {TEXT_IDS}, {chains_sql(on_text_ids(LINKED))}, {on_text_ids(MEAN_SIM)}, kept AS (SELECT id, c FROM comp
    JOIN sims USING (c) WHERE s >= 0.2)
    SELECT vec_id, coalesce(number, -1) AS cluster FROM named LEFT JOIN (SELECT id, {NUMBER} FROM kept) ON vec_id = id""",
)
def _(t):
    return cl.similarity_clusters(with_text_ids(t), "vec_id", "embedding", 0.35, 0.2)


NEAR = """SELECT a.vec_id AS id1, b.vec_id AS id2 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
    WHERE list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) <= 1.14"""
DENSE = f"""near AS MATERIALIZED ({NEAR}), core AS (SELECT id1 AS id FROM near GROUP BY 1 HAVING count(*) >= 2),
    {chains_sql("SELECT id1, id2 FROM near WHERE id1 IN (SELECT id FROM core) AND id2 IN (SELECT id FROM core)")},
    big AS (SELECT c FROM comp GROUP BY 1 HAVING count(*) >= 5),
    dense AS (SELECT vec_id, coalesce(number, -1) AS cluster FROM embeddings LEFT JOIN
    (SELECT id, {NUMBER} FROM comp WHERE c IN (SELECT c FROM big)) ON vec_id = id)"""


def dense(t):
    return cl.density_clusters(t("embeddings"), "vec_id", "embedding", 1.14, 2, 5)


@query("i6_density_clusters_text_ids", f"WITH RECURSIVE {TEXT_IDS}, {on_text_ids(DENSE)} SELECT vec_id, cluster FROM dense")
def _(t):
    return cl.density_clusters(with_text_ids(t), "vec_id", "embedding", 1.14, 2, 5)


@query("i6_density_clusters", f"WITH RECURSIVE {DENSE} SELECT vec_id, cluster FROM dense")
def _(t):
    return dense(t)


TREE = """WITH RECURSIVE d AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
), core AS (SELECT a, d AS core FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d) = 2
), m AS MATERIALIZED (
  SELECT d.a, d.b, greatest(d.d, x.core, y.core) AS w FROM d JOIN core x ON x.a = d.a JOIN core y ON y.a = d.b
), grow(step, id, w, last, taken) AS (
  SELECT 0, vec_id, CAST('inf' AS DOUBLE), NULL::BIGINT, NULL::DOUBLE FROM embeddings
  UNION ALL
  SELECT step + 1, grow.id, least(grow.w, coalesce(m.w, grow.w)), next.id, next.w
  FROM grow JOIN (SELECT arg_min(id, (w, id)) AS id, min(w) AS w FROM grow) next ON true LEFT JOIN m ON m.a = next.id AND m.b = grow.id
  WHERE grow.id <> next.id
), seen AS MATERIALIZED (
  SELECT step, last AS id, any_value(taken) AS w FROM grow WHERE last IS NOT NULL GROUP BY 1, 2
), ranked AS MATERIALIZED (
  SELECT * FROM seen UNION ALL SELECT max(step) + 1, (SELECT id FROM grow ORDER BY step DESC LIMIT 1), (SELECT w FROM grow ORDER BY step DESC LIMIT 1) FROM seen
), half AS (
  SELECT x.id AS a, y.id AS b, max(y.w) OVER (PARTITION BY x.id ORDER BY y.step) AS u FROM ranked x JOIN ranked y ON y.step > x.step
), u AS MATERIALIZED (
  SELECT a, b, u FROM half UNION ALL SELECT b, a, u FROM half UNION ALL SELECT vec_id, vec_id, 0 FROM embeddings
), home AS MATERIALIZED (
  SELECT a AS id, u AS w FROM u QUALIFY row_number() OVER (PARTITION BY a ORDER BY u) = 5
), births AS MATERIALIZED (
  SELECT first AS birth, min(w) AS formed FROM (
    SELECT h.id, h.w, min(u.b) AS first, min(o.w) AS least FROM home h JOIN u ON u.a = h.id AND u.u <= h.w JOIN home o ON o.id = u.b GROUP BY 1, 2)
  WHERE least = w GROUP BY 1
), meets AS MATERIALIZED (
  SELECT x.birth, u.u AS dist, dense_rank() OVER (PARTITION BY x.birth ORDER BY u.u) AS level
  FROM births x JOIN births y ON x.birth <> y.birth JOIN u ON u.a = x.birth AND u.b = y.birth
), ladder AS (
  SELECT birth, 0 AS level, formed FROM births UNION ALL SELECT DISTINCT birth, level, dist FROM meets
), nodes AS (
  SELECT *, lead(formed) OVER (PARTITION BY birth ORDER BY level) AS top, max(level) OVER (PARTITION BY birth) AS last FROM ladder
), chosen AS (
  SELECT birth, formed, top FROM nodes WHERE level < last AND (top > 1.14 OR level = last - 1) QUALIFY row_number() OVER (PARTITION BY birth ORDER BY level) = 1
), rows AS (
  SELECT DISTINCT u.b AS id, c.formed, min(u.b) OVER (PARTITION BY c.birth) AS first FROM chosen c JOIN u ON u.a = c.birth AND u.u < c.top
), named AS (SELECT *, dense_rank() OVER (ORDER BY first) - 1 AS number FROM rows)
SELECT e.vec_id, coalesce(number, -1) AS cluster, round(coalesce(n.formed / greatest(h.w, n.formed), 0), 6) AS probability
FROM embeddings e LEFT JOIN named n ON n.id = e.vec_id LEFT JOIN home h ON h.id = e.vec_id"""


@query("i6_density_tree", TREE)
def _(t):
    found = hi.tree_clusters(t("embeddings"), "vec_id", "embedding", 2, 5, "leaf", 1.14)
    return found.withColumn("probability", r6("probability"))


# The tree of the rows that have a label, asked about all rows. A row the model holds keeps its place.
KNOWN_TREE = TREE[: TREE.rindex("SELECT e.vec_id")].replace("embeddings", "known").replace("WITH RECURSIVE d AS", "WITH RECURSIVE known AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)), d AS")
ASKED = """, spot AS (
  SELECT n.id, number, formed, first, w AS taken, min(c.top) AS top
  FROM named n JOIN home USING (id) JOIN u ON u.b = n.id JOIN (SELECT DISTINCT birth, formed, top FROM chosen) c USING (formed)
  WHERE c.birth = u.a AND u.u < c.top GROUP BY ALL
), far AS (
  SELECT e.vec_id, k.vec_id AS p, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])) AS d
  FROM embeddings e JOIN known k ON true WHERE e.vec_id NOT IN (SELECT vec_id FROM known)
), own AS (SELECT vec_id, d AS core FROM far QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d) = 2
), entry AS (
  SELECT far.vec_id, p, greatest(d, own.core, core.core) AS reach FROM far JOIN own USING (vec_id) JOIN core ON core.a = p
  QUALIFY row_number() OVER (PARTITION BY far.vec_id ORDER BY reach, p) = 1
), placed AS (
  SELECT id AS vec_id, number, formed / greatest(taken, formed) AS probability FROM spot UNION ALL
  SELECT vec_id, number, formed / greatest(taken, reach, formed) FROM entry JOIN spot ON spot.id = p WHERE greatest(taken, reach) < top
)"""
MODEL_SAMPLES, MODEL_SIZE, MODEL_EPSILON = 2, 5, 1.14


def stored_model(t, known):
    path = scratch_path(t.spark, "model")
    dm.fit_model(known, "vec_id", "embedding", path, MODEL_SAMPLES, MODEL_SIZE, "leaf", MODEL_EPSILON)
    return dm.load_model(t.spark, path)


@query(
    "i9_stored_model",
    KNOWN_TREE + ASKED + """ SELECT e.vec_id, coalesce(number, -1) AS cluster, round(coalesce(probability, 0), 6) AS probability
    FROM embeddings e LEFT JOIN placed USING (vec_id)""",
)
def _(t):
    known = t("embeddings").join(t("labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    found = dm.assign(stored_model(t, known), t("embeddings"), "vec_id", "embedding")
    return found.withColumn("probability", r6("probability"))


EXEMPLARS = """, marks AS (
  SELECT DISTINCT u.b AS id, number, n.formed FROM births x JOIN u ON u.a = x.birth AND u.u <= x.formed JOIN home h ON h.id = u.b AND h.w = x.formed
  JOIN named n ON n.id = u.b
), near AS (
  SELECT e.vec_id, number, any_value(formed) AS formed, min(d) AS d, min(greatest(d, own.core, core.core)) AS reach
  FROM (SELECT e.vec_id, m.id, number, formed, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])) AS d
    FROM embeddings e JOIN marks m ON true JOIN embeddings k ON k.vec_id = m.id) e
  JOIN core own ON own.a = e.vec_id JOIN core ON core.a = e.id GROUP BY 1, 2
), merged AS (SELECT vec_id, number, formed / greatest(reach, formed) AS strength, strength / greatest(d, 1e-9) AS value FROM near),
soft AS (
  SELECT vec_id, arg_min(number, (-value, number)) AS soft_cluster, max(value) / sum(value) * max(strength) AS soft_probability FROM merged GROUP BY 1
)"""


@query(
    "i8_soft_exemplars",
    TREE[: TREE.rindex("SELECT e.vec_id")] + EXEMPLARS + """ SELECT vec_id, coalesce(soft_cluster, -1) AS soft_cluster, round(coalesce(soft_probability, 0), 6) AS soft_probability
    FROM embeddings LEFT JOIN soft USING (vec_id)""",
)
def _(t):
    found = dm.exemplar_membership(stored_model(t, t("embeddings")), t("embeddings"), "vec_id", "embedding")
    return found.withColumn("soft_probability", r6("soft_probability"))


@query(
    "i7_membership",
    f"""WITH RECURSIVE {DENSE}, d AS (SELECT a.vec_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    core_d AS (SELECT vec_id, d FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d) = 2)
    SELECT vec_id, cluster, CASE WHEN cluster = -1 THEN 0.0::DOUBLE ELSE round(min(d) OVER (PARTITION BY cluster) / d, 6) END AS probability
    FROM dense JOIN core_d USING (vec_id)""",
)
def _(t):
    found = cl.membership(t("embeddings"), dense(t), "vec_id", "embedding", 2)
    return found.withColumn("probability", r6("probability"))


PULL = """d AS (SELECT vec_id, b.label, 1 / list_distance(CAST(a.embedding AS DOUBLE[]), b.c) AS w FROM embeddings a JOIN cents b ON true),
    soft AS (SELECT vec_id, label AS soft_cluster, w / sum(w) OVER (PARTITION BY vec_id) AS soft_probability FROM d
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, label) = 1)"""


def model_centroids(rows):
    return centroids(rows.withColumnRenamed("label", "cluster"), "cluster", "embedding")


@query(
    "i8_soft_clusters",
    f"WITH {CENTROIDS}, {PULL} SELECT vec_id, soft_cluster, round(soft_probability, 6) AS soft_probability FROM soft",
)
def _(t):
    rows = t("embeddings").select("vec_id", "embedding")
    soft = cl.soft_clusters(rows, model_centroids(t("embeddings")), "vec_id", "embedding")
    return soft.select("vec_id", "soft_cluster", r6("soft_probability").alias("soft_probability"))


KNOWN_CENTROIDS = CENTROIDS.replace("FROM embeddings)", "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels))")


@query(
    "i9_predict_clusters",
    f"""WITH {KNOWN_CENTROIDS}, {PULL}, m AS (SELECT vec_id, vec_id IN (SELECT doc_id FROM labels) AS known, label, soft_cluster, soft_probability,
    abs(CAST(embedding[1] AS DOUBLE)) * 4 AS p FROM embeddings JOIN soft USING (vec_id)), f AS (SELECT vec_id,
    CASE WHEN known THEN label ELSE -1 END AS cluster, CASE WHEN known THEN label ELSE soft_cluster END AS sc,
    CASE WHEN known THEN p ELSE soft_probability END AS probability, CASE WHEN known THEN 0.05 ELSE 0.0 END AS sp FROM m)
    SELECT vec_id, cluster, CASE WHEN probability < 0.11 THEN -1 ELSE sc END AS soft_cluster, round(probability, 6) AS probability,
    CAST(sp AS DOUBLE) AS soft_probability FROM f""",
)
def _(t):
    known = t("embeddings").join(t("labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    model = known.select(
        "vec_id",
        F.col("label").alias("cluster"),
        F.col("label").alias("soft_cluster"),
        (F.abs(F.col("embedding")[0].cast("double")) * 4).alias("probability"),
        F.lit(0.05).alias("soft_probability"),
    )
    out = cl.predict_clusters(t("embeddings"), model, model_centroids(known), "vec_id", "embedding", 0.004, 0.11)
    return out.withColumn("probability", r6("probability"))


@query(
    "i10_centroid_affinity",
    f"""WITH {CENTROIDS} SELECT vec_id, round(list_cosine_similarity({DOUBLES}, c), 6) AS sim_to_centroid,
    round(list_distance({DOUBLES}, c), 6) AS distance FROM embeddings JOIN cents USING (label)""",
)
def _(t):
    near = cl.centroid_affinity(t("embeddings"), ["label"], "embedding", "cosine", "sim_to_centroid")
    far = cl.centroid_affinity(near, ["label"], "embedding", "euclidean", "distance")
    return far.select("vec_id", r6("sim_to_centroid").alias("sim_to_centroid"), r6("distance").alias("distance"))


@query(
    "i11_cluster_neighbors",
    f"""WITH {CENTROIDS} SELECT a.label, b.label AS neighbor, round(list_distance(a.c, b.c), 6) AS distance FROM cents a JOIN cents b
    ON a.label <> b.label WHERE a.label <> 0 AND b.label <> 0
    QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY list_distance(a.c, b.c), b.label) = 1""",
)
def _(t):
    rows = t("embeddings").withColumn("label", F.when(F.col("label") == 0, -1).otherwise(F.col("label")))
    return cl.cluster_neighbors(rows, "label", "embedding").withColumn("distance", r6("distance"))


def layers_sql(start, strict=False):
    """Words of each part type, cleaned, counted and ranked, then joined into layers of 5 to 2 words."""
    enough = "len(ws) >= 5" if strict else "len(ws) >= 1"
    layers = ", ".join(
        f"CASE WHEN {enough} THEN array_to_string(ws[1:{5 - i}], ', ') ELSE 'Unlabelled' END AS layer_{i}" for i in range(4)
    )
    return rf"""{TAGGED}, raw AS (SELECT p_size AS cluster, regexp_replace(unnest(string_split_regex(kept, '\s+|,\s*')), '[^a-zA-Z+#/]', '', 'g')
    AS w FROM tagged JOIN part USING (p_partkey)), counts AS (SELECT cluster, {LEMMA_SQL} AS word, count(*) AS n FROM raw
    WHERE length(w) >= 2 GROUP BY 1, 2), ranked AS (SELECT cluster, word, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, word)
    AS r FROM counts), top AS (SELECT cluster, list(word ORDER BY r) AS ws FROM ranked WHERE r BETWEEN {start + 1} AND {start + 5}
    GROUP BY 1), ids AS (SELECT unnest(generate_series(min(p_size), max(p_size))) AS cluster FROM part),
    layers AS (SELECT ids.cluster, {layers} FROM ids LEFT JOIN top ON top.cluster = ids.cluster)"""


def named_parts(t):
    return t("part").select("p_partkey", F.col("p_size").alias("soft_cluster"), F.col("p_name").alias("sentence_cleaned"))


LAYER_COLUMNS = "p_partkey, layer_0, layer_1, layer_2, layer_3"


@query("i12_name_clusters", f"WITH {layers_sql(0)} SELECT {LAYER_COLUMNS} FROM part JOIN layers ON p_size = cluster")
def _(t):
    named = nm.name_clusters(named_parts(t), "sentence_cleaned", lexicon=lexicon(t), lemmas=lemmas(t))
    return named.select("p_partkey", *nm.layer_names(5, 2))


@query("i12_cluster_layers_gaps", f"WITH {layers_sql(1)} SELECT CAST(cluster AS INTEGER) AS soft_cluster, layer_0, layer_3 FROM layers")
def _(t):
    options = {"start_from": 1, "lexicon": lexicon(t), "lemmas": lemmas(t), "fill_gaps": True}
    layers = nm.cluster_layers(named_parts(t), "soft_cluster", "sentence_cleaned", **options)
    return layers.select("soft_cluster", "layer_0", "layer_3")


@query("i13_strict_names", f"WITH {layers_sql(6, True)} SELECT CAST(cluster AS INTEGER) AS soft_cluster, layer_0, layer_3 FROM layers")
def _(t):
    options = {"start_from": 6, "lexicon": lexicon(t), "lemmas": lemmas(t), "strict": True, "fill_gaps": True}
    layers = nm.cluster_layers(named_parts(t), "soft_cluster", "sentence_cleaned", **options)
    return layers.select("soft_cluster", "layer_0", "layer_3")


@query(
    "i14_hierarchical_names",
    f"""WITH {layers_sql(0, True)} SELECT {LAYER_COLUMNS} FROM part JOIN (SELECT cluster, layer_0, layer_1, layer_2, layer_3 FROM layers)
    ON p_size = cluster""",
)
def _(t):
    options = {"lexicon": lexicon(t), "lemmas": lemmas(t)}
    named = nm.name_clusters_hierarchical(named_parts(t), "sentence_cleaned", **options)
    return named.select("p_partkey", *nm.layer_names(5, 2))


def silhouette_sql(distance):
    return f"""WITH d AS (SELECT a.vec_id, a.label, b.label AS other, avg(CASE WHEN a.vec_id <> b.vec_id THEN {distance} END) AS m
    FROM embeddings a JOIN embeddings b ON true GROUP BY 1, 2, 3), ab AS (SELECT vec_id, max(CASE WHEN label = other THEN m END) AS a,
    min(CASE WHEN label <> other THEN m END) AS b FROM d GROUP BY 1)
    SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM ab"""


DISTANCE = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("i15_silhouette", silhouette_sql(DISTANCE))
def _(t):
    return ql.silhouette(t("embeddings"), "vec_id", "embedding", "label").select(r6("silhouette").alias("silhouette"))


@query("i15_silhouette_cosine", silhouette_sql(f"1 - {COSINE}"))
def _(t):
    score = ql.silhouette(t("embeddings"), "vec_id", "embedding", "label", metric="cosine")
    return score.select(r6("silhouette").alias("silhouette"))


@query("i15_silhouette_squared", silhouette_sql(f"{DISTANCE} ** 2"))
def _(t):
    score = ql.silhouette(t("embeddings"), "vec_id", "embedding", "label", metric="sqeuclidean")
    return score.select(r6("silhouette").alias("silhouette"))


@query(
    "i16_calinski_harabasz",
    """WITH p AS (SELECT vec_id, label, unnest(generate_series(1, 64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
    c AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM p GROUP BY 1, 2), g AS (SELECT i, avg(x) AS m FROM p GROUP BY 1),
    b AS (SELECT sum(c.n * (c.m - g.m) ** 2) AS b, count(DISTINCT label) AS k FROM c JOIN g USING (i)),
    w AS (SELECT sum((x - m) ** 2) AS w, count(DISTINCT vec_id) AS n FROM p JOIN c USING (label, i))
    SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b JOIN w ON true""",
)
def _(t):
    score = ql.calinski_harabasz(t("embeddings"), "vec_id", "embedding", "label")
    return score.select(r6("calinski_harabasz").alias("calinski_harabasz"))


@query(
    "i17_davies_bouldin",
    f"""WITH {CENTROIDS}, s AS (SELECT label, avg(list_distance({DOUBLES}, c)) AS s FROM embeddings JOIN cents USING (label) GROUP BY 1)
    SELECT round(avg(worst), 6) AS davies_bouldin FROM (SELECT a.label, max((x.s + y.s) / list_distance(a.c, b.c)) AS worst
    FROM cents a JOIN cents b ON a.label <> b.label JOIN s x ON x.label = a.label JOIN s y ON y.label = b.label GROUP BY 1)""",
)
def _(t):
    score = ql.davies_bouldin(t("embeddings"), "vec_id", "embedding", "label")
    return score.select(r6("davies_bouldin").alias("davies_bouldin"))


@query(
    "i18_density_validity",
    f"""WITH RECURSIVE d AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS ci, b.label AS cj, {DISTANCE} AS d
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    core AS MATERIALIZED (SELECT i, d AS core FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d) = 2),
    e AS MATERIALIZED (SELECT d.i, d.j, ci, cj, greatest(d, x.core, y.core) AS w FROM d JOIN core x ON x.i = d.i JOIN core y ON y.i = d.j),
    tree(cluster, joined, longest) AS (SELECT label, [min(vec_id)], 0.0::DOUBLE FROM embeddings GROUP BY 1 UNION ALL
    SELECT cluster, list_append(any_value(joined), arg_min(e.j, w)), greatest(any_value(longest), min(w)) FROM tree JOIN e
    ON ci = cluster AND cj = cluster AND list_contains(joined, e.i) AND NOT list_contains(joined, e.j) GROUP BY cluster),
    loose AS (SELECT cluster, max(longest) AS loose, max(len(joined)) AS n FROM tree GROUP BY 1),
    gap AS (SELECT ci AS cluster, min(w) AS apart FROM e WHERE ci <> cj GROUP BY 1)
    SELECT round(sum(n * (apart - loose) / greatest(apart, loose)) / (SELECT count(*) FROM embeddings), 6) AS density_validity
    FROM loose JOIN gap USING (cluster)""",
)
def _(t):
    score = ql.density_validity(t("embeddings"), "vec_id", "embedding", "label")
    return score.select(r6("density_validity").alias("density_validity"))


@query(
    "i19_map_points",
    """WITH l AS (SELECT p_type, min(p_name) AS a, max(p_name) AS b, count(*) || ' parts' AS c FROM part GROUP BY 1),
    r AS (SELECT p_partkey, p_name, p_brand, label AS cluster, count(*) OVER (PARTITION BY p_name) AS marker_size,
    abs(embedding[2]) >= 0.05 AS sure, a, b, c FROM part JOIN embeddings ON p_partkey = vec_id JOIN l USING (p_type))
    SELECT p_partkey, p_name AS sentence, p_brand, cluster, marker_size, CASE WHEN sure THEN upper(a[1]) ||
    regexp_extract(a, '^.([a-z]*) ', 1) || ' ' || upper(string_split(a, ' ')[2][1]) || string_split(a, ' ')[2][2:] ELSE 'Unlabelled' END AS layer_0,
    upper(b[1]) || string_split(b, ' ')[1][2:] || ' ' || upper(string_split(b, ' ')[2][1]) || string_split(b, ' ')[2][2:] AS layer_1,
    replace(c, 'parts', 'Parts') AS layer_2 FROM r""",
)
def _(t):
    label = F.concat(F.count("*").cast("string"), F.lit(" parts"))
    labels = t("part").groupBy("p_type").agg(F.min("p_name").alias("layer_0"), F.max("p_name").alias("layer_1"), label.alias("layer_2"))
    points = attach(titles(t).filter("label is not null"), labels, "p_type")
    points = points.withColumns({"prob": F.abs(F.col("embedding")[1].cast("double")), "sentence": F.col("p_name"), "cluster": F.col("label")})
    return map_points(points, ["layer_0", "layer_1", "layer_2"], prob="prob", min_prob=0.05, keep=["p_partkey", "p_brand", "cluster"])
