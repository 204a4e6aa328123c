"""The registered queries of these operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlens.llm import chat, compression, decontaminate, jaccard, packing, phrases, pii, quality, search, shards, tokens, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# (verdict, host and path): the written URL rules.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(key: str) -> Column:
    """A third of all keys, by which models are judged and from which they learn nothing."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """Turns as they stand in raw transcripts: one of four styles of marker for each conversation, one of them none at all,
    and an empty line behind each turn."""
    style, role = F.pmod("conv_id", F.lit(4)), F.col("role")
    lead = (
        F.when(style == 0, F.concat(F.initcap(role), F.lit(": ")))
        .when(style == 1, F.concat(F.lit("### "), F.when(role == "user", "Human").when(role == "assistant", "Assistant").otherwise("System"), F.lit(":\n")))
        .when((style == 2) & (F.pmod("turn", F.lit(3)) != 2), F.concat(F.lit("<|"), role, F.lit("|>\n")))
        .otherwise("")
    )
    text = F.concat(F.coalesce(lead, F.lit("")), F.coalesce("text", F.lit("")), F.lit("\n"))
    return conversations.select("conv_id", F.col("turn").alias("seq"), "role", text.alias("text"))


@query
def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Raw transcripts of all conversations in canonical form; the model is counted from those that are not held out."""
    raw = raw_transcripts(table(spark, folder, "conversations"))
    model = chat.fit_model(chat.positioned(raw.filter(~held_out("conv_id")), "conv_id", "seq", ["role", "text"]))
    return chat.format_chats(raw, model)


@query
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of every document."""
    return tokens.section_tokens(table(spark, folder, "documents"), BYTE_TOKENIZER, public_tokenizers.PATTERN)


@query
def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Written rules and mined ones over every page; a page carries the labels of the document its path names."""
    pages, labels = table(spark, folder, "pages"), table(spark, folder, "labels")
    document = F.regexp_extract(urls.path_of(F.coalesce("url", F.lit(""))), r"([0-9]{1,18})", 1)
    named = pages.select("page_id", F.when(document != "", document.cast("bigint")).alias("doc_id"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = named.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")
    return urls.filter_urls(pages, known, URL_RULES)


@query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), WORD_TOKENIZER, with_ids=False)


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document; labels are learned from rows that are not held out."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    grammar = toxicity.fit(docs, labels.filter(~held_out))
    return toxicity.score_toxicity(docs, grammar).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.span_strings(pii.find_pii(table(spark, folder, "documents")))


@query
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(table(spark, folder, "documents"))


@query
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents into eight shards of nearly equal bytes."""
    dealt = shards.shard(table(spark, folder, "documents"))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )


@query
def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


@query
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search.search(search.build_index(table(spark, folder, "documents")), table(spark, folder, "benchmark"))


@query
def op12_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document; labels are learned from rows that are not held out."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = compression.fit(docs, labels.filter(~held_out))
    return compression.score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


SQL["op10_ngram_jaccard"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gram FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b, c = na.n AND c = nb.n AS same FROM shared JOIN sizes na ON na.doc_id = a JOIN sizes nb ON nb.doc_id = b
  WHERE 10 * c >= 8 * (na.n + nb.n - c)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), classes AS (
  SELECT a, min(b) AS class_id FROM reach GROUP BY a
), counts AS (
  SELECT a, count(*) AS n_links, count(*) FILTER (WHERE same) AS same FROM links GROUP BY a
)
SELECT d.doc_id, c.class_id, coalesce(k.n_links, 0) AS n_links, 1 + coalesce(k.same, 0) AS n_copies
FROM documents d JOIN classes c ON c.a = d.doc_id LEFT JOIN counts k ON k.a = d.doc_id
"""

TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL["op11_ranked_search"] = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS d, doc_id, {TERMS.format("coalesce(text, '')")} AS ts FROM documents
), items AS MATERIALIZED (
  SELECT row_number() OVER () AS i, item_id, list_distinct({TERMS.format("coalesce(text, '')")}) AS ts FROM benchmark
), totals AS (
  SELECT count(*) AS N, CAST(sum(len(ts)) AS BIGINT) AS L FROM docs WHERE len(ts) > 0
), postings AS MATERIALIZED (
  SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(ts) AS t FROM docs) GROUP BY 1, 2
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(N) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY 1
), lengths AS (
  SELECT d, doc_id, 100 - 90 + (90 * len(ts) * N) // L AS m FROM docs, totals WHERE len(ts) > 0
), scores AS (
  SELECT i, item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM (SELECT i, item_id, unnest(ts) AS t FROM items) JOIN weights USING (t) JOIN postings USING (t) JOIN lengths USING (d) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
SQL["op13_collocations"] = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, ws FROM (
    SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM (
      SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents)) WHERE len(ws) > 0
), totals AS (
  SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM pieces GROUP BY 1
), f AS MATERIALIZED (
  SELECT lang, words, phrase, count(*) AS f FROM (
    SELECT lang, m AS words, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
    FROM pieces, range(1, 6) AS lengths(m) WHERE len(ws) >= m) GROUP BY 1, 2, 3 HAVING count(*) >= 100
), candidates AS MATERIALIZED (
  SELECT lang, phrase, f AS a, words, string_split(phrase, ' ') AS ws FROM f WHERE words >= 2
), inside AS (
  SELECT lang, unnest(list_transform(range(1, words - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase, a AS longer
  FROM candidates, range(2, 5) AS lengths(m) WHERE m < words
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY 1, 2) USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 100 * a
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest
  FROM kept, range(1, 5) AS cut(k) WHERE k < words
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, k, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score FROM weakest QUALIFY rank <= 2000
"""
