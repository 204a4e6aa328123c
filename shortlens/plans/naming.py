"""Names for clusters from their most frequent words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shortlens.functions.text import word_chars, words
from shortlens.operators.filters import UNLABELLED
from shortlens.operators.joins import missing_ids
from shortlens.operators.ranking import first_n, top_words
from shortlens.operators.sets import supplement
from shortlens.runtime import settle


def keep_pos(df: DataFrame, column: str, lexicon: DataFrame, tags: Sequence[str] = ("N",)) -> DataFrame:
    """Keep the words whose part of speech starts with one of the tags; a sentence without any stays whole.

    `lexicon` is (word, pos). Each distinct sentence is tagged once, then joined back.
    """
    sentences = df.select(column).filter(F.col(column).isNotNull()).distinct()
    wanted = lexicon.filter(F.left("pos", F.lit(1)).isin([t[0] for t in tags])).select(F.col("word").alias("_word")).distinct()
    parts = sentences.select(column, F.posexplode(F.split(column, r"\s+")).alias("_at", "_word"))
    kept = parts.join(wanted, "_word").groupBy(column).agg(F.sort_array(F.collect_list(F.struct("_at", "_word"))).alias("_kept"))
    text = F.array_join(F.transform("_kept", lambda w: w["_word"]), " ")
    return df.join(kept.select(column, text.alias("_text")), column, "left").select(
        *[F.coalesce("_text", F.col(c)).alias(c) if c == column else F.col(c) for c in df.columns]
    )


def lemmatize(df: DataFrame, column: str, lemmas: DataFrame) -> DataFrame:
    """Replace a word by its lemma from (word, lemma); an unknown word stays."""
    table = lemmas.select(F.col("word").alias(column), F.col("lemma").alias("_lemma"))
    return df.join(table, column, "left").select(
        *[F.coalesce("_lemma", F.col(c)).alias(c) if c == column else F.col(c) for c in df.columns]
    )


def cluster_words(
    df: DataFrame,
    cluster: str,
    sentence: str,
    min_word_len: int = 2,
    lexicon: DataFrame | None = None,
    lemmas: DataFrame | None = None,
) -> DataFrame:
    """(cluster, word, n): how often each word occurs in a cluster's sentences; cleaned, long enough, lemmatised.

    Equal sentences of a cluster are counted before they are taken apart, and words before they look up their lemma.
    """
    sentences = df.groupBy(cluster, sentence).agg(F.count("*").alias("_times"))
    tagged = sentences if lexicon is None else keep_pos(sentences, sentence, lexicon)
    found = words(tagged, sentence).withColumn("word", word_chars(F.col("word")))
    found = found.filter(F.length("word") >= min_word_len).groupBy(cluster, "word").agg(F.sum("_times").alias("n"))
    return found if lemmas is None else lemmatize(found, "word", lemmas)


def _ranked_words(ranked: DataFrame, cluster: str) -> DataFrame:
    """(cluster, words): at most a handful of ranked words per cluster, in rank order."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "word")))
    return ranked.groupBy(cluster).agg(F.transform(listed, lambda w: w["word"]).alias("words"))


def layer_names(max_: int, min_: int) -> list[str]:
    return [f"layer_{i}" for i in range(max_ - min_ + 1)]


def cluster_layers(
    df: DataFrame,
    cluster: str,
    sentence: str,
    min_: int = 2,
    max_: int = 5,
    min_word_len: int = 2,
    start_from: int = 0,
    lexicon: DataFrame | None = None,
    lemmas: DataFrame | None = None,
    strict: bool = False,
    fill_gaps: bool = False,
) -> DataFrame:
    """(cluster, layer_0 …): layer i joins the first `max_ - i` words; clusters without words are Unlabelled.

    With `strict`, a cluster with fewer than `max_ + start_from` words is Unlabelled as well. `fill_gaps` adds a row for
    every id between the smallest and the largest cluster; it is meant for dense integer ids.
    """
    counted = cluster_words(df, cluster, sentence, min_word_len, lexicon, lemmas)
    named = settle(_ranked_words(top_words(counted, cluster, "word", max_, start_from, "n"), cluster))
    if strict:
        named = named.withColumn("words", F.when(F.size("words") >= max_, F.col("words")).otherwise(F.array(F.lit(UNLABELLED))))
    wordless = df.select(cluster).distinct().join(named.select(cluster), cluster, "left_anti")
    if fill_gaps:
        wordless = wordless.unionByName(missing_ids(df, cluster))
    full = supplement(named, wordless, cluster, "words")
    layers = [F.array_join(first_n(F.col("words"), max_ - i), ", ").alias(f"layer_{i}") for i in range(max_ - min_ + 1)]
    return full.select(cluster, *layers)


def name_clusters(df: DataFrame, sentence: str, soft: bool = True, cluster: str | None = None, **options) -> DataFrame:
    """df plus the name layers of each point's cluster."""
    cluster = cluster or ("soft_cluster" if soft else "cluster")
    return df.join(cluster_layers(df, cluster, sentence, **options), cluster, "left")


def hierarchical_layers(
    df: DataFrame, cluster: str, sentence: str, min_: int = 2, max_: int = 5, start_from: int = 0, **options
) -> DataFrame:
    """(cluster, layer_0 …): after the first layer, clusters of one label are regrouped and named again from its words.

    Layer i counts the words of layer i - 1 over the clusters that carry it, and keeps `max_ - i` of them when there are
    at least `max_ + start_from - i`, else the old label. Equal counts keep the order the words have in the label.
    """
    first = cluster_layers(df, cluster, sentence, max_, max_, start_from=start_from, strict=True, **options)
    table = settle(first)
    for i in range(1, max_ - min_ + 1):
        label = f"layer_{i - 1}"
        # All clusters of a label share the same words, so counts follow from the label and its number of clusters.
        labels = table.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_clusters"))
        parts = labels.select(label, "_clusters", F.posexplode(F.split(label, r"\s+|,\s*")).alias("_at", "word"))
        counts = parts.groupBy(label, "word").agg(
            (F.count("*") * F.first("_clusters")).alias("count"), F.min("_at").alias("_at")
        )
        order = Window.partitionBy(label).orderBy(F.desc("count"), "_at")
        ranked = counts.withColumn("rank", F.row_number().over(order))
        words_ = _ranked_words(ranked, label)
        kept = F.slice("words", start_from + 1, max_ - i)
        enough = F.size("words") >= max_ + start_from - i
        named = words_.select(label, F.when(enough, F.array_join(kept, ", ")).otherwise(F.col(label)).alias(f"layer_{i}"))
        table = settle(table.join(named, label, "left"))
    return table.select(cluster, *layer_names(max_, min_))


def name_clusters_hierarchical(df: DataFrame, sentence: str, soft: bool = True, cluster: str | None = None, **options) -> DataFrame:
    cluster = cluster or ("soft_cluster" if soft else "cluster")
    return df.join(hierarchical_layers(df, cluster, sentence, **options), cluster, "left")
