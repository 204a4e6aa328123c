"""Ranked search, compression classifier and collocations against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from shortlens.llm import catalog, compression, phrases, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k=10):
    """docs: (doc_id, text); items: (item_id, text) -> (item_id, rank, doc_id, score)."""
    counted = [(i, Counter(TERM.findall((t or "").translate(CAPITALS)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total, df = len(counted), sum(sum(c.values()) for _, c in counted), Counter()
    for _, c in counted:
        df.update(c.keys())
    out = []
    for item, text in items:
        found = []
        for doc, c in counted:
            m = 10 + 90 * sum(c.values()) * n // total
            score = 0
            for t in set(TERM.findall((text or "").translate(CAPITALS))) & c.keys():
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_docs, window", [(65_536, 8_192), (37, 8)])
def test_search_equals_brute_force(spark, documents, odd_documents, monkeypatch, shard_docs, window):
    monkeypatch.setattr(search, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(search, "WINDOW", window)
    monkeypatch.setattr(search, "BLOCK", 16)
    monkeypatch.setattr(search, "ITEMS", 7)
    docs = documents.select("doc_id", "text").unionByName(odd_documents.select("doc_id", "text")).coalesce(1)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    asked = [(i, rows[i * 9][1]) for i in range(12)] + [(None, "word1x1 TEXT with É"), (None, None), (5, "--"), (6, "The the THE short text"), (6, "The the THE short text")]
    items = spark.createDataFrame(asked, "item_id bigint, text string").withColumn("term", F.lit(1))
    got = search.search(search.build_index(docs.withColumn("shard", F.lit("x"))), items).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == plain_search(rows, asked)


def test_search_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert search.search(search.build_index(none), items).count() == 0
    index = search.build_index(spark.createDataFrame([(7, "a a c"), (8, None)], "doc_id bigint, text string"), path=str(tmp_path / "index"))
    assert search.search(index, items.limit(0)).count() == 0
    again = spark.read.schema(search.INDEX_TYPE).parquet(str(tmp_path / "index"))
    assert [(r["rank"], r["doc_id"]) for r in search.search(again, items).collect()] == [(1, 7)]


def test_blocks_are_turned_away_before_they_are_unpacked():
    """A common term's blocks stay packed where a rare term decides."""
    rng = np.random.default_rng(1)
    builder = search.ShardBuilder()
    for i in range(20_000):
        builder.add(i, b"common " * int(rng.integers(1, 3)) + b"pad " * 20 + (b"rare rare rare" if i % 1_000 == 7 else b"") + b" x%d" % (i % 50))
    rows = [r for b in builder.batches(0, search._arrow_schema()) for r in b.to_pandas().itertuples(index=False)]
    head = next(r for r in rows if r.term is None)
    m = 10 + 90 * np.asarray(head.lengths, np.int64) * 20_000 // int(head.total)
    lists = {r.term: search.PostingList(r, weight, m, 20_000, int(head.total)) for r in rows if r.term in (b"common", b"rare") for weight in [8_000 if r.term == b"rare" else 24]}
    docs, scores = search.search_shard(list(lists.values()), 20_000, 10)
    full = {t: dict(zip(*map(np.ndarray.tolist, one.between(0, 20_000)))) for t, one in ((t, search.PostingList(r, 8_000 if t == b"rare" else 24, m, 20_000, int(head.total))) for r in rows for t in [r.term] if t in lists)}
    expected = sorted(((-s - full[b"common"].get(d, 0), d) for d, s in full[b"rare"].items()))[:10]
    assert [(-s, d) for d, s in zip(docs.tolist(), scores.tolist())] == expected
    assert lists[b"common"].open.sum() < len(lists[b"common"].open) / 4


def test_compression_tells_held_out_texts_apart(spark):
    folder = "/root/testdata/sf0.01"
    scored = catalog.QUERIES["op12_quality_classifier"](spark, folder)
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out AND quality IS NOT NULL").collect()
    good = [r for r in rows if r["quality"] == 1]
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_compression_equals_plain_sizes(spark, documents, odd_documents):
    import zstandard

    labels = documents.select("doc_id", F.pmod("doc_id", F.lit(2)).cast("int").alias("quality"))
    model = compression.fit(documents, labels)
    assert model.good and model.bad
    compressors = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    table = odd_documents.withColumn("score", F.lit(1)).withColumn("good", F.lit(2))
    got = sorted((str(r["doc_id"]), r["score"]) for r in compression.score_quality(table, model).collect())
    wanted = []
    for r in table.collect():
        raw = (r["text"] or "").encode()
        sizes = [sum(len(c.compress(raw[at : at + 512])) for at in range(0, len(raw), 512)) for c in compressors]
        wanted.append((str(r["doc_id"]), float(model.probability(np.array([(sizes[1] - sizes[0]) / len(raw) if raw else 0.0]))[0])))
    assert [i for i, _ in got] == [i for i, _ in sorted(wanted)] and np.allclose([s for _, s in got], [s for _, s in sorted(wanted)])


def test_compression_without_labels(spark, odd_documents):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = compression.fit(odd_documents, none)
    assert {(r["score"], r["predicted"]) for r in compression.score_quality(odd_documents, model).collect()} == {(0.5, 1)}
    assert compression.score_quality(odd_documents.limit(0), model).count() == 0


def plain_collocations(docs, least, longest=5, top=2_000, covered=100):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(CAPITALS)):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                f.update((lang, tuple(ws[i : i + m])) for i in range(len(ws) - m + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = set()
    for (lang, ws), a in candidates.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                if 100 * a >= covered * f[lang, ws[i : i + m]]:
                    gone.add((lang, ws[i : i + m]))
    out = []
    for lang in n:
        rows = []
        for (own, ws), a in candidates.items():
            if own == lang and (own, ws) not in gone:
                score, k = min((1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws)))
                rows.append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"BURST": 4, "CAPACITY": 60, "KNOWN_WORDS": 300, "SLICE_BYTES": 2_000, "PART_BYTES": 20_000}])
def test_collocations_equal_brute_force(spark, documents, odd_documents, monkeypatch, options):
    tight = phrases.HashTrie.__init__
    for name, value in options.items():
        monkeypatch.setattr(phrases, name, value)
    if options:
        monkeypatch.setattr(phrases.HashTrie, "__init__", lambda self, length: tight(self, length, options["BURST"], options["CAPACITY"]))
    docs = documents.select("lang", "text").limit(120).unionByName(odd_documents.select("lang", "text"))
    got = phrases.collocations(docs.withColumn("phrase", F.lit("x")).withColumn("words", F.lit(1)), min_count=4, top=500, covered=90)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 4, top=500, covered=90)


def test_collocations_of_nothing(spark, odd_documents):
    assert phrases.collocations(odd_documents.limit(0)).count() == 0
    assert phrases.collocations(odd_documents.filter("text IS NULL")).count() == 0


def test_containers_burst_and_large_subtrees_leave():
    trie = phrases.HashTrie(3, burst=3, capacity=10)
    rng = np.random.default_rng(2)
    rows, counts = rng.integers(0, 4, (400, 3)).astype(np.int32), Counter()
    for at in range(0, 400, 40):
        trie.add(b"en", rows[at : at + 40])
        for lang, words in trie.overflow().items():
            out, n = trie.take(lang, words)
            counts.update(Counter({tuple(r): c for r, c in zip(out.tolist(), n.tolist())}))
        assert trie.entries <= 10
    for lang, words in trie.everything().items():
        out, n = trie.take(lang, words)
        counts.update(Counter({tuple(r): c for r, c in zip(out.tolist(), n.tolist())}))
    assert counts == Counter(map(tuple, rows.tolist())) and not trie.root and trie.entries == 0
