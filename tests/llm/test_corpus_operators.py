"""Packing, sharding, Jaccard join, URL filters, chats and the pipeline."""

import itertools
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from oracle import compare, database
from pyspark.sql import functions as F
from shortlens.llm import catalog, chat, jaccard, packing, shards, toxicity, urls
from tokenizers import Tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_packing_is_a_round_trip(documents, odd_documents):
    odd = odd_documents.select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    table = documents.select("doc_id", "text").unionByName(odd)
    pieces = packing.pack(table, WORDS).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    expected = sorted(tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + (2,) for r in table.collect())
    assert sum(p["length"] for p in pieces) == sum(map(len, expected))
    by_doc = {}
    for p in pieces:
        assert len(p["ids"]) == p["length"] > 0
        by_doc.setdefault(p["doc_id"], []).append((p["start"], tuple(p["ids"]), p["doc_tokens"]))
    wanted = {r["doc_id"]: tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + (2,) for r in table.collect()}
    for doc, parts in by_doc.items():
        copies = sum(p[2] for p in parts if p[0] == 0) // len(wanted[doc])
        joined = sorted(set((s, ids) for s, ids, _ in parts))
        assert tuple(itertools.chain.from_iterable(ids for _, ids in joined)) == wanted[doc] and copies >= 1
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    filled = sum(p["length"] for p in pieces) / (len(sequences) * packing.CAPACITY)
    assert filled > 0.9
    assert packing.pack(table.limit(0), WORDS).count() == 0


def test_odd_words_are_encoded_as_in_their_text():
    tokenizer, words = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS)
    texts = ["It's O'Neil's don't-do..it ÀÉ ß İstanbul ΑΣ ΟΔΟΣ a\u00a0b c\u2003d e\u0301 1234 x_y <|endoftext|> ﬁn 中文字 \x1c\x85z ,,,!? word.,word's", "", "   "]
    texts += ["".join(np.random.default_rng(k).choice(list("abcßéÀ'., 12\n\t-s\u0301"), 300)) for k in range(40)]
    for text, ids in zip(texts, words.encode([t.encode() for t in texts])):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_differencing_is_even():
    sizes = np.random.default_rng(2).integers(1, 4000, 400)
    load = np.bincount(packing.differencing(sizes, 40), sizes, 40)
    assert load.max() - load.min() < 0.03 * load.mean()
    assert packing.differencing(np.array([5]), 3).tolist() == [0] and len(packing.differencing(np.array([], int), 2)) == 0
    assert np.bincount(packing.pack_rests(np.array([4000, 4000, 200]), 4096), [4000, 4000, 200]).max() <= 4096


def test_shards(documents, odd_documents, tmp_path, spark):
    table = documents.select("doc_id", "text").unionByName(odd_documents.select("doc_id", "text").filter("length(coalesce(text, '')) < 1000"))
    path = str(tmp_path / "map")
    rows = shards.shard(table, map_path=path).collect()
    assert len(rows) == table.count()
    texts = {}
    for r in table.collect():
        texts.setdefault(r["doc_id"], set()).add((len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())))
    load, slots = [0] * 8, {}
    for r in rows:
        assert (r["size"], r["text_crc32"]) in texts[r["doc_id"]]
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load) - min(load) <= 0.05 * sum(load) / 8
    assert {r["map_version"] for r in rows} == {1} and shards.latest_version(spark, path) == 1
    before, after = shards.load_map(spark, path, 0), shards.load_map(spark, path, 1)
    assert before == shards.first_map(shards.SLOTS, 8) and all(r["shard"] == after[r["virtual_slot"]] for r in rows)
    assert shards.shard(table.limit(0)).count() == 0


def test_a_stored_map_is_edited_run_after_run(documents, tmp_path, spark):
    path = str(tmp_path / "map")
    table = documents.select("doc_id", "text")
    some = table.filter("doc_id % 3 <> 0")
    shards.shard(some, map_path=path, slots=512).collect()
    first = shards.load_map(spark, path, 1)
    again = shards.shard(some, map_path=path, slots=512)
    assert {r["map_version"] for r in again.collect()} == {1} and shards.latest_version(spark, path) == 1
    all_rows = shards.shard(table, map_path=path, slots=512, most_moved=20).collect()
    second = shards.load_map(spark, path, 2)
    assert 0 < sum(a != b for a, b in zip(first, second)) <= 20 and shards.load_map(spark, path, 1) == first
    assert all(r["map_version"] == 2 and r["shard"] == second[r["virtual_slot"]] for r in all_rows)
    grown = shards.shard(table, 9, map_path=path, slots=512).collect()
    third = shards.load_map(spark, path, 3)
    moved = [(a, b) for a, b in zip(second, third) if a != b]
    assert any(b == 8 for _, b in moved) and len(moved) < 100
    load = np.bincount([r["shard"] for r in grown], [r["size"] for r in grown], 9)
    biggest = max(np.bincount([r["virtual_slot"] for r in grown], [r["size"] for r in grown]))
    assert load.max() - load.min() <= max(0.05 * load.mean(), biggest)
    fewer = {r["shard"] for r in shards.shard(table, 5, map_path=path, slots=512).collect()}
    assert fewer == set(range(5)) and shards.load_map(spark, path, 2) == second
    with pytest.raises(ValueError, match="slots"):
        shards.shard(table, map_path=path, slots=256)


def test_a_tolerance_leaves_slots_where_they_are():
    sizes = np.random.default_rng(2).integers(1, 100, 400).tolist()
    even = shards.rebalance(shards.first_map(400, 4), sizes, 4)
    changed = [size + (slot % 7 == 0) for slot, size in enumerate(sizes)]
    assert shards.rebalance(even, changed, 4, tolerance=0.05) == even
    gone = shards.rebalance(even, sizes, 3)
    assert set(gone) == {0, 1, 2} and sum(a != b for a, b in zip(even, gone) if a != 3) <= 10


def test_growing_moves_slots_only_into_the_new_shard():
    sizes = np.random.default_rng(1).integers(1, 100, 400).tolist()
    even = shards.rebalance(shards.first_map(400, 4), sizes, 4)
    grown = shards.rebalance(even, sizes, 5)
    moved = [(a, b) for a, b in zip(even, grown) if a != b]
    assert moved and sum(b == 4 for _, b in moved) >= 0.9 * len(moved)
    load = np.bincount(grown, sizes, 5)
    assert load.max() - load.min() <= 2


def plain_links(texts):
    sets = {}
    for i, text in texts.items():
        words = (text or "").encode().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return {
        (a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    }


def classes_of(ids, links):
    head = {i: i for i in ids}
    for _ in ids:
        new = dict(head)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == head:
            break
        head = new
    return head


def test_jaccard_join_links_what_brute_force_links(spark):
    rng = np.random.default_rng(4)
    texts = {}
    for group in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(6, 200)))]
        for copy in range(int(rng.integers(1, 6))):
            edited = list(words)
            for at in rng.integers(0, len(words), int(rng.integers(0, 1 + len(words) // 40))):
                edited[at] = f"e{copy}_{at}"
            texts[len(texts)] = " ".join(edited)
    passage = " ".join(f"p{k}" for k in range(60))
    for k in range(300):  # a passage that many texts share does not link them
        texts[len(texts)] = passage + " " + " ".join(f"q{k}_{j}" for j in range(60))
    clump = [f"c{j}" for j in range(200)]
    for k in range(150):  # a large group of near copies
        texts[len(texts)] = " ".join(clump[:k] + [f"x{k}"] + clump[k + 1 :])
    texts |= {len(texts): None, len(texts) + 1: "", len(texts) + 2: "two words", len(texts) + 3: "two words"}
    table = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id bigint, text string, class_id string")
    links = plain_links(texts)
    count = {i: 0 for i in texts}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    rows = jaccard.jaccard_join(table).collect()
    assert len(rows) == len(texts) and len(links) > 5000
    assert {r["doc_id"]: r["n_links"] for r in rows} == count
    assert {r["doc_id"]: r["class_id"] for r in rows} == classes_of(texts, links)
    kept = jaccard.keep_one(table)
    assert kept.columns == table.columns
    blank = {i for i, t in texts.items() if not (t or "").strip()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes_of(texts, links).values()) | blank)


def test_stages_take_tables_whose_columns_have_inner_names(spark, documents, folder):
    """Names that operators use inside, in upper and lower case, are kept with their values."""
    import corpus_pipeline

    names = ["added", "Added_", "toxic", "_id", "_head", "_HEAD_KEY", "_text_key", "_estimate", "_Cell_of", "_quality", "_pii_spans", "_pii_spans_email",
             "_pii_all", "_pii_flat", "_pii_added", "_matches", "_pieces", "key", "node", "cell"]
    docs = documents.filter("doc_id < 60").select("*", *[F.concat(F.lit(f"{name} "), "doc_id").alias(name) for name in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in names), name
    assert toxicity.sample_labelled(docs, spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", "text", "toxic").columns == ["text", "toxic"]


def test_jaccard_join_on_odd_tables(spark, odd_documents):
    rows = jaccard.jaccard_join(odd_documents).collect()
    assert len(rows) == 10
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[6]["class_id"] == 5 and by_id[6]["n_links"] == 1 and by_id[None]["n_copies"] == 2 and by_id[None]["class_id"] is None
    assert by_id[1]["class_id"] == 1 and by_id[1]["n_links"] == 0 and by_id[3]["class_id"] == 3
    kept = jaccard.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns and kept.count() == 7
    assert jaccard.jaccard_join(odd_documents.limit(0)).count() == 0 and jaccard.keep_one(odd_documents.limit(0)).count() == 0


def test_jaccard_matches_sql(spark, folder):
    assert compare(catalog.QUERIES["op10_ngram_jaccard"](spark, folder), database(folder), catalog.SQL["op10_ngram_jaccard"]) == ""


def plain_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for verdict, rule in catalog.URL_RULES:
        own, _, own_path = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + own_path) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_url_rules(spark):
    made = [None, "", "no scheme/a", "http://", "HTTP://A.Example.ORG/en/1?x", "https://example.org", "https://example.org/es/a#b", "http://É.com/de/", "x://y://z.com/fr/1", "http://org/", "http://a.org?q=/es/", "http://example.org/en/12\nsecond"]
    hosts = ["www.example.org", "example.org", "a.com", "b.net", "badorg"]
    made += [f"http://{h}{p}" for h in hosts for p in ("", "/", "/es/1", "/en/1", "/en/2", "/de/3?a=b&c=d", "/fr/x.html")]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(made)] + [(0, None, "x")], "page_id bigint, url string, token string")
    labels = spark.createDataFrame([], "page_id bigint, bad boolean")
    rows = urls.filter_urls(pages, labels, catalog.URL_RULES).collect()
    assert len(rows) == len(made) + 1
    for r in rows:
        host, path, best = plain_rule(made[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best and best[1], best[0] if best else "allow")
    assert urls.filter_urls(pages.limit(0), labels, catalog.URL_RULES).count() == 0


def test_mined_url_rules_equal_counting(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(2000):
        host, folder, ext = f"h{rng.integers(6)}.com", ["a", "b", "c"][rng.integers(3)], ["html", "php"][rng.integers(2)]
        bad = bool(rng.random() < (0.95 if host == "h1.com" and folder == "b" else 0.05))
        rows.append((k, f"http://{host}/{folder}/{k}.{ext}", bad if k % 2 else None))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id bigint, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "page_id bigint, bad boolean")
    got = {r["page_id"]: r["mined"] for r in urls.filter_urls(pages, labels, [], min_rows=20).collect()}
    listed = pages.withColumn("t", urls.tokens_of(F.col("url"), urls.host_of(F.col("url")), urls.path_of(F.col("url")))).collect()
    tokens_of = {r["page_id"]: r["t"] for r in listed}
    count, bad_count = {}, {}
    for k, _, bad in rows:
        if bad is None:
            continue
        for n in range(1, len(tokens_of[k]) + 1):
            for items in itertools.combinations(sorted(tokens_of[k]), n):
                count[items] = count.get(items, 0) + 1
                bad_count[items] = bad_count.get(items, 0) + bad
    rules = [set(i) for i, n in bad_count.items() if n >= 20 and n / count[i] >= urls.MIN_CONFIDENCE]
    assert rules
    assert got == {k: any(r <= set(t) for r in rules) for k, t in tokens_of.items()}
    items = urls.items_of(F.col("url"), urls.host_of(F.col("url")), urls.path_of(F.col("url")))
    known = pages.select("page_id", items.alias("items")).join(labels.filter("bad is not null"), "page_id").select("items", "bad")
    mined = urls.mine_rules(known, min_rows=20)[0].collect()
    assert mined
    for r in mined:
        key = tuple(sorted(r["items"]))
        share = sum(bool(bad) for _, _, bad in rows) / sum(bad is not None for _, _, bad in rows)
        assert r["support"] == bad_count[key] and abs(r["confidence"] - bad_count[key] / count[key]) < 1e-12
        assert abs(r["lift"] - r["confidence"] / share) < 1e-9
        assert not any(set(other["items"]) < set(key) for other in mined)


def test_mined_url_rules_add_up_hosts_words_and_deep_folders(spark):
    rows = []
    for k in range(600):
        rows.append((f"http://{['www', 'm', 'blog'][k % 3]}.good{k % 7}.example.com/en/{k % 5}/x{k}.html", False))
    for k in range(60):  # twelve hosts of one bad site, twelve sites with a word, five folders below many
        rows.append((f"http://h{k % 12}.casino-win.example.com/en/{k}", True))
        rows.append((f"http://a.my-poker{k % 2}-s{k % 12}-pills.example.com/en/{k}", True))
        rows.append((f"http://www.good{k % 7}.example.com/en/a{k % 5}/warez/y{k}", True))
    fresh = ["http://new.casino-win.example.com/de/1", "https://x.cheap-pills.example.com/", "http://other.example.net/fr/q/warez/z", "http://new.good1.example.com/en/2/x"]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)] + [(1000 + k, u) for k, u in enumerate(fresh)], "page_id bigint, url string")
    labels = spark.createDataFrame([(k, bad) for k, (_, bad) in enumerate(rows)], "page_id bigint, bad boolean")
    got = {r["page_id"]: r["mined"] for r in urls.filter_urls(pages, labels, []).collect()}
    assert [got[1000 + k] for k in range(len(fresh))] == [True, True, True, False]
    assert all(got[k] == bad for k, (_, bad) in enumerate(rows))


def test_long_chats_are_decoded_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 3)
    rng = np.random.default_rng(6)
    model, rows, truth = chat.default_model(), [], {}
    for conv in range(4):
        for turn in range([1, 7, 30, 40][conv]):
            role = "user" if turn % 2 == 0 else "assistant"
            mark = {0: f"{role}: ", 1: "", 2: f"### {role}\n"}[int(rng.integers(3)) if turn else 0]
            rows.append((conv, turn, f"{mark}some words of a turn{'?' if role == 'user' else '.'}\nand a second line\n", "x"))
            truth[conv, turn] = role
    table = spark.createDataFrame(rows, "conv_id bigint, seq bigint, text string, pos string").drop("pos")
    out = {(r["conv_id"], r["seq"]): r for r in chat.format_chats(table, model).collect()}
    assert set(out) == set(truth)
    right = sum(out[k]["roles"][0] == role for k, role in truth.items())
    assert right >= 0.97 * len(truth)
    placed = chat.positioned(table, "conv_id", "seq", ["text"])
    borders = {(r["conv"], r["pos"]): r for r in chat.decode(placed, model).collect()}
    texts = {(r["conv"], r["pos"]): r["text"] for r in placed.collect()}
    gaps = {(r["conv"], r["pos"]): r["gap"] for r in placed.collect()}
    for conv in {c for c, _ in texts}:
        n = max(p for c, p in texts if c == conv) + 1
        states = [borders[conv, p]["after"] for p in range(n)]
        assert [borders[conv, p]["before"] for p in range(1, n)] == states[:-1]
        total = 0.0
        for p in range(n):
            table_p = chat._message_tables(model, [texts[conv, p]], [p == 0], [gaps[conv, p]])[0]
            total += table_p[borders[conv, p]["before"] if p else 0, states[p]]
        # Pieces are decoded one after another; the best score over all lines is that of the plain recursion.
        per_line = [(k == 0 and p == 0, line) for p in range(n) for k, line in enumerate(chat._lines_of(texts[conv, p]))]
        emissions = np.concatenate([model.lines(chat.features(chat._lines_of(texts[conv, p]), p == 0, gaps[conv, p])) for p in range(n)])
        score = model.begin + emissions[0]
        for emission in emissions[1:]:
            score = (score[:, None] + model.step + emission[None, :]).max(0)
        assert len(per_line) == len(emissions) and abs(score.max() - total) < 1e-6


def shown_texts(spark, conversations, model=None):
    """(the whole canonical form, (role, lines) of its turns) of each conversation given as texts of its rows."""
    rows = [(c, i, text) for c, texts in enumerate(conversations) for i, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "conv_id bigint, seq bigint, text string")
    pieces = sorted(chat.format_chats(table, model).collect(), key=lambda r: (r["conv_id"], r["pos"]))
    shown = []
    for _, group in itertools.groupby(pieces, key=lambda r: r["conv_id"]):
        out, turns = "".join(r["rendered"] for r in group), []
        for line in out.split("\n"):
            opened = [role for role in chat.ROLES if line.startswith(f"<|{role}|>")]
            if opened:
                turns.append((opened[0], []))
                assert line.removeprefix(f"<|{opened[0]}|>") in ("", "<|end|>")
            else:
                turns[-1][1].append(chat.unescape(line.removesuffix("<|end|>")))
        shown.append((out, turns))
    return shown


PROBED = [
    (
        "User: hello\nAssistant: hi, how can I help\nUser: tell me a story\nAssistant: once upon a time",
        [("user", "hello"), ("assistant", "hi, how can I help"), ("user", "tell me a story"), ("assistant", "once upon a time")],
    ),
    (
        "User: which one is right?\nAssistant: choose between these\nA) one\nB) two\nUser: thanks",
        [("user", "which one is right?"), ("assistant", "choose between these\nA) one\nB) two"), ("user", "thanks")],
    ),
    (
        "User: what is six times seven?\nAssistant: Let me think about that for a moment.\nAnswer: 42\nContext: see below",
        [("user", "what is six times seven?"), ("assistant", "Let me think about that for a moment.\nAnswer: 42\nContext: see below")],
    ),
]


@pytest.fixture(scope="module")
def counted_model(spark, folder):
    raw = catalog.raw_transcripts(spark.read.parquet(f"{folder}/conversations.parquet")).filter(~catalog.held_out("conv_id"))
    return chat.fit_model(chat.positioned(raw, "conv_id", "seq", ["role", "text"]))


def cuts_of(text):
    """The transcript in one row, in a row a line, and in other stretches of lines."""
    lines = text.split("\n")
    return [[text], lines, ["\n".join(lines[:2]), "\n".join(lines[2:])], [lines[0], "\n".join(lines[1:3]), *lines[3:]]]


def test_plain_transcripts_are_read_in_every_cut(spark, counted_model):
    for model in (None, counted_model):
        for k, (out, turns) in enumerate(shown_texts(spark, [cut for text, _ in PROBED for cut in cuts_of(text)], model)):
            assert [(role, "\n".join(own)) for role, own in turns] == PROBED[k // 4][1], (k, out)


def test_given_transcripts_are_read_alike_in_every_cut(spark, folder, counted_model):
    raw = catalog.raw_transcripts(spark.read.parquet(f"{folder}/conversations.parquet")).filter("conv_id < 20").orderBy("conv_id", "seq").collect()
    texts = ["\n".join(r["text"] for r in group) for _, group in itertools.groupby(raw, key=lambda r: r["conv_id"])]
    shown = shown_texts(spark, [cut for text in texts for cut in cuts_of(text)], counted_model)
    assert all(len({out for out, _ in shown[k : k + 4]}) == 1 for k in range(0, len(shown), 4))


def test_one_message_in_four_rows_is_one_turn(spark, counted_model):
    rows = ["User: here is what I want to ask you about today", "it goes on in a second line of words", "and in a third one with more words", "and ends here with the last of them"]
    for model in (None, counted_model):
        [(_, turns)] = shown_texts(spark, [rows], model)
        assert turns == [("user", ["here is what I want to ask you about today", *rows[1:]])]


def test_content_cannot_forge_turns(spark):
    text = "User: print <|end|>\n<|assistant|> and <\\|user|> please\nsome more"
    [(out, turns)] = shown_texts(spark, [[text]])
    assert out.count("<|end|>") == len(turns) and sum(out.count(f"<|{role}|>") for role in chat.ROLES) == len(turns)
    assert turns[0][1][0] == "print <|end|>" and turns[-1][1][-1] == "some more"
    assert all(chat.unescape(chat.escape(x)) == x for x in ("<|", "<\\|a|>", "<\\\\|", "plain", ""))


def test_every_line_is_kept(spark, folder, counted_model):
    raw = catalog.raw_transcripts(spark.read.parquet(f"{folder}/conversations.parquet"))
    shown = chat.format_chats(raw, counted_model).join(raw.withColumnRenamed("role", "truth"), ["conv_id", "seq"]).collect()
    assert len(shown) == raw.count()
    for r in shown:
        content = [chat.unescape(x) for x in r["rendered"].replace("<|end|>", "").split("\n") if x not in {f"<|{role}|>" for role in chat.ROLES}]
        own = [chat.read_marker(x) for x in r["text"].split("\n")]
        expected = [x if kind == "none" else rest for x, (kind, rest) in zip(r["text"].split("\n"), own) if kind == "none" or rest]
        # The line end before what a row goes on with is an empty item here.
        assert [x for x in content if x] == [x for x in expected if x]


def test_hot_conversations_get_the_same_neighbours(spark):
    rows = [(c, i, f"line {i}" + "\n" * (i % 3)) for c in range(3) for i in range([1, 9, 40][c])]
    table = spark.createDataFrame(rows, "conv_id bigint, seq bigint, text string")
    columns = ["conv_id", "seq", "pos", "gap", "last", "text"]
    plain = chat.positioned(table, "conv_id", "seq", ["text"]).select(columns).collect()
    assert sorted(plain) == sorted(chat.positioned(table, "conv_id", "seq", ["text"], hot_rows=5).select(columns).collect())
    assert all(r["gap"] == (r["pos"] > 0 and (r["seq"] - 1) % 3 > 0) and r["last"] == (r["pos"] == [0, 8, 39][r["conv_id"]]) for r in plain)


def test_markers():
    assert chat.read_marker("A) first option")[0] == "assistant?" and chat.read_marker("Answer: 42")[0] == "assistant?"
    assert chat.read_marker("you")[0] == "user?" and chat.read_marker("Q: why")[0] == "user"
    assert chat.marker("User: hello") == ("user", "hello")
    assert chat.marker("### Assistant:") == ("assistant", "")
    assert chat.marker("<|im_start|>system") == ("system", "")
    assert chat.marker("**Human:** hi") == ("user", "hi")
    assert chat.marker("a user said: x")[0] == "none"


def test_chats_on_odd_tables(spark):
    rows = [(None, 0, "User: a"), (None, 0, "User: a"), (1, None, None), (1, 1, ""), (1, 1, "Assistant: b"), (2, 0, "x" * 50_000)]
    table = spark.createDataFrame(rows, "conv_id bigint, seq bigint, text string")
    out = chat.format_chats(table).collect()
    assert len(out) == 6 and sorted(r["pos"] for r in out if r["conv_id"] == 1) == [0, 1, 2]
    assert all(r["pos"] == 0 for r in out if r["conv_id"] is None)
    assert chat.format_chats(table.limit(0)).count() == 0
    assert chat.fit_model(chat.positioned(table.limit(0).withColumn("role", F.lit("user")), "conv_id", "seq", ["role", "text"])).step.shape == (6, 6)


def test_chat_query_recovers_roles(spark, folder):
    out = catalog.QUERIES["op1_chat_formatting"](spark, folder)
    truth = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", F.col("turn").alias("seq"), "role")
    right = F.avg((F.col("roles") == F.array("role")).cast("int"))
    unseen, n = out.join(truth, ["conv_id", "seq"]).agg(F.avg(F.when(catalog.held_out("conv_id"), (F.col("roles") == F.array("role")).cast("int"))), F.count("*")).first()
    assert n == truth.count() and unseen > 0.95
    by_style = out.join(truth, ["conv_id", "seq"]).filter(catalog.held_out("conv_id")).groupBy(F.pmod("conv_id", F.lit(4))).agg(right.alias("right")).collect()
    assert all(r["right"] > 0.9 for r in by_style)


def test_pipeline(spark, folder, odd_documents):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.store(stage(spark, docs, folder), name)
        assert docs.columns == before.columns
        assert docs.count() <= before.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not plain_links(texts)
    pieces = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(texts)
    assert os.path.basename(folder) == "sf0.001"


@pytest.mark.parametrize("name", ["op3_url_filters", "op4_packing", "op9_sharding"])
def test_queries_run(spark, folder, name):
    assert catalog.QUERIES[name](spark, folder).count() > 0
