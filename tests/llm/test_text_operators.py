"""Quality rules, personal data, toxicity, decontamination, token counts: against brute force and on odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from shortlens.llm import catalog, decontaminate, pii, quality, tokens, toxicity


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + i for k, run in enumerate(runs) if runs.count(run) > 1 for i in range(5)} if len(runs) < 600 else None
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), None if covered is None else len(covered)


def test_quality_counts(documents, odd_documents):
    odd = odd_documents.select(F.col("doc_id") + 10_000, "text", "lang", "source").toDF("doc_id", "text", "lang", "source")
    both = documents.select("doc_id", "text", "lang", "source").unionByName(odd)
    rows = quality.quality_rules(both).join(both.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(rows) >= 200
    for r in rows:
        words, chars, symbols, dup, repeats = plain_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (words, chars, symbols, dup)
        if repeats is not None:
            assert r["n_repeat_words"] == repeats
        assert r["base_failed"] == (words < 10 or 100 * r["n_repeat_words"] > 20 * words)
        assert not (r["base_failed"] and r["kept"])


def test_quality_estimate_finds_outliers_in_each_cell(spark):
    rng = np.random.default_rng(5)
    rows, bad = [], set()
    for i in range(1200):
        centre = 0.0 if i % 2 else 5.0
        x = rng.normal(centre, 1.0, quality.D)
        if i % 12 == 0:
            x, _ = rng.normal(centre + 12, 1.0, quality.D), bad.add(i)
        rows.append((i, "l", f"s{i % 2}", *map(float, x)))
    names = ", ".join(f"x{i} double" for i in range(quality.D))
    table = spark.createDataFrame(rows, f"id int, lang string, source string, {names}")
    fitted = quality.fit(table).collect()
    assert {r["source"] for r in fitted} == {"s0", "s1"}
    for r in fitted:
        assert np.allclose(r["centre"], 0.0 if r["source"] == "s1" else 5.0, atol=0.35)
    assert abs(quality.chi_square_quantile(0.95, 4) - 9.487729) < 1e-4


def test_quality_judges_rare_cells_by_their_language_or_all_rows(spark):
    rng = random.Random(17)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(2000)]

    def prose():
        return " ".join(rng.choices(vocabulary, k=rng.randint(80, 200))) + "."

    def junk():
        return " ".join("".join(rng.choices("#*$%&|<>", k=4)) + rng.choice(vocabulary) for _ in range(100))

    cells = [("en", "web")] * 300 + [("de", "web")] * 250 + [("en", "rare")] * 8 + [("en", None)] * 5 + [(None, None)] * 4 + [("fr", "web")] * 6
    rows = [(k, prose(), *cell) for k, cell in enumerate(cells)]
    rows += [(1000 + k, junk(), *cell) for k, cell in enumerate([("en", "web"), ("en", "rare"), ("en", None), (None, None), ("fr", "web"), ("it", "x")])]
    table = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    judged = quality.quality_rules(table).collect()
    assert len(judged) == len(rows) and not any(r["base_failed"] for r in judged)
    assert {r["doc_id"] for r in judged if r["kept"]} == set(range(len(cells)))
    assert quality.keep_good(table).count() == len(cells)


def test_quality_cells_of_null_sources_are_their_own(spark):
    rng = np.random.default_rng(7)
    cells = [("x", None, 0.0)] * 300 + [("x", f"r{i}", 9.0) for i in range(10)] * 30 + [(None, None, 0.0)] * 300 + [(None, "r", 9.0)] * 100
    rows = [(lang, source, *map(float, rng.normal(centre, 1.0, quality.D))) for lang, source, centre in cells]
    table = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"x{i} double" for i in range(quality.D)))
    fitted = {(r["lang"], r["source"]): r for r in quality.fit(table).collect()}
    assert len(fitted) == 13 and len({r["cell"] for r in fitted.values()}) == 4
    for lang in ("x", None):
        own = fitted[lang, None]
        assert 220 <= own["n"] <= 230 and np.allclose(own["centre"], 0.0, atol=0.35)


def test_quality_keeps_columns_and_takes_empty_tables(odd_documents):
    kept = quality.keep_good(odd_documents)
    assert kept.columns == odd_documents.columns
    assert {r["doc_id"] for r in kept.collect()} <= {None, 5, 6, 7}
    assert kept.filter("doc_id = 7").count() == 2
    assert quality.quality_rules(odd_documents.limit(0)).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_spans_are_those_of_the_patterns(spark, documents, odd_documents):
    rng = random.Random(3)
    odd = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4", "5 5  5 4111111111111111 " + "1 " * 3000, "x@@y.z@q.r", "+++1 2 3 4 5 6 7 8++12 34"]
    odd += ["".join(rng.choice("0123456789.@+-( )ab é\n") for _ in range(400)) for _ in range(60)]
    made = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odd)], "doc_id bigint, text string")
    table = documents.select("doc_id", "text").unionByName(odd_documents.select("doc_id", "text")).unionByName(made)
    texts = {}
    for r in table.collect():
        texts.setdefault(r["doc_id"], set()).add(plain_spans(r["text"]))
    rows = pii.span_strings(pii.find_pii(table)).collect()
    assert len(rows) == table.count()
    hashes = {i: {hashlib.sha256(s.encode()).hexdigest() for s in spans} for i, spans in texts.items()}
    assert all(r["base_sha256"] in hashes[r["doc_id"]] for r in rows)


def test_pii_learns_identifiers_from_context(spark):
    rows = [(i, f"some words here and phone-no: +49 30 12345{i:02d} more words then", "x") for i in range(20)]
    rows += [(100, "other words and phone-no: 0151-7788-99 behind it", "x"), (101, "version 12.345 of the code", "x"), (102, None, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    found = {r["doc_id"]: r["spans"] for r in pii.span_strings(pii.find_pii(table)).collect()}
    assert found[100] == "phone:26:38" and rows[20][1][26:38] == "0151-7788-99"
    assert found[101] == "" and found[102] == ""
    masked = {r["doc_id"]: r for r in pii.mask_pii(table).collect()}
    assert masked[100]["text"] == "other words and phone-no: [PHONE] behind it"
    assert masked[3]["text"] == "some words here and phone-no: [PHONE] more words then"
    assert masked[101]["text"] == rows[21][1] and masked[102]["text"] is None and masked[100]["key"] == "x"
    assert pii.find_pii(table.limit(0)).count() == 0


def test_pii_learns_spaced_numbers(spark):
    rows = [(i, f"some words here and phone-no: +49 30 12345{i:02d} more words then") for i in range(20)]
    numbers = ["0151 778 8990", "01517 788990", "(0151) 778-89 90", "0151.778 8990", "01517788991"]
    rows += [(100 + k, f"other words and phone-no: {n}, behind it 12 of 34 567890 all") for k, n in enumerate(numbers)]
    rows += [(i + 200, f"at host 10.0.0.{i} here") for i in range(20)] + [(300, "at host 172900 12 here"), (301, "phone-no: 12 3 things")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.span_strings(pii.find_pii(table)).collect()}
    masked = {r["doc_id"]: r["text"] for r in pii.mask_pii(table).collect()}
    for k, n in enumerate(numbers):
        assert found[100 + k] == f"phone:26:{26 + len(n)}"
        assert masked[100 + k] == "other words and phone-no: [PHONE], behind it 12 of 34 567890 all"
    assert masked[300] == "at host [IP] 12 here" and found[301] == ""
    assert masked[3] == "some words here and phone-no: [PHONE] more words then"


def plain_edits(item, words):
    """Least edits between the item and any stretch of the words."""
    row = [0] * (len(words) + 1)
    for i, symbol in enumerate(item):
        new = [i + 1]
        for j, word in enumerate(words):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (symbol != word)))
        row = new
    return min(row)


def test_decontamination_finds_what_brute_force_finds(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(3, 40)))) for k in range(40)] + [(40, None), (41, ""), (None, "null id but five words")]
    docs = []
    for d in range(150):
        words = rng.choices(vocabulary, k=60)
        if d % 3:
            copy = items[d % 40][1].split()
            for _ in range(rng.randint(0, len(copy) // 4)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], ["new"], [copy[at], "more"]]) or ([] if len(copy) > 1 else ["new"])
            words[20:20] = copy
        docs.append((d, " ".join(w.upper() + "," if rng.random() < 0.1 else w for w in words)))
    docs += [(None, "Null id, BUT five words."), (900, None), (901, "")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    expected = {}
    for d, text in docs:
        words = decontaminate.normal_words((text or "").encode())
        for i, item in items:
            own = decontaminate.normal_words((item or "").encode())
            if own and words:
                edits = plain_edits(own, words)
                if edits <= decontaminate.allowed_edits(len(own), 0.8) and edits < len(own):
                    expected[d, i] = edits
    for per_pass in (20_000, 10):
        rows = decontaminate.decontaminate(table, bench, items_per_pass=per_pass).collect()
        found = {(r["doc_id"], r["item_id"]): r["edits"] for r in rows}
        assert len(rows) == len(found)
        assert set(found) <= set(expected) and all(expected[k] <= v for k, v in found.items())
        assert len(found) >= 0.99 * len(expected) > 50
    texts = dict(docs)
    for r in rows:
        if r["edits"] == 0:
            cut = texts[r["doc_id"]][r["start"] : r["end"]]
            assert decontaminate.normal_words(cut.encode()) == decontaminate.normal_words(dict(items)[r["item_id"]].encode())
    clean = decontaminate.drop_contaminated(table, bench)
    assert clean.columns == table.columns and {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in found}
    assert decontaminate.decontaminate(table.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(table, bench.limit(0)).count() == 0


def test_random_walk_keeps_equal_windows_equal():
    x = np.array([[1, 2, 3, 4, -1], [1, 2, 3, 4, 5]], np.int32)
    n = np.array([4, 5])
    a, b = decontaminate.walk(x, n, 15, 7), decontaminate.walk(x.copy(), n, 15, 7)
    assert (a == b).all() and set(a[0].tolist()) <= {1, 2, 3, 4, -1}
    width, bands = decontaminate.plan_bands([np.arange(1, 31, dtype=np.int32) + 50 * k for k in range(30)], 0.8, 0.99)
    assert width >= 1 and 1 <= bands <= decontaminate.MAX_BANDS


def test_section_tokens_add_up_to_whole_texts(documents, odd_documents):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    table = documents.select("doc_id", "text").unionByName(odd_documents.select("doc_id", "text").filter("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("doc_id") + 10_000))
    encoding = tokens.PieceLengths(path, pattern).encoding
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    total, covered = {}, {}
    for r in tokens.section_tokens(table, path, pattern).collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["end"] - r["start"]
    assert total == {i: len(encoding.encode_ordinary(t)) for i, t in texts.items()}
    assert covered == {i: len(t) for i, t in texts.items()}
    assert tokens.section_tokens(table.limit(0), path, pattern).count() == 0
    assert isinstance(encoding, tiktoken.Encoding)


def test_crossing_tokens_go_where_most_of_them_lies():
    ends, starts = np.array([4, 7, 10]), np.array([0, 5, 9])
    counted, crossing, share = tokens.attribute(ends, starts, 10)
    # token 4..7 holds 1 byte of the first and 2 of the second section; token 7..10 holds 2 and 1
    assert counted.tolist() == [1, 2, 0] and crossing.tolist() == [0, 2, 0]
    assert np.allclose(share, [1 + 1 / 3, 2 / 3 + 2 / 3, 1 / 3])
    tied, _, _ = tokens.attribute(np.array([2, 4]), np.array([0, 1]), 4)
    assert tied.tolist() == [1, 1]


def test_fields_of_a_row(spark):
    table = spark.createDataFrame([(1, "a b c", "d e"), (2, None, "x")], "doc_id bigint, title string, body string")
    rows = tokens.field_tokens(table, ["title", "body"], public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert {(r["doc_id"], r["field"]) for r in rows} == {(1, "title"), (1, "body"), (2, "title"), (2, "body")}
    odd = spark.createDataFrame([(1, "a b c", None), (2, "with \x1e inside \x1e", ""), (3, None, None), (None, "", "x")], "doc_id bigint, title string, body string")
    got = tokens.field_tokens(odd, ["title", "body"], public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["field"]) for r in got) == sorted((i, f) for i in range(4) for f in ("title", "body"))
    count = {(r["doc_id"], r["field"]): r["n_tokens"] for r in got}
    assert count[1, "body"] == 0 and count[2, "body"] == 0 and count[None, "body"] == 1 and count[2, "title"] > 4


def test_toxicity_is_held_out_accurate(spark):
    folder = "/root/testdata/sf0.01"
    rows = catalog.QUERIES["op5_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    bad, good = [r["score"] for r in held if r["toxic"]], [r["score"] for r in held if not r["toxic"]]
    better = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert better > 0.9
    assert sum(r["predicted"] for r in held if not r["toxic"]) <= 0.02 * len(good)


def test_clauses_weaken_and_strengthen():
    insult = (toxicity.INSULT, 4.0)
    alone = toxicity.clause_score([insult])
    assert toxicity.clause_score([(toxicity.NEGATION, 0), insult]) < alone < toxicity.clause_score([(toxicity.TARGET, 0), insult])
    assert toxicity.clause_score([(toxicity.REPORT, 0), insult]) < alone
    assert toxicity.clause_score([(toxicity.THREAT, 0)]) == 0 < toxicity.clause_score([(toxicity.TARGET, 0), (toxicity.THREAT, 0)])


def test_composed_transducers_do_what_each_does():
    parts = [toxicity.NEGATING, toxicity.REPORTING, toxicity.TARGETING, toxicity.THREATENING]
    rng = np.random.default_rng(4)
    for _ in range(300):
        clause = [(int(k), float(w)) for k, w in zip(rng.integers(1, 8, rng.integers(0, 9)), rng.random(8) * 5)]
        insults, threats, ends = 0.0, 0.0, np.ones(2)
        factors = np.ones(len(clause))
        for part in parts:
            state = 0
            for i, (kind, _) in enumerate(clause):
                state, factor = part.step(state, kind)
                factors[i] *= factor
            ends *= part.end(state)
        insults = sum(w * f for (k, w), f in zip(clause, factors) if k == toxicity.INSULT)
        threats = sum(f for (k, _), f in zip(clause, factors) if k == toxicity.THREAT)
        assert abs(toxicity.clause_score(clause) - (insults * ends[0] + threats * ends[1])) < 1e-9


def test_scopes_in_sentences():
    def best(text):
        return max(toxicity.sentence_scores(text, {"idiot*": 4.0}))

    direct = best("You are an idiot.")
    assert direct == 5.0 and best("An idiot.") == 4.0 and best("A friend.") == 0
    assert best("He said: you are an idiot.") == best("He said you are an idiot") == best("He said, \"you are an idiot.\"") == 3.0
    assert best("You are not an idiot") == 2.5 and best("You are not nice but an idiot") == best("No, you are an idiot") == direct
    assert best("Die Frau und sie lesen die Zeitung") == 0 and best("I will kill you") == 2.0 and best("He said. You are an idiot") == direct
    assert best("You are never not an idiot") == direct


def test_toxicity_reads_texts_longer_than_its_memory(monkeypatch):
    text = " ".join(f"word{i}" for i in range(400)) + ". You idiot. " + " ".join(f"other{i}" for i in range(400))
    plain = toxicity.read_texts([text.encode(), b"You idiot."], toxicity.Classes({"idiot*": 4.0}))
    monkeypatch.setattr(toxicity, "REMEMBERED_WORDS", 50)
    assert np.allclose(plain, toxicity.read_texts([text.encode(), b"You idiot."], toxicity.Classes({"idiot*": 4.0}))) and plain[0, 0] == 5.0


def test_toxicity_takes_odd_tables(spark, odd_documents):
    labels = spark.createDataFrame([(5, 0), (7, 1), (None, 1)], "doc_id bigint, toxic int")
    grammar = toxicity.fit(odd_documents, labels)
    rows = toxicity.score_toxicity(odd_documents, grammar).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    none = toxicity.fit(odd_documents, labels.limit(0))
    assert toxicity.score_toxicity(odd_documents, none).filter("predicted = 1").count() == 0
    assert toxicity.score_toxicity(odd_documents.limit(0), grammar).count() == 0


@pytest.mark.parametrize("name", ["op7_pii", "op8_quality_rules", "op6_decontamination", "op2_token_counts"])
def test_queries_run(spark, folder, name):
    assert catalog.QUERIES[name](spark, folder).count() >= 0
