"""Personal data: fixed forms, and identifiers found by the words that lead to them. DataFrame functions only.

The fixed forms (e-mail, IP, card, phone) are the seeds. The word in front of an identifier is a lexical pattern. Patterns
and identifiers make a graph that is scored in rounds: a pattern is as good as the share of its occurrences anywhere in the
corpus that lead to a known identifier, an unknown identifier as good as the patterns that lead to it. Identifiers
behind good patterns become spans of the kind that most seeds of the pattern have; the spans of the fixed forms stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlens.llm.common import free_name, store, text_key

KINDS = ("email", "ip", "card", "phone")
# A pattern needs this many different seeds, and this share of its occurrences must lead to known identifiers.
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.5
ROUNDS = 3
# An identifier is a word with a digit or "@" of at least so many characters.
MIN_IDENTIFIER = 5
# Largest table of patterns that travels to every task; a larger one is joined by shuffling word counts.
BROADCAST_PATTERNS = 100_000
# How far back the word before an identifier is looked for.
CONTEXT_CHARS = 80

# The contract's patterns. Runs are possessive and begin where a run begins, which changes no match and keeps the time
# linear in the text; \G lets an address begin right behind the one before it.
_MAILBOX = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_MAILBOX}]))[{_MAILBOX}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GUARDS = {"email": "[^@]@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
_SPACE = r"\x20\x09-\x0D"
# A word of digit groups joined by dots, hyphens or brackets, up to a blank, the end or stops before one.
_GROUPS = rf"[+(]*+[0-9]++(?:[().-]++[0-9]++)*+\)?(?=[\"')\]>.,;:!?]*+(?:[{_SPACE}]|\z))"
# The longest run of such words joined by single blanks, else a word.
_IDENTIFIER = rf"(?<![^{_SPACE}])(?:[\"'\[<]*+{_GROUPS}(?:\x20{_GROUPS})++|[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+)"
# Quotes and brackets in front; a bracket that closes before more digits belongs to the number.
_LEAD = r"^(?:[\"'\[<]|\((?![^()]*\)[^0-9]*[0-9]))+"
_SPAN = "array<struct<start:bigint,end:bigint>>"
_FOUND = "array<struct<start:bigint,end:bigint,left:string,token:string>>"
_SPACED = rf"[{_SPACE}]"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, digits of a double are added; the sum ends in 0."""
    places = F.sequence(F.lit(1), F.length(digits))

    def value(place):
        digit = F.substring(F.reverse(digits), place, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(place % 2 == 0, F.when(double > 9, double - 9).otherwise(double)).otherwise(digit)

    return F.aggregate(places, F.lit(0), lambda total, place: total + value(place)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.|$)){4}$")
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _located(pieces: Column, matches: Column, keep) -> Column:
    """Places of matches from the text between them: (start, end, the text before, the match) of those to keep."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,before:string,match:string>>").alias("found"))
    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("piece"), matches.alias("match"))

    def step(state, pair):
        begin = state["at"] + F.length(pair["piece"])
        end = begin + F.length(pair["match"])
        own = F.struct(begin.alias("start"), end.alias("end"), pair["piece"].alias("before"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.when(keep(pair["match"]), F.concat(state["found"], F.array(own))).otherwise(state["found"]).alias("found"))

    return F.aggregate(pairs, start, step, lambda state: state["found"])


def _with_matches(df: DataFrame, text: Column, name: str, pattern: str, guard: str, keep) -> DataFrame:
    """Column `name`: where the pattern matches, leftmost first, not overlapping. Texts that fail the guard are not searched."""
    none = F.array().cast("array<string>")
    hit = text.rlike(guard)
    matches, pieces = (free_name(df.columns, own) for own in ("_matches", "_pieces"))
    df = df.withColumn(matches, F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(pieces, F.when(F.size(matches) > 0, F.split(text, pattern, -1)).otherwise(none))
    return df.withColumn(name, _located(F.col(pieces), F.col(matches), keep)).drop(matches, pieces)


def base_spans(df: DataFrame, text: Column, into: str = "_spans") -> DataFrame:
    """`df` with a struct `into` that holds (start, end) of each kind's matches, in code points, end exclusive."""
    names = []
    for kind in KINDS:
        name = free_name(df.columns, f"{into}_{kind}")
        df = _with_matches(df, text, name, PATTERNS[kind], _GUARDS[kind], lambda match, kind=kind: _valid(kind, match))
        df = df.withColumn(name, F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        names.append(name)
    return df.withColumn(into, F.struct(*[F.col(n).alias(k) for n, k in zip(names, KINDS)])).drop(*names)


def _identifiers(df: DataFrame, text: Column, into: str) -> DataFrame:
    """Words with a digit or "@" and the word before each; `run` is the run of spaced digit groups that begins there, if any."""
    long_enough = lambda match: F.length(_bare(match)) >= MIN_IDENTIFIER
    df = _with_matches(df, text, into, _IDENTIFIER, "[0-9@]", long_enough)

    def describe(s):
        left = F.lower(F.regexp_extract(F.right(s["before"], F.lit(CONTEXT_CHARS)), rf"([^{_SPACE}]+)[{_SPACE}]+$", 1))
        whole, first = _bare(s["match"]), F.substring_index(s["match"], " ", 1)
        token = _bare(first)
        spaced = whole.rlike(_SPACED) & (F.length(_digits(whole)) >= MIN_IDENTIFIER)

        def begin(match):
            return s["start"] + F.length(F.regexp_extract(match, _LEAD, 0))

        return F.struct(
            begin(first).alias("start"),
            (begin(first) + F.length(token)).alias("end"),
            left.alias("left"),
            F.when(F.length(token) >= MIN_IDENTIFIER, token).alias("token"),
            F.when(spaced, F.struct(begin(s["match"]).alias("start"), (begin(s["match"]) + F.length(whole)).alias("end"), whole.alias("token"))).alias("run"),
        )

    return df.withColumn(into, F.filter(F.transform(into, describe), lambda s: (s["left"] != "") & (s["token"].isNotNull() | s["run"].isNotNull())))


def _bare(match: Column) -> Column:
    """Without quotes, brackets and stops around it."""
    return F.regexp_replace(F.regexp_replace(match, _LEAD, ""), r"[\"')\]>.,;:!?]+$", "")


def learn(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(left, token, kind, spaced): identifiers outside the fixed forms, each with a good pattern it stands behind.

    Behind a pattern with spaced seeds an identifier is a whole run of digit groups, behind others a word.

    `found` has for each row `identifiers`, `seeds` (kind, left, token). All tables here are counts of patterns and
    identifiers; nothing grows with the length of a group, because counts are added up before rows are exchanged.
    """
    seeds = found.select(F.explode("seeds").alias("s")).select("s.*").filter("left <> ''")
    kinds = seeds.groupBy("left", "kind").agg(F.count_distinct("token").alias("seeds"), F.max(F.col("token").rlike(_SPACED)).alias("spaced"))
    patterns = kinds.groupBy("left").agg(F.max(F.struct("seeds", "kind")).alias("most"), F.sum("seeds").alias("seeds"), F.max("spaced").alias("spaced"))
    patterns = store(patterns.filter(F.col("seeds") >= MIN_SEEDS).select("left", F.col("most.kind").alias("kind"), "spaced"), "pii-patterns")
    small = patterns.count() <= BROADCAST_PATTERNS
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), rf"[{_SPACE}]+")).alias("left"))
    if small:
        occurrences = words.join(F.broadcast(patterns.select("left")), "left").groupBy("left").agg(F.count("*").alias("total"))
    else:
        occurrences = words.groupBy("left").agg(F.count("*").alias("total")).join(patterns.select("left"), "left")
    occurrences = store(occurrences, "pii-occurrences")
    tokens = found.select(F.explode("identifiers").alias("i")).select("i.left", "i.token", F.col("i.run.token").alias("run"))
    known = seeds.select("token").distinct().withColumn("seed", F.lit(1.0))
    edges = tokens.groupBy("left", "token", "run").agg(F.count("*").alias("n")).join(patterns.select("left", "spaced"), "left")
    shaped = F.when(F.col("spaced"), F.coalesce("run", "token")).otherwise(F.col("token"))
    edges = edges.select("left", shaped.alias("token"), "n").filter("token is not null").groupBy("left", "token").agg(F.sum("n").alias("n"))
    # Seeds with blanks inside, such as phones, count for their pattern as they are, once where they are also a run.
    spaced = seeds.filter(F.col("token").rlike(_SPACED)).groupBy("left", "token").agg(F.count("*").alias("n"))
    edges = edges.unionByName(spaced.join(patterns.select("left"), "left")).groupBy("left", "token").agg(F.max("n").alias("n"))
    edges = store(edges.join(known, "token", "left").select("left", "token", "n", F.coalesce("seed", F.lit(0.0)).alias("seed")), "pii-edges")
    scores = edges.select("token", F.col("seed").alias("score")).distinct()
    confidence = None
    for _ in range(ROUNDS):
        led = edges.join(scores, "token").groupBy("left").agg(F.sum(F.col("n") * F.col("score")).alias("good"))
        confidence = led.join(occurrences, "left").select("left", F.least(F.col("good") / F.col("total"), F.lit(1.0)).alias("confidence"))
        confidence = store(confidence, "pii-confidence")
        missed = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12)))))
        scores = edges.join(confidence, "left").groupBy("token").agg(F.greatest(F.max("seed"), 1 - missed).alias("score"))
        scores = store(scores, "pii-scores")
    good = confidence.filter(F.col("confidence") >= MIN_CONFIDENCE).join(patterns, "left")
    fresh = edges.filter("seed = 0").join(scores.filter(F.col("score") >= MIN_CONFIDENCE), "token").select("left", "token")
    return store(fresh.join(good, "left").select("left", "token", "kind", "spaced"), "pii-learned")


def _tagged(seeds: str, kind: str) -> Column:
    return F.transform(seeds, lambda s: F.struct(F.lit(kind).alias("kind"), s["left"].alias("left"), s["token"].alias("token")))


def _seeds() -> Column:
    """The identifiers at which a base span begins, and the spaced ones, with the word before."""
    found = []
    for kind in KINDS:
        found.append(_tagged(f"_context_{kind}", kind))
    return F.concat(*found)


def _analysed(docs: DataFrame, text: str) -> DataFrame:
    """docs with `_spans` (base), `seeds` and `identifiers`."""
    column = F.col(text)
    df = docs
    for kind in KINDS:
        df = _with_matches(df, column, f"_at_{kind}", PATTERNS[kind], _GUARDS[kind], lambda match, kind=kind: _valid(kind, match))
        df = df.withColumn(
            f"_context_{kind}",
            F.transform(
                f"_at_{kind}",
                lambda s: F.struct(
                    F.lower(F.regexp_extract(F.right(s["before"], F.lit(CONTEXT_CHARS)), rf"([^{_SPACE}]+)[{_SPACE}]+$", 1)).alias("left"),
                    _bare(s["match"]).alias("token"),
                ),
            ),
        )
    df = _identifiers(df, column, "identifiers")
    spans = F.struct(*[F.transform(f"_at_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS])
    df = df.withColumn("_spans", spans).withColumn("seeds", _seeds())
    return df.drop(*[f"_at_{k}" for k in KINDS], *[f"_context_{k}" for k in KINDS])


def _joined(spans: Column) -> Column:
    """kind:start:end of each kind in its order, then by start, joined by commas. `spans` has one array per kind."""

    def named(kind):
        return F.transform(F.array_sort(spans[kind]), lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*[named(kind) for kind in KINDS]), ",")


def _added(found: DataFrame, learned: DataFrame) -> DataFrame:
    """(key, added): the learned spans of each text, beside its base spans."""
    each = found.select("key", "_spans", F.explode("identifiers").alias("i"))
    word = F.struct(F.col("i.start").alias("start"), F.col("i.end").alias("end"), F.col("i.token").alias("token"))
    each = each.select("key", "_spans", "i.left", F.col("i.run").isNotNull().alias("has_run"), F.posexplode(F.array(word, F.col("i.run"))).alias("form", "at"))
    hit = each.select("key", "_spans", "left", "has_run", (F.col("form") == 1).alias("is_run"), "at.*").join(learned, ["left", "token"])
    hit = hit.filter(F.col("is_run") == (F.col("spaced") & F.col("has_run")))
    for kind in KINDS:
        hit = hit.filter(~F.exists(F.col("_spans")[kind], lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start"))))
    own = [F.collect_set(F.when(F.col("kind") == k, F.struct("start", "end"))).alias(k) for k in KINDS]
    return hit.groupBy("key").agg(*own).select("key", F.struct(*KINDS).alias("added"))


def _all_spans(base: Column, added: Column) -> Column:
    none = F.array().cast(_SPAN)
    return F.struct(*[F.array_union(base[k], F.coalesce(added[k], none)).alias(k) for k in KINDS])


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, all): spans of each kind, of the fixed forms and with what was learned.

    Null and empty texts have no spans. Repeated rows are each returned; a text counts as often as it occurs. Null ids are
    kept. An empty table gives an empty result; other columns are not read.
    """
    table = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = _analysed(table, "text").withColumn("key", F.when(F.size("identifiers") > 0, text_key("text")))
    found = store(keyed.select("doc_id", "key", "_spans", "seeds", "identifiers"), "pii-found")
    learned = learn(found, table, "text")
    if learned.isEmpty():
        both = found.withColumn("all", F.col("_spans"))
    else:
        texts = found.filter("key is not null").dropDuplicates(["key"])
        both = found.join(_added(texts, learned), "key", "left").withColumn("all", _all_spans(F.col("_spans"), F.col("added")))
    counts = [F.size(F.col("_spans")[k]).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return both.select("doc_id", *counts, F.col("_spans").alias("base"), "all")


def span_strings(found: DataFrame) -> DataFrame:
    """What `find_pii` gives with its spans as text: `base_sha256` and `spans`."""
    base = F.sha2(_joined(F.col("base")), 256)
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], base.alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span in `text` replaced by its kind in brackets; null texts stay null, other columns as they are.

    Spans that overlap are one, named by the kind of the first.
    """
    columns = docs.columns
    key, own, every, flat_name, learned_name = (free_name(columns, name) for name in ("_text_key", "_pii_spans", "_pii_all", "_pii_flat", "_pii_added"))
    whole = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = _analysed(whole, "text").withColumn("key", F.when(F.size("identifiers") > 0, text_key("text")))
    found = store(found.select("key", "_spans", "seeds", "identifiers").filter(F.size("identifiers") + F.size("seeds") > 0), "pii-found")
    learned = learn(found, whole, "text")
    df = base_spans(docs, F.coalesce(F.col(text), F.lit("")), own)
    if learned.isEmpty():
        df = df.withColumn(every, F.col(own))
    else:
        added = _added(found.filter("key is not null").dropDuplicates(["key"]), learned).select(F.col("key").alias(key), F.col("added").alias(learned_name))
        df = df.withColumn(key, text_key(F.col(text))).join(added, key, "left")
        df = df.withColumn(every, _all_spans(F.col(own), F.col(learned_name))).drop(key, learned_name)

    def ordered(kind):
        return F.transform(F.col(every)[kind], lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), F.lit(kind).alias("kind")))

    flat = F.concat(*[ordered(kind) for kind in KINDS])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    source = F.col(text)

    def step(state, s):
        end = -s["less"]
        between = F.substring(source, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        replaced = F.concat(state["out"], F.array(between, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        inside = s["start"] < state["at"]
        return F.struct(F.greatest(state["at"], end).alias("at"), F.when(inside, state["out"]).otherwise(replaced).alias("out"))

    def finish(state):
        rest = F.substring(source, (state["at"] + 1).cast("int"), F.greatest(F.length(source) - state["at"], F.lit(0)).cast("int"))
        return F.array_join(F.concat(state["out"], F.array(rest)), "")

    df = df.withColumn(flat_name, F.array_sort(flat))
    masked = F.when(F.size(flat_name) == 0, source).otherwise(F.aggregate(flat_name, start, step, finish))
    return df.withColumn(text, masked).select(*[F.col(f"`{c}`") for c in columns])
