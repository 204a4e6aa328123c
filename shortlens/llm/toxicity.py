"""Toxicity by a weighted grammar over clauses: what matches is a clause, not a word on its own.

Words are read as classes: insult (with a weight), threat, target, negation, reported speech. Insult stems and their weights
are learned from labelled texts: the stem is the shortest beginning of words that tells toxic texts as well as the words do.
Each class has a small transducer: negation and reported speech weaken the insults and threats behind them, a target
strengthens those of its clause, a threat counts only together with a target. They are composed into one table, through which a
clause runs from left to right. Clause scores add up to a few numbers per text; a logistic curve fitted to labels turns
them into a probability.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shortlens.llm.common import REMEMBERED_WORDS, as_bytes

# Labelled texts the model is fitted on: up to so many of each label, chosen by a hash of the id.
SAMPLE_PER_LABEL = 8_000
STEM_LENGTHS = range(4, 9)
# A stem must occur in this many toxic sample texts, be this many times (log) as frequent there, and its texts must be this
# unlikely (in nats) to be so often toxic by chance, whatever the size of the sample.
MIN_TEXTS = 3
MIN_LOG_ODDS = 2.5
MIN_EVIDENCE = 6.0
THRESHOLD = 0.7

# Word classes of the grammar, by language.
TARGETS = "you your you're youre he she they him her them du dich dir ihr euch sie tu te toi vous il elle ils elles usted ustedes él ella ellos"
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie pas jamais aucun ne non nunca jamás ningún"
REPORTS = "said says quoted quote wrote called reported allegedly sagte sagt schrieb zitiert dit disait écrit cité dijo dice escribió citó"
THREATS = "kill hurt destroy beat punch shoot stab töten schlagen zerstören sterben tuer frapper détruire mourir matar golpear destruir morir"
CONTRASTS = "but however yet aber doch sondern jedoch mais pourtant pero sino"
# SOFT is a comma or a colon: the clause goes on behind it.
INSULT, THREAT, TARGET, NEGATION, REPORT, CONTRAST, SOFT = KINDS = 1, 2, 3, 4, 5, 6, 7
_LISTS = ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (CONTRAST, CONTRASTS))
_WORDS = {w: k for k, words in _LISTS for w in words.split()}
_OUTER = string.punctuation + "“”‘’«»¿¡…–—"
_CLOSING = "\"'”’»)]"
_ENDS, _SOFT_ENDS = (".", "!", "?", ";"), (":", ",")
# How a word ends: inside a clause, at its end, before a comma or colon.
INSIDE, END, PAUSE = 0, -1, -2
# What the transducers do to a weight.
NEGATED, REPORTED, TARGETED, THREAT_WEIGHT = 0.5, 0.6, 1.25, 2.0
FEATURES = ("total", "largest", "clauses", "density")
FEATURES_TYPE = "struct<total:double,largest:double,clauses:double,density:double>"


@dataclass
class Grammar:
    """Weighted stems (longest first when read) and the curve over the numbers of a text."""

    stems: dict[str, float]
    weights: list[float]
    centre: list[float]
    spread: list[float]

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = (features - np.array(self.centre)) / np.array(self.spread) @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass(frozen=True)
class Transducer:
    """Reads classes and writes a factor for each. `moves` has (state, class) -> (next state, factor); what it lacks stays in its
    state with factor 1. `final` has state -> (factor on the insults of the clause, factor on its threats) at the end."""

    moves: dict[tuple[int, int], tuple[int, float]]
    final: dict[int, tuple[float, float]]

    def step(self, state: int, kind: int) -> tuple[int, float]:
        return self.moves.get((state, kind), (state, 1.0))

    def end(self, state: int) -> tuple[float, float]:
        return self.final.get(state, (1.0, 1.0))


def compose(left: Transducer, right: Transducer) -> Transducer:
    """One transducer that does what both do one after the other; its states are the pairs that can be reached."""
    number, queue, moves, final = {(0, 0): 0}, [(0, 0)], {}, {}
    for a, b in queue:
        here = number[a, b]
        for kind in KINDS:
            (to_a, f), (to_b, g) = left.step(a, kind), right.step(b, kind)
            if (to_a, to_b) not in number:
                number[to_a, to_b] = len(number)
                queue.append((to_a, to_b))
            moves[here, kind] = number[to_a, to_b], f * g
        final[here] = tuple(f * g for f, g in zip(left.end(a), right.end(b)))
    return Transducer(moves, final)


def _scope(opened_by: int, factor: float, again: int, closed_by: tuple[int, ...]) -> Transducer:
    """Weakens insults and threats between its word and what closes its scope; a second such word leads to state `again`."""
    moves = {(0, opened_by): (1, 1.0), (1, opened_by): (again, 1.0), (1, INSULT): (1, factor), (1, THREAT): (1, factor)}
    return Transducer(moves | {(1, kind): (0, 1.0) for kind in closed_by}, {})


# Two negations cancel; a contrast, a comma or a colon ends what a negation reaches. A report reaches to the clause's end.
NEGATING = _scope(NEGATION, NEGATED, 0, (CONTRAST, SOFT))
REPORTING = _scope(REPORT, REPORTED, 1, ())
TARGETING = Transducer({(0, TARGET): (1, 1.0)}, {0: (1.0, 0.0), 1: (TARGETED, 1.0)})
THREATENING = Transducer({(0, THREAT): (0, THREAT_WEIGHT)}, {})
GRAMMAR = reduce(compose, (NEGATING, REPORTING, TARGETING, THREATENING))


class Classes(dict):
    """word as written -> (class, weight, how it ends)."""

    def __init__(self, stems: dict[str, float]):
        self.stems, self.codes = stems, []

    def __missing__(self, word: bytes) -> int:
        """INSIDE, END or PAUSE for a word without a class, else 1 + a place in `codes`."""
        if len(self) > REMEMBERED_WORDS:
            self.clear()
            self.codes.clear()
        text = word.decode("utf-8", "replace")
        tail = text.rstrip(_CLOSING)
        ends = END if tail.endswith(_ENDS) else PAUSE if tail.endswith(_SOFT_ENDS) else INSIDE
        plain = text.lower().strip(_OUTER)
        weight = self.stems.get(plain)
        for size in reversed(STEM_LENGTHS):
            if weight is None and len(plain) >= size:
                weight = self.stems.get(plain[:size] + "*")
        kind = INSULT if weight is not None else _WORDS.get(plain, 0)
        if not kind:
            value = ends
        else:
            self.codes.append((kind, weight if kind == INSULT else 1.0, ends))
            value = len(self.codes)
        self[word] = value
        return value


def clause_scores(items) -> list[float]:
    """Scores of the clauses that (class or 0, weight, how the word ends) make up, run through the composed table."""
    moves, final = GRAMMAR.moves, GRAMMAR.final
    scores, state, insults, threats = [], 0, 0.0, 0.0
    for kind, weight, ends in items:
        if kind:
            state, factor = moves[state, kind]
            if kind == INSULT:
                insults += weight * factor
            elif kind == THREAT:
                threats += weight * factor
        if ends == PAUSE:
            state = moves[state, SOFT][0]
        elif ends == END:
            on_insults, on_threats = final[state]
            scores.append(insults * on_insults + threats * on_threats)
            state, insults, threats = 0, 0.0, 0.0
    on_insults, on_threats = final[state]
    return [*scores, insults * on_insults + threats * on_threats]


def clause_score(clause: list[tuple[int, float]]) -> float:
    return clause_scores([(kind, weight if kind == INSULT else 1.0, INSIDE) for kind, weight in clause])[0]


def sentence_scores(text: str, stems: dict[str, float]) -> list[float]:
    """Score of each clause of a text, those that do not match included."""
    classes = Classes(stems)
    return clause_scores(_items([classes[w] for w in text.encode().split()], classes))


def _items(values: list[int], classes: Classes):
    return [classes.codes[v - 1] if v > 0 else (0, 0.0, v) for v in values]


def read_texts(texts: list[bytes], classes: Classes) -> np.ndarray:
    """The numbers of each text: sum and largest of its clause scores, clauses that match, sum by root of length."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in enumerate(texts):
        # Numbers of words hold until the memory is cleared, so that happens between texts; a longer text is read word by word.
        raw = text.split()
        if len(classes) + len(raw) > REMEMBERED_WORDS:
            classes.clear()
            classes.codes.clear()
        words = [classes[w] for w in raw] if len(raw) <= REMEMBERED_WORDS else None
        if words is None:
            items = _streamed(raw, classes)
        else:
            told = [v for v in words if v]
            if not any(v > 0 and classes.codes[v - 1][0] <= THREAT for v in told):
                continue
            items = _items(told, classes)
        hit = [s for s in clause_scores(items) if s > 0]
        if hit:
            out[row] = sum(hit), max(hit), len(hit), sum(hit) / np.sqrt(len(raw))
    return out


def _streamed(raw: list[bytes], classes: Classes):
    """Words of a text with more of them than are remembered, each looked up as it comes."""
    for word in raw:
        value = classes[word]
        if value:
            yield classes.codes[value - 1] if value > 0 else (0, 0.0, value)


def reader(stems: dict[str, float]):
    @F.arrow_udf(returnType=FEATURES_TYPE)
    def numbers(text: pa.Array) -> pa.Array:
        classes, parts = Classes(stems), []
        for at in range(0, len(text), 256):
            parts.append(read_texts(as_bytes(text.slice(at, 256)), classes))
        table = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(FEATURES))], names=list(FEATURES))

    return numbers


@F.arrow_udf(returnType=T.ArrayType(T.StringType()))
def _stems_in(text: pa.Array) -> pa.Array:
    """Distinct words of a text and their beginnings (marked by a star)."""
    known: dict = {}
    rows = []
    for raw in as_bytes(text):
        found = set()
        for word in set(raw.split()):
            if word not in known:
                plain = word.decode("utf-8", "replace").lower().strip(_OUTER)
                known[word] = (plain, *[plain[:n] + "*" for n in STEM_LENGTHS if len(plain) >= n]) if plain else ()
            found.update(known[word])
        rows.append(sorted(found))
        if len(known) > REMEMBERED_WORDS:
            known.clear()
    return pa.array(rows, pa.list_(pa.string()))


def sample_labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """(text, toxic): at most `per_label` rows of each label, the first by a hash of the id."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("toxic"))
    parts = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(per_label) for k in (0, 1)]
    # At most 2 * per_label rows of two numbers: they may travel to every task.
    chosen = F.broadcast(parts[0].unionByName(parts[1]).dropDuplicates(["_id"]))
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(chosen, "_id").select("text", "toxic")


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Words and stems with their log odds. Bounded by the sample, which is."""
    totals = dict(sample.groupBy("toxic").count().collect())
    good, bad = totals.get(0, 0), totals.get(1, 0)
    if not good or not bad:
        return {}
    in_bad, in_good = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    counted = sample.select("toxic", F.explode_outer(_stems_in("text")).alias("stem")).filter("stem is not null").groupBy("stem").agg(in_bad.alias("bad"), in_good.alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    n, share = F.col("bad") + F.col("good"), bad / (bad + good)
    clean = F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - share)))).otherwise(0.0)
    evidence = F.col("bad") * F.log(F.col("bad") / (n * share)) + clean
    kept = counted.withColumn("odds", odds).filter((F.col("bad") >= MIN_TEXTS) & (F.col("odds") >= MIN_LOG_ODDS))
    kept = kept.filter(evidence >= MIN_EVIDENCE)
    found = {r["stem"]: (r["odds"], r["bad"]) for r in kept.select("stem", "odds", "bad").collect()}
    stems: dict[str, float] = {}
    for stem in sorted(found, key=lambda s: (len(s), s)):
        if stem.endswith("*"):
            shorter = [stem[:n] + "*" for n in STEM_LENGTHS if n < len(stem) - 1]
        else:
            shorter = [stem[:n] + "*" for n in STEM_LENGTHS if n <= len(stem)]
        # A longer stem adds nothing where a shorter one already tells as much.
        if not any(s in stems for s in shorter):
            stems[stem] = float(found[stem][0])
    return stems


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1.0) -> tuple[list[float], list[float], list[float]]:
    """Logistic regression by Newton's method on scaled columns: weights (constant first), centre, spread."""
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = np.column_stack([np.ones(len(x)), (x - centre) / spread])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (a.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist(), centre.tolist(), spread.tolist()


def fit_rising(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """The same without falling weights: a clause that matches never lowers a score. Columns that would are left out."""
    used = list(range(x.shape[1]))
    weights, centre, spread = [0.0] * (x.shape[1] + 1), [0.0] * x.shape[1], [1.0] * x.shape[1]
    while True:
        w, c, s = fit_curve(x[:, used], y)
        falling = {k for k, value in zip(used, w[1:]) if value < 0}
        if not falling:
            break
        used = [k for k in used if k not in falling]
    weights[0] = w[0]
    for k, value, middle, width in zip(used, w[1:], c, s):
        weights[k + 1], centre[k], spread[k] = value, middle, width
    return weights, centre, spread


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = SAMPLE_PER_LABEL) -> Grammar:
    """Stems and curve from at most `per_label` labelled texts of each label. Without both labels every score is 0.5 or less."""
    sample = sample_labelled(docs, labels, doc_id, text, label, per_label)
    stems = learn_stems(sample)
    rows = sample.select(reader(stems)("text").alias("f"), "toxic").select("f.*", "toxic").collect()  # at most 2 * per_label rows
    if not stems or not rows:
        return Grammar({}, [-1.0, *[0.0] * len(FEATURES)], [0.0] * len(FEATURES), [1.0] * len(FEATURES))
    table = np.array([tuple(r) for r in rows], float)
    return Grammar(stems, *fit_rising(table[:, :-1], table[:, -1]))


def score_text(text: Column, grammar: Grammar) -> Column:
    """Probability, 0 to 1, that a text is toxic; null counts as empty."""

    @F.arrow_udf(returnType="double")
    def score(text: pa.Array) -> pa.Array:
        classes, parts = Classes(grammar.stems), []
        for at in range(0, len(text), 256):
            parts.append(grammar.probability(read_texts(as_bytes(text.slice(at, 256)), classes)))
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(text)


def score_toxicity(docs: DataFrame, grammar: Grammar, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted): one row per row of `docs`.

    Only the text decides. Null and empty texts have no clauses and get the score of a text without matches. Repeated rows
    score alike; null ids are kept. An empty table gives an empty result; other columns are not read.
    """
    scored = docs.select(F.col(doc_id).alias("doc_id"), score_text(F.col(text), grammar).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
