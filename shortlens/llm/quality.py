"""Quality rules: texts whose statistics lie far from the bulk of their language and source are rejected.

Per cell (language, source) a minimum-covariance-determinant estimate of centre and scatter is found by concentration
steps: keep the share of rows nearest by Mahalanobis distance, estimate again from those. Every step is one aggregate over
all rows of all cells, so a cell with a third of the rows is summed map-side like any other. Small cells are judged by the
estimate over all rows of their language, or over all rows of the table where the language is small too; only a table that
is itself small gives no verdict beside the base rules.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shortlens.llm.common import SHINGLE_FACTORS, WordHashes, as_bytes, free_name, mix, store

REPEAT_WIDTH = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# Smallest cell that gets an estimate of its own.
MIN_CELL_ROWS = 200
# Cell of all rows.
WHOLE = "*"
# Up to so many cells their estimates (some hundred bytes each) travel to every task; more are met by a salted join.
BROADCAST_CELLS = 10_000
SALTS = 32
# Share of a cell the estimate rests on, and how often it is improved.
CORE_SHARE = 0.75
CONCENTRATION_STEPS = 4
# Chance that a text of the bulk is rejected, were the statistics normal.
TAIL = 1e-9
FEATURES = ("word_length", "symbols", "capitals", "punctuation", "digits", "dup_lines", "variety")
# Least standard deviation of each feature: what chance does to a text of a few hundred words even in a uniform cell.
# Numbers are wider: a text with an address or a price list is no worse for it.
LEAST_SD = (0.25, 0.02, 0.02, 0.02, 0.1, 0.05, 0.05)
# Words by which a short text's shares are drawn to the usual value.
PRIOR_WORDS = 50

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_NOT_POINTS = bytes(range(0x80, 0xC0)) + _SPACE
_SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGITS, _PUNCTUATION = string.ascii_uppercase.encode(), string.digits.encode(), string.punctuation.encode()

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_digits", "n_punct", "n_lines")
# Types as objects where a function is made on import: type strings need a running session.
STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
_ARROW_TYPE = pa.struct([(c, pa.int64()) for c in COUNTS])


def _repeats(ids: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Words of each text that lie in a run of five that its text holds at least twice."""
    n = len(ids) - REPEAT_WIDTH + 1
    if n <= 0:
        return np.zeros(texts, np.int64)
    inside = owner[:n] == owner[REPEAT_WIDTH - 1 :]
    run = owner[:n].astype(np.uint64) * SHINGLE_FACTORS[63]
    for k in range(REPEAT_WIDTH):
        run += ids[k : n + k] * SHINGLE_FACTORS[k]
    at = np.flatnonzero(inside)
    run = mix(run[at])
    order = np.argsort(run, kind="stable")
    ranked = run[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(len(ids) + 1, np.int32)
    found = at[again]
    np.add.at(change, found, 1)
    np.add.at(change, found + REPEAT_WIDTH, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(owner[covered], minlength=texts).astype(np.int64)


def _dup_lines(text: bytes) -> tuple[int, int]:
    if b"\n" not in text:
        return 0, int(bool(text.strip(_SPACE)))
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    return len(lines) - len(set(lines)), len(lines)


def _measure(texts: list[bytes], hashes: WordHashes) -> pa.StructArray:
    rows, all_ids, counts = [], [], []
    for text in texts:
        words = text.split()
        repeated, lines = _dup_lines(text)
        size = len(text)
        rows.append(
            (
                len(words),
                len(text.translate(None, _NOT_POINTS)),
                size - len(text.translate(None, _SYMBOLS)),
                repeated,
                0,
                len(set(words)),
                size - len(text.translate(None, _UPPER)),
                size - len(text.translate(None, _DIGITS)),
                size - len(text.translate(None, _PUNCTUATION)),
                lines,
            )
        )
        all_ids.extend(map(hashes.__getitem__, words))
        counts.append(len(words))
    table = np.array(rows, np.int64).reshape(len(rows), len(_ARROW_TYPE))
    owner = np.repeat(np.arange(len(texts)), counts)
    table[:, 4] = _repeats(np.array(all_ids, np.uint64), owner, len(texts))
    return pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(table.shape[1])], fields=list(_ARROW_TYPE))


@F.arrow_udf(returnType=STATS_TYPE)
def text_statistics(text: pa.Array) -> pa.Array:
    """Counts over the whole text: words are runs of characters other than space and \\x09-\\x0D; null has none."""
    hashes = WordHashes()
    parts = [_measure(as_bytes(text.slice(i, 256)), hashes) for i in range(0, len(text), 256)]
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(parts) if parts else pa.array([], _ARROW_TYPE)


# Declared not repeatable: else the optimizer works it out once more for a filter that it pushes down.
text_statistics = text_statistics.asNondeterministic()


def _features(s) -> dict:
    """Statistics on a scale where the bulk is close to normal; shares of short texts are drawn to a usual value."""
    words, chars = s["n_words"] + PRIOR_WORDS, s["word_chars"] + 5 * PRIOR_WORDS

    def root_share(count, of, usual):
        return F.sqrt((count + usual * (of - (s["n_words"] if of is words else s["word_chars"]))) / of)

    return {
        "word_length": (s["word_chars"] + 5.0 * PRIOR_WORDS) / words,
        "symbols": root_share(s["n_symbols"], chars, 0.0),
        "capitals": root_share(s["n_upper"], chars, 0.02),
        "punctuation": root_share(s["n_punct"], chars, 0.03),
        "digits": root_share(s["n_digits"], chars, 0.0),
        "dup_lines": F.sqrt(s["n_dup_lines"] / (s["n_lines"] + 5.0)),
        "variety": F.log(s["n_distinct"] + 1.0) / F.log(s["n_words"] + 2.0),
    }


def measured(docs: DataFrame, text: str, lang: str, source: str, into: str) -> DataFrame:
    """`docs` with a struct `into`: the counts, the features and what names the cell."""
    counted = docs.withColumn(into, text_statistics(F.col(text)))
    s = F.col(into)
    features = [v.cast("double").alias(f"x{i}") for i, v in enumerate(_features(s).values())]
    failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
    return counted.withColumn(
        into,
        F.struct(s.alias("counts"), F.struct(*features).alias("x"), failed.alias("base_failed"), F.col(lang).alias("lang"), F.col(source).alias("source")),
    )


def _cells(rows: DataFrame) -> DataFrame:
    """(lang, source, cell, into): which estimate judges the rows of a language and source, and into which they are summed.

    A small cell is judged by the nearest that has enough rows: all rows of its language, else all rows of the table. So
    the rows of a large cell are also summed into its language where that has small cells, and into the whole where it is needed.
    """
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = Window.partitionBy("lang")
    sized = sizes.withColumn("own", F.col("n") >= MIN_CELL_ROWS).withColumn("pool", F.sum("n").over(by_lang) >= MIN_CELL_ROWS)
    sized = sized.withColumn("asked", F.col("pool") & ~F.min("own").over(by_lang))
    # Named with their kind and with nulls: a null source of its own is not the whole language.
    named = {"ignoreNullFields": "false"}
    own = F.to_json(F.struct(F.lit("own").alias("kind"), "lang", "source"), named)
    lang = F.to_json(F.struct(F.lit("lang").alias("kind"), "lang"), named)
    name = F.when(F.col("own"), own).when(F.col("pool"), lang).otherwise(F.lit(WHOLE))
    into = F.array_compact(F.array(F.when(F.col("own"), own), F.when(F.col("asked"), lang)))
    cells = store(sized.select("lang", "source", name.alias("cell"), into.alias("into")), "quality-cells")
    if cells.filter(F.col("cell") == WHOLE).isEmpty():
        return cells
    return cells.withColumn("into", F.array_append("into", F.lit(WHOLE)))


D = len(FEATURES)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
ESTIMATE_TYPE = "cell string, n bigint, centre array<double>, whiten array<double>"


def _distance() -> F.Column:
    """Squared Mahalanobis distance: the whitening matrix is lower triangular, row by row."""
    total, k = F.lit(0.0), 0
    for i in range(D):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col("whiten")[k] * (F.col(f"x{j}") - F.col("centre")[j])
            k += 1
        total = total + z * z
    return total


def _estimates(moments: DataFrame, share: float) -> DataFrame:
    """Centre and whitening matrix of each cell from its sums, one row per cell."""
    scale = _consistency(share)

    def solve(batches):
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            mean = np.stack([batch.column(f"s{i}").to_numpy(zero_copy_only=False) for i in range(D)], 1) / n[:, None]
            scatter = np.empty((len(n), D, D))
            for i, j in PAIRS:
                value = batch.column(f"s{i}_{j}").to_numpy(zero_copy_only=False) / n - mean[:, i] * mean[:, j]
                scatter[:, i, j] = scatter[:, j, i] = value
            scatter = scatter * scale + np.diag(np.square(LEAST_SD))
            whiten = np.linalg.inv(np.linalg.cholesky(scatter))
            lower = np.tril_indices(D)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("cell"),
                    pa.array(n.astype(np.int64)),
                    pa.array(mean.tolist(), pa.list_(pa.float64())),
                    pa.array(whiten[:, lower[0], lower[1]].tolist(), pa.list_(pa.float64())),
                ],
                names=["cell", "n", "centre", "whiten"],
            )

    return moments.mapInArrow(solve, ESTIMATE_TYPE)


def _moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(D)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS]
    return rows.groupBy("cell").agg(F.count("*").alias("n"), *sums)


def chi_square_quantile(p: float, k: int) -> float:
    """By bisection on the regularized lower gamma function's series."""

    def below(x):
        a, term, total, n = k / 2, 1.0, 0.0, 0
        term = 1 / a
        total = term
        while term > total * 1e-16:
            n += 1
            term *= (x / 2) / (a + n)
            total += term
        return total * math.exp(-x / 2 + a * math.log(x / 2) - math.lgamma(a))

    low, high = 1e-9, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return low


def _consistency(share: float) -> float:
    """By how much the scatter of the nearest `share` of normal rows is too small."""
    if share >= 1:
        return 1.0
    q = chi_square_quantile(share, D)
    low, high = 1e-6, 1 - 1e-12
    for _ in range(100):  # P(chi2 with D + 2 <= q)
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_quantile(middle, D + 2) < q else (low, middle)
    return share / low


def _meet(rows: DataFrame, per_cell: DataFrame, small: bool) -> DataFrame:
    """Rows with what belongs to their cell. A hot cell is never one task: its rows stay where they are or are salted."""
    if small:
        return rows.join(F.broadcast(per_cell), "cell")
    salted = per_cell.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("x0", "x1", "x2"), F.lit(SALTS)).cast("int")).join(salted, ["cell", "_salt"]).drop("_salt")


def fit(rows: DataFrame) -> DataFrame:
    """(lang, source, cell, n, centre, whiten): the estimate that judges each language and source.

    `rows` has `lang`, `source` and `x0`, `x1`, ... The first core is taken around the medians, scaled by the median
    deviations; each step then keeps the nearest `CORE_SHARE` of a cell.
    """
    cells = _cells(rows)
    small = cells.count() <= BROADCAST_CELLS
    placed = store(
        rows.join(F.broadcast(cells) if small else cells, rows["lang"].eqNullSafe(cells["lang"]) & rows["source"].eqNullSafe(cells["source"])).select(
            F.explode("into").alias("cell"), *[f"x{i}" for i in range(D)]
        ),
        "quality-features",
    )
    medians = placed.groupBy("cell").agg(*[F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in range(D)])
    near = _meet(placed, medians, small)
    spread = near.groupBy("cell").agg(*[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 1000).alias(f"a{i}") for i in range(D)])
    start = medians.join(spread, "cell")
    lower = [F.lit(0.0) if i != j else 1.0 / F.greatest(1.4826 * F.col(f"a{i}"), F.lit(LEAST_SD[i])) for i in range(D) for j in range(i + 1)]
    estimate = store(
        start.select("cell", F.lit(0).cast("bigint").alias("n"), F.array(*[f"m{i}" for i in range(D)]).alias("centre"), F.array(*lower).alias("whiten")),
        "quality-start",
    )
    for _ in range(CONCENTRATION_STEPS):
        measured_rows = _meet(placed, estimate, small).select("cell", *[f"x{i}" for i in range(D)], _distance().alias("d2"))
        edge = measured_rows.groupBy("cell").agg(F.percentile_approx("d2", CORE_SHARE, 10_000).alias("edge"))
        core = _meet(measured_rows, edge, small).filter("d2 <= edge")
        estimate = store(_estimates(_moments(core), CORE_SHARE), "quality-estimate")
    return cells.drop("into").join(estimate, "cell")


def judge(docs: DataFrame, into: str, estimates: DataFrame) -> DataFrame:
    """`docs` with `{into}.kept` and `{into}.distance` beside what `measured` gave."""
    cell_of, estimate = (free_name(docs.columns, name) for name in ("_cell_of", "_estimate"))
    e = estimates.select(F.struct("lang", "source").alias(cell_of), F.struct("cell", "n", "centre", "whiten").alias(estimate))
    # The table of cells is small next to the rows; the optimizer broadcasts it by its real size or splits a hot cell.
    m = F.col(into)
    joined = docs.join(e, m["lang"].eqNullSafe(F.col(f"{cell_of}.lang")) & m["source"].eqNullSafe(F.col(f"{cell_of}.source")), "left")
    total, k = F.lit(0.0), 0
    for i in range(D):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"{estimate}.whiten")[k] * (m["x"][f"x{j}"] - F.col(f"{estimate}.centre")[j])
            k += 1
        total = total + z * z
    limit = chi_square_quantile(1 - TAIL, D)
    enough = F.coalesce(F.col(f"{estimate}.n") >= MIN_CELL_ROWS * CORE_SHARE * 0.9, F.lit(False))
    outlier = enough & F.coalesce(total > limit, F.lit(False))
    verdict = F.struct(m["counts"].alias("counts"), m["base_failed"].alias("base_failed"), total.alias("distance"), (~m["base_failed"] & ~outlier).alias("kept"))
    return joined.withColumn(into, verdict).drop(cell_of, estimate)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept), one row per row.

    Null and empty texts have no words and fail the base rule. Null languages and sources are a value like any other.
    Repeated rows are judged alike and all returned; other columns are not read. An empty table gives an empty result.
    """
    table = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    rows = store(measured(table, "text", "lang", "source", "_m").select("doc_id", "_m"), "quality-statistics")
    flat = rows.select("_m.lang", "_m.source", "_m.x.*")
    judged = judge(rows, "_m", fit(flat))
    counts = [F.col(f"_m.counts.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "_m.base_failed", "_m.distance", "_m.kept")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of `docs` that pass, with their columns as they are, whatever their names.

    Rows with null, empty or very short texts fail the base rule and go; null languages and sources are a value like any other.
    Repeated rows are judged alike. An empty table gives an empty result.

    The statistics are worked out twice, once narrow for the estimates and once to judge, so texts are never stored.
    """
    columns = docs.columns
    slim = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    rows = store(measured(slim, "text", "lang", "source", "_m").select("_m.lang", "_m.source", "_m.x.*"), "quality-statistics")
    into = free_name(columns, "_quality")
    judged = judge(measured(docs, text, lang, source, into), into, fit(rows))
    return judged.filter(F.col(into)["kept"]).select(*[F.col(f"`{c}`") for c in columns])
