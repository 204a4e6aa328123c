"""Quality by compression: a text resembles the kind of text whose dictionary makes it smaller.

Two zstandard dictionaries are trained, one on pieces of good labelled texts, one on pieces of bad ones. A text is compressed piece by
piece with either; the difference of the two sizes over the length of the text is its one number. A logistic curve, fitted to
labelled texts that no dictionary has seen, turns the number into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shortlens.llm.common import as_bytes
from shortlens.llm.toxicity import fit_curve

# Bytes compressed at a time. In a long piece its own beginning would tell more than the dictionary does.
PIECE = 512
DICTIONARY = 65_536
LEVEL = 3
# Labelled texts of each label, half for the dictionaries and half for the curve, and the pieces a dictionary is trained on.
SAMPLE_PER_LABEL = 4_000
SAMPLE_PIECES = 8_000
# A dictionary needs this many times its size in pieces; with less it is made smaller.
PIECES_PER_BYTE = 8
THRESHOLD = 0.5


@dataclass
class Model:
    """Dictionaries (good, bad) as bytes and the curve over the difference; without dictionaries every score is a half."""

    good: bytes
    bad: bytes
    weights: list[float]
    centre: list[float]
    spread: list[float]

    def probability(self, difference: np.ndarray) -> np.ndarray:
        z = (difference - self.centre[0]) / self.spread[0] * self.weights[1] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def pieces_of(text: bytes) -> list[bytes]:
    return [text[at : at + PIECE] for at in range(0, len(text), PIECE)]


def compressor(dictionary: bytes):
    """bytes -> compressed size with the dictionary."""
    import zstandard

    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary), "write_content_size": False, "write_dict_id": False}
    compress = zstandard.ZstdCompressor(level=LEVEL, **options).compress
    return lambda piece: len(compress(piece))


def size_difference(text: Column, good: bytes, bad: bytes) -> Column:
    """Bytes saved by the good dictionary over the bad one, a byte of text; 0 for null and empty texts. Whole texts count."""

    @F.arrow_udf(returnType="double")
    def difference(text: pa.Array) -> pa.Array:
        with_good, with_bad = compressor(good), compressor(bad)
        out = []
        for at in range(0, len(text), 256):
            for raw in as_bytes(text.slice(at, 256)):
                parts = pieces_of(raw)
                out.append((sum(map(with_bad, parts)) - sum(map(with_good, parts))) / len(raw) if raw else 0.0)
        return pa.array(out, pa.float64())

    return difference(text)


@F.arrow_udf(returnType=T.ArrayType(T.BinaryType()))
def _pieces(text: pa.Array) -> pa.Array:
    return pa.array([pieces_of(raw) for raw in as_bytes(text)], pa.list_(pa.binary()))


def train_dictionary(pieces: list[bytes]) -> bytes | None:
    """A dictionary of at most `DICTIONARY` bytes; None where the pieces are too few or too alike."""
    import zstandard

    size = min(DICTIONARY, sum(map(len, pieces)) // PIECES_PER_BYTE)
    while size >= 1_024:
        try:
            return zstandard.train_dictionary(size, pieces).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return None


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Dictionaries and curve from at most `per_label` labelled texts of each label, the first by a hash of the id.

    Label 1 is good, 0 bad; other labels, null ids and texts without words are left out, a repeated label counts once. The
    driver holds at most `SAMPLE_PIECES` pieces of each label. Where a label has too little text for a dictionary, every score is a half.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("good")).filter("id IS NOT NULL AND good IN (0, 1)")
    known = known.groupBy("id").agg(F.min("good").alias("good"))
    parts = [known.filter(F.col("good") == k).orderBy(F.xxhash64("id"), "id").limit(per_label) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * per_label rows of two numbers
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(chosen, "id").filter("text <> ''")
    for_curve = F.pmod(F.shiftright(F.xxhash64("id"), 7), F.lit(2)) == 1
    pieces = texts.filter(~for_curve).select("good", F.explode(_pieces("text")).alias("piece")).distinct()
    dictionaries = []
    for k in (1, 0):
        rows = pieces.filter(F.col("good") == k).orderBy(F.xxhash64("piece"), "piece").limit(SAMPLE_PIECES).collect()
        dictionaries.append(train_dictionary([bytes(r["piece"]) for r in rows]))
    good, bad = dictionaries
    if good is None or bad is None:
        return Model(b"", b"", [0.0, 0.0], [0.0], [1.0])
    # At most 2 * per_label rows, unless ids repeat in `docs`; one row an id and difference.
    seen = texts.filter(for_curve).select("id", size_difference(F.col("text"), good, bad).alias("x"), "good").groupBy("id").agg(F.avg("x"), F.min("good"))
    table = np.array([(r[1], r[2]) for r in seen.collect()], float).reshape(-1, 2)
    if len(set(table[:, 1])) < 2:
        return Model(good, bad, [0.0, 1.0], [0.0], [0.1])
    return Model(good, bad, *fit_curve(table[:, :1], table[:, 1]))


def score_quality(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted): one row per row of `docs`; the score is the chance that the text is good.

    Only the text decides. Null and empty texts have no size and get the curve's value at 0. Very long texts are compressed
    whole. Repeated rows score alike; null ids are kept. An empty table gives an empty result; other columns are not read.
    """
    if not model.good:
        score = F.lit(0.5)
    else:

        @F.arrow_udf(returnType="double")
        def curve(difference: pa.Array) -> pa.Array:
            return pa.array(model.probability(difference.to_numpy(zero_copy_only=False)))

        score = curve(size_difference(F.col(text), model.good, model.bad))
    scored = docs.select(F.col(doc_id).alias("doc_id"), score.alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
