"""Benchmark decontamination: find benchmark items, or near copies of them, anywhere inside documents.

Texts are sequences of words (lower case, outer punctuation removed). An item matches a document when some stretch of the
document turns into the item with at most `1 - similarity` edits per item word. Candidates come from item-sized windows:
a random walk (Chakraborty, Goldenberg, Koucky) copies a window symbol by symbol and decides by a random bit of the symbol
whether to move on, so that few edits leave many equal places; bands of sampled places are looked up in tables of the
items. How many bands are needed for the target recall is measured on edited copies of the items. Windows that hold none
of an item's d + 1 segments unchanged cannot be within d edits and are not embedded. Candidates are verified exactly.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlens.llm.common import REMEMBERED_WORDS, SHINGLE_FACTORS, as_bytes, mix, odd_numbers, store

SIMILARITY = 0.8
TARGET_RECALL = 0.995
# Items compared in one pass over the documents: a pass carries them to every task.
ITEMS_PER_PASS = 20_000
BYTES_PER_PASS = 32 << 20
MAX_BANDS = 96
BANDS_PER_WALK = 4
# Edited copies of items on which is measured how often a band meets.
PILOT_COPIES = 400
MATCHES_TYPE = "array<struct<item:int, start:bigint, end:bigint, edits:int, words:int>>"
_ARROW_TYPE = pa.list_(pa.struct([("item", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("words", pa.int32())]))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_OUTER = string.punctuation + "“”‘’«»¿¡…–—"


def normal(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(_OUTER)


def normal_words(text: bytes) -> list[str]:
    return [w for w in map(normal, text.split()) if w]


class WordIds(dict):
    """word as written -> id of its normal form; 0 for words of no item, -1 where nothing is left."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        plain = normal(word)
        value = self[word] = self.vocabulary.get(plain, 0) if plain else -1
        return value


def walk(windows: np.ndarray, lengths: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """The places a random walk copies from each window: (window, step). Past its end a window gives -1."""
    rows, at = np.arange(len(windows)), np.zeros(len(windows), np.int64)
    padded = np.concatenate([windows, np.full((len(windows), 1), -1, windows.dtype)], 1)
    out = np.empty((len(windows), steps), windows.dtype)
    factors = odd_numbers(steps, seed)
    for step in range(steps):
        symbol = padded[rows, np.minimum(at, lengths)]
        out[:, step] = symbol
        move = mix((symbol.astype(np.int64) + 2).astype(np.uint64) * factors[step]) >> np.uint64(63)
        at += move.astype(np.int64)
    return out


def bands(windows: np.ndarray, lengths: np.ndarray, n_bands: int, width: int) -> np.ndarray:
    """(window, band): a hash of `width` sampled places of the walk and of the window's length."""
    out = np.empty((len(windows), n_bands), np.uint64)
    if not len(windows):
        return out
    for first in range(0, n_bands, BANDS_PER_WALK):
        copied = walk(windows, lengths, 3 * int(lengths.max()), 7919 + first)
        rows = np.arange(len(windows))
        for band in range(first, min(n_bands, first + BANDS_PER_WALK)):
            # The walk moves at every second step on average; later steps mostly copy the end.
            places = np.random.default_rng(104729 + band).random(width) * 2.0
            value = lengths.astype(np.uint64) * SHINGLE_FACTORS[band % 60] + np.uint64(band)
            for k, place in enumerate(places):
                symbol = copied[rows, (place * lengths).astype(np.int64)]
                value = mix(value + (symbol.astype(np.int64) + 2).astype(np.uint64) * SHINGLE_FACTORS[(band + k + 1) % 60])
            out[:, band] = value
    return out


def _stack(windows: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
    out = np.full((len(windows), int(lengths.max(initial=1))), -1, np.int32)
    for row, window in enumerate(windows):
        out[row, : len(window)] = window
    return out


def allowed_edits(words: int, similarity: float) -> int:
    return int((1 - similarity) * words + 1e-9)


def plan_bands(items: list[np.ndarray], similarity: float, target: float) -> tuple[int, int]:
    """(places in a band, bands) that reach the target recall on copies with all allowed edits."""
    rng = np.random.default_rng(15485863)
    filled = [items[i] for i in rng.permutation(len(items))[:PILOT_COPIES] if len(items[i])]
    chosen = filled * -(-PILOT_COPIES // max(1, len(filled)))
    edited = []
    for item in chosen:
        copy = list(item)
        for _ in range(allowed_edits(len(item), similarity)):
            kind, at = rng.integers(3), int(rng.integers(len(copy)))
            if kind == 0:
                copy[at] = 0
            elif kind == 1:
                copy.insert(at, 0)
            elif len(copy) > 1:
                del copy[at]
        window = copy[: len(item)] + [0] * (len(item) - len(copy))
        edited.append(np.array(window, np.int32))
    if not chosen:
        return 1, 1
    lengths = np.array([len(x) for x in chosen])
    for width in (3, 2, 1):
        same = bands(_stack(chosen, lengths), lengths, MAX_BANDS, width) == bands(_stack(edited, lengths), lengths, MAX_BANDS, width)
        found = np.logical_or.accumulate(same, axis=1).mean(axis=0)
        if found[-1] >= target:
            return width, int(np.argmax(found >= target)) + 1
    return 1, MAX_BANDS


@dataclass
class Index:
    """Items of one pass: their words as ids, the segments that seed windows, the tables of bands."""

    similarity: float
    vocabulary: dict = field(default_factory=dict)
    items: list = field(default_factory=list)
    seeds: dict = field(default_factory=dict)
    tables: list = field(default_factory=list)
    width: int = 1
    n_bands: int = 1

    @classmethod
    def of(cls, texts: list[bytes], similarity: float, target: float) -> Index:
        index = cls(similarity)
        for text in texts:
            words = normal_words(text)
            index.items.append(np.array([index.vocabulary.setdefault(w, len(index.vocabulary) + 1) for w in words], np.int32))
        index.width, index.n_bands = plan_bands(index.items, similarity, target)
        by_width: dict = {}
        for number, item in enumerate(index.items):
            if not len(item):
                continue
            parts = allowed_edits(len(item), similarity) + 1
            size = len(item) // parts
            for k in range(parts):
                at = k * len(item) // parts
                by_width.setdefault(size, []).append((int(_runs(item[at : at + size], size)[0]), len(item), at))
        for size, entries in by_width.items():
            unique = sorted(set(entries))
            index.seeds[size] = (
                np.array([e[0] for e in unique], np.uint64),
                np.array([e[1] for e in unique], np.int64),
                np.array([e[2] for e in unique], np.int64),
            )
        filled = [i for i, item in enumerate(index.items) if len(item)]
        lengths = np.array([len(index.items[i]) for i in filled])
        if filled:
            keys = bands(_stack([index.items[i] for i in filled], lengths), lengths, index.n_bands, index.width)
            for band in range(index.n_bands):
                table: dict = {}
                for row, i in enumerate(filled):
                    table.setdefault(int(keys[row, band]), []).append(i)
                index.tables.append(table)
        return index


def _runs(ids: np.ndarray, width: int) -> np.ndarray:
    total = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        total += ids[k : len(ids) - width + 1 + k].astype(np.uint64) * SHINGLE_FACTORS[k]
    return mix(total)


def best_stretch(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edits, first word, end word) of the stretch of `region` nearest to `item`; ties to the earliest start, then end."""
    unit = 1 << 32
    columns = np.arange(len(region) + 1, dtype=np.int64)
    row = columns.copy()  # edits * unit + start
    slope = columns * unit
    for symbol in item:
        step = np.empty_like(row)
        step[0] = row[0] + unit
        step[1:] = np.minimum(row[1:] + unit, row[:-1] + unit * (region != symbol))
        row = np.minimum.accumulate(step - slope) + slope
    end = int(np.argmin(row))
    return int(row[end] // unit), int(row[end] % unit), end


class Finder:
    """Matches of an index in whole texts, for many texts at a time."""

    def __init__(self, index: Index):
        self.index, self.ids = index, WordIds(index.vocabulary)
        self.marks = {}
        for size, (hashes, _, _) in index.seeds.items():
            mark = np.zeros(1 << 20, bool)
            mark[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.marks[size] = mark

    def windows(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, first word, length) of windows around a segment that some item of that length has in the same place."""
        known = ids > 0
        found = set()
        for size, (hashes, lengths, offsets) in self.index.seeds.items():
            if len(ids) < size:
                continue
            inside = known[: len(ids) - size + 1].copy()
            for k in range(1, size):
                inside &= known[k : len(ids) - size + 1 + k]
            inside &= owner[: len(ids) - size + 1] == owner[size - 1 :]
            at = np.flatnonzero(inside)
            total = np.zeros(len(at), np.uint64)
            for k in range(size):
                total += ids[at + k].astype(np.uint64) * SHINGLE_FACTORS[k]
            run = mix(total)
            keep = self.marks[size][(run & np.uint64((1 << 20) - 1)).astype(np.int64)]
            at, run = at[keep], run[keep]
            low, high = np.searchsorted(hashes, run, "left"), np.searchsorted(hashes, run, "right")
            for k in range(int((high - low).max(initial=0))):
                here = low + k < high
                entry = (low + k)[here]
                found.update(zip(owner[at[here]].tolist(), (at[here] - offsets[entry]).tolist(), lengths[entry].tolist()))
        return sorted(found)

    def find(self, texts: list[bytes]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        sequences, counts = [], []
        for text in texts:
            words = list(map(self.ids.__getitem__, text.split()))
            sequences.extend(words)
            counts.append(len(words))
        raw = np.array(sequences, np.int32)
        owner = np.repeat(np.arange(len(texts)), counts)
        real = raw >= 0
        ids, owner = raw[real], owner[real]
        ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
        begins = ends - np.bincount(owner, minlength=len(texts))
        windows = self.windows(ids, begins, ends, owner)
        if not windows:
            return out
        lengths = np.array([n for _, _, n in windows])
        cut = []
        for text, first, n in windows:
            low, high = max(first, begins[text]), min(first + n, ends[text])
            cut.append(np.concatenate([np.zeros(low - first, np.int32), ids[low:high], np.zeros(max(0, first + n - max(high, low)), np.int32)])[:n])
        best: dict = {}
        for part in range(0, len(windows), 4096):
            keys = bands(_stack(cut[part : part + 4096], lengths[part : part + 4096]), lengths[part : part + 4096], self.index.n_bands, self.index.width)
            for row in range(len(keys)):
                text, first, n = windows[part + row]
                met = set()
                for band, table in enumerate(self.index.tables):
                    met.update(table.get(int(keys[row, band]), ()))
                for i in met:
                    item = self.index.items[i]
                    d = allowed_edits(len(item), self.index.similarity)
                    low, high = max(first - d, begins[text]), min(first + n + d, ends[text])
                    if np.array_equal(cut[part + row], item):
                        edits, start, end = 0, first - low, first - low + n
                    else:
                        edits, start, end = best_stretch(item, ids[low:high])
                    if edits <= d and end > start:
                        found = (edits, int(low + start - begins[text]), int(low + end - begins[text]))
                        if (text, i) not in best or found < best[text, i]:
                            best[text, i] = found
        places: dict = {}
        for (text, i), (edits, start, end) in sorted(best.items()):
            if text not in places:
                places[text] = [m.span() for m in _WORD.finditer(texts[text]) if normal(m.group())]
            first, last = places[text][start][0], places[text][end - 1][1]
            points = len(texts[text][:first].decode("utf-8", "replace"))
            span = len(texts[text][first:last].decode("utf-8", "replace"))
            out[text].append({"item": i, "start": points, "end": points + span, "edits": edits, "words": len(self.index.items[i])})
        return out


def matcher(index: Index):
    """A column function: text -> matches with the items of `index`."""

    @F.arrow_udf(returnType=MATCHES_TYPE)
    def matches(text: pa.Array) -> pa.Array:
        finder = Finder(index)
        rows = []
        for at in range(0, len(text), 256):
            rows.extend(finder.find(as_bytes(text.slice(at, 256))))
        return pa.array(rows, _ARROW_TYPE)

    # Declared not repeatable: else the optimizer works it out once more for a filter that it infers or pushes down.
    return matches.asNondeterministic()


def passes(benchmark: DataFrame, item_id: str, text: str, items: int = ITEMS_PER_PASS):
    """The items in blocks that a task can carry: lists of (id, text)."""
    table = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter("text is not null")
    n, size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // items), -(-size // BYTES_PER_PASS))
    block = F.pmod(F.xxhash64("text"), F.lit(blocks)) if blocks > 1 else F.lit(0)
    for k in range(blocks):
        yield table.filter(block == k).orderBy("item_id", "text").collect()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    recall: float = TARGET_RECALL,
    items_per_pass: int = ITEMS_PER_PASS,
) -> DataFrame:
    """(doc_id, item_id, start, end, edits, item_words, similarity): the best place of each item in each document row.

    Places count code points, end exclusive. Null and empty texts on either side match nothing; repeated documents and
    repeated items each give their rows; null ids are kept. Empty tables give an empty result; other columns are not read.
    """
    table = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = []
    for rows in passes(benchmark, item_id, item_text, items_per_pass):
        index = Index.of([r["text"].encode() for r in rows], similarity, recall)
        names = table.sparkSession.createDataFrame(
            [(k, r["item_id"]) for k, r in enumerate(rows)], f"item int, item_id {dict(benchmark.dtypes)[item_id]}"
        )
        found = table.select("doc_id", matcher(index)("text").alias("m")).select("doc_id", F.explode("m").alias("m"))
        found = found.select("doc_id", "m.*").join(F.broadcast(names), "item")
        # Bounded per pass; a pass is stored before the next so that the driver holds the items of one only.
        parts.append(found if len(rows) < items_per_pass and not parts else store(found, "decontaminate"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "item_id", "start", "end", "edits", F.col("words").alias("item_words"), (1 - F.col("edits") / F.col("words")).alias("similarity"))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, recall: float = TARGET_RECALL
) -> DataFrame:
    """The rows of `docs` that hold no item, with their columns as they are."""
    for k, rows in enumerate(passes(benchmark, item_id, item_text)):
        index = Index.of([r["text"].encode() for r in rows], similarity, recall)
        docs = (store(docs, "decontaminate") if k else docs).filter(F.size(matcher(index)(F.col(text))) == 0)
    return docs
