"""Ranked lexical search: an inverted index in shards, searched by MaxScore with maxima of blocks.

The index keeps, per shard of documents, one posting list a term, cut into compressed blocks of 128 postings. Beside each block stand its
first and last document and the frontier of its (frequency, length) pairs: the pairs no other pair of the block beats in
both. From the frontier follows the exact highest score of the block, whatever the collection's totals turn out to be.

A search shares out lists by shard. In a shard the bounds of whole lists part the essential lists of an item from
those that cannot lift a document into its best ten on their own. Documents come from essential lists; maxima of
blocks of the others turn most of them away before a block is unpacked. The best of all shards are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shortlens.llm.common import as_bytes, slices, store
from shortlens.runtime import BROADCAST_ROWS

BLOCK = 128
# A shard ends at so many documents or occurrences of terms; it is what a task holds and searches at a time.
SHARD_DOCS = 65_536
SHARD_TERMS = 4_000_000
# Documents of a shard scored together; the threshold rises between windows.
WINDOW = 8_192
# Search items of one block; a shard meets one block at a time.
ITEMS = 1_000
# Terms of one Arrow batch of the index.
BATCH_TERMS = 8_192
# Weight of length against frequency, as in the ranking formula: score = w * (SCALE * tf div (1000 * tf + 8 * m)).
SCALE = 1_000_000_000

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
# Separators to blanks, capitals to small letters; a code point beyond ASCII has no such byte in its UTF-8.
TO_TERMS = bytes(0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

INDEX_TYPE = (
    "shard bigint, term binary, count bigint, total bigint, firsts array<int>, lasts array<int>, offsets array<int>, widths array<int>, "
    "front_block array<int>, front_tf array<int>, front_n array<int>, data binary, docs array<bigint>, lengths array<int>"
)


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and anything beyond ASCII; A-Z in lower case."""
    return text.translate(TO_TERMS).split()


@F.arrow_udf(returnType=T.ArrayType(T.BinaryType()))
def distinct_terms(text: pa.Array) -> pa.Array:
    return pa.array([sorted(set(terms_of(t))) for t in as_bytes(text)], pa.list_(pa.binary()))


class _Numbers(dict):
    """term -> number, in order of first use."""

    def __missing__(self, term: bytes) -> int:
        number = self[term] = len(self)
        return number


def _lists(offsets: np.ndarray, values: np.ndarray, kind=pa.int32()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def frontier(block: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows, by block, whose (tf, n) no other row of the block beats with a higher tf and a lower or equal n."""
    order = np.lexsort((-tf, n, block))
    step = np.int64(1) << 32
    level = block[order].astype(np.int64) * step + tf[order]
    highest = np.maximum.accumulate(level)
    keep = np.append(True, level[1:] > highest[:-1]) if len(level) else np.zeros(0, bool)
    return order[keep]


def pack_blocks(values: np.ndarray, more: np.ndarray, starts: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offset of each block and the end, width code): per block all `values`, then all `more`, in 1, 2 or 4 bytes each."""
    count = np.diff(np.append(starts, len(values)))

    def width(x: np.ndarray) -> np.ndarray:
        top = np.maximum.reduceat(x, starts)
        return np.where(top < 256, 1, np.where(top < 65_536, 2, 4))

    first, second = width(values), width(more)
    offsets = np.concatenate([[0], np.cumsum(count * (first + second))])
    out = np.zeros(int(offsets[-1]), np.uint8)
    place = np.arange(len(values)) - starts[block]
    for numbers, size, begin in ((values, first, offsets[:-1]), (more, second, offsets[:-1] + count * first)):
        for w in (1, 2, 4):
            chosen = np.flatnonzero(size[block] == w)
            at = begin[block[chosen]] + place[chosen] * w
            for byte in range(w):
                out[at + byte] = (numbers[chosen] >> (8 * byte)) & 255
    return out, offsets, first + 8 * second


class ShardBuilder:
    """Gathers documents until a shard is full, then gives its posting lists."""

    def __init__(self):
        self.terms, self.ids, self.doc_ids, self.lengths, self.total = _Numbers(), [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = terms_of(text)
        if not words:
            return  # counts nowhere and can match nothing
        self.ids.append(np.fromiter(map(self.terms.__getitem__, words), np.int32, len(words)))
        self.doc_ids.append(doc_id)
        self.lengths.append(len(words))
        self.total += len(words)

    def full(self) -> bool:
        return self.total >= SHARD_TERMS or len(self.doc_ids) >= SHARD_DOCS

    def batches(self, shard: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The head of the shard (its documents in order of their ids, null last) and its lists, terms in byte order."""
        n = len(self.doc_ids)
        order = sorted(range(n), key=lambda i: (self.doc_ids[i] is None, self.doc_ids[i] or 0))
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        lengths = np.array(self.lengths, np.int64)
        yield self._head(shard, [self.doc_ids[i] for i in order], lengths[order], schema)
        names = sorted(self.terms)
        rank = np.empty(len(names), np.int64)
        rank[[self.terms[name] for name in names]] = np.arange(len(names))
        keys = rank[np.concatenate(self.ids)] * n + np.repeat(number, lengths)
        self.ids = []
        keys.sort()
        opens = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        tf = np.diff(np.append(opens, len(keys)))
        term, doc = np.divmod(keys[opens], n)
        del keys
        begin = np.searchsorted(term, np.arange(len(names) + 1))
        within = np.arange(len(term)) - begin[term]
        starts = np.flatnonzero(within % BLOCK == 0)
        block = np.cumsum(within % BLOCK == 0) - 1
        ends = np.append(starts[1:], len(term)) - 1
        gaps = np.append(0, np.diff(doc))
        gaps[starts] = 0
        data, offsets, widths = pack_blocks(gaps, tf - 1, starts, block)
        front = frontier(block, tf, lengths[order][doc])
        block_begin = np.searchsorted(term[starts], np.arange(len(names) + 1))
        front_begin = np.searchsorted(term[front], np.arange(len(names) + 1))
        for low in range(0, len(names), BATCH_TERMS):
            high = min(low + BATCH_TERMS, len(names))
            b0, b1, f0, f1 = block_begin[low], block_begin[high], front_begin[low], front_begin[high]
            of_term = term[starts[b0:b1]]
            in_block, in_front = block_begin[low : high + 1] - b0, front_begin[low : high + 1] - f0
            chosen = front[f0:f1]
            size, none = high - low, pa.nulls(high - low)
            cuts = offsets[block_begin[low : high + 1]]
            columns = {
                "shard": pa.array(np.full(size, shard)),
                "term": pa.array(names[low:high], pa.binary()),
                "count": pa.array(np.diff(begin[low : high + 1])),
                "total": pa.array(np.zeros(size, np.int64)),
                "firsts": _lists(in_block, doc[starts[b0:b1]].astype(np.int32)),
                "lasts": _lists(in_block, doc[ends[b0:b1]].astype(np.int32)),
                "offsets": _lists(in_block, (offsets[b0:b1] - offsets[block_begin[of_term]]).astype(np.int32)),
                "widths": _lists(in_block, widths[b0:b1].astype(np.int32)),
                "front_block": _lists(in_front, (block[chosen] - block_begin[term[chosen]]).astype(np.int32)),
                "front_tf": _lists(in_front, tf[chosen].astype(np.int32)),
                "front_n": _lists(in_front, lengths[order][doc[chosen]].astype(np.int32)),
                "data": pa.array([data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                "docs": none.cast(pa.list_(pa.int64())),
                "lengths": none.cast(pa.list_(pa.int32())),
            }
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)

    def _head(self, shard: int, doc_ids: list, lengths: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        row = dict.fromkeys(schema.names)
        row |= {"shard": shard, "count": len(doc_ids), "total": int(lengths.sum()), "docs": doc_ids, "lengths": lengths.tolist()}
        return pa.RecordBatch.from_pylist([row], schema=schema)


def _arrow_schema() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split(" ") for part in INDEX_TYPE.split(", "))])


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The index of all rows of `docs`, stored at `path` (or for this application only) and read back.

    Null texts and texts without a term are in no list. Repeated rows and null ids are documents of their own; ids must be
    whole numbers. Very long texts are read whole. An empty table gives an empty index; other columns are not read.
    """
    from pyspark import TaskContext

    schema = _arrow_schema()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, builder = TaskContext.get().partitionId() << 32, ShardBuilder()
        for part in slices(batches):
            for number, raw in zip(part.column(0).to_pylist(), as_bytes(part.column(1))):
                builder.add(number, raw)
                if builder.full():
                    yield from builder.batches(shard, schema)
                    shard, builder = shard + 1, ShardBuilder()
        if builder.doc_ids:
            yield from builder.batches(shard, schema)

    lists = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, INDEX_TYPE)
    if path is None:
        return store(lists, "search-index")
    lists.write.parquet(path)
    return docs.sparkSession.read.schema(INDEX_TYPE).parquet(path)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf // (1000 * tf + 8 * m)


class PostingList:
    """One list of a shard. Blocks are unpacked when a document in them must be scored, once for all items."""

    def __init__(self, row, weight: int, m: np.ndarray, documents: int, occurrences: int):
        self.m, self.weight, self.data = m, weight, row.data
        self.firsts, self.lasts = np.asarray(row.firsts, np.int64), np.asarray(row.lasts, np.int64)
        self.offsets, self.widths, self.count = row.offsets, row.widths, int(row.count)
        n = np.asarray(row.front_n, np.int64)
        highest = weight * impact(np.asarray(row.front_tf, np.int64), 10 + 90 * n * documents // occurrences)
        owner = np.asarray(row.front_block)
        self.tops = np.maximum.reduceat(highest, np.flatnonzero(np.append(True, owner[1:] != owner[:-1])))
        self.bound = int(self.tops.max())
        # A packed block stands as copies of its last document, so that the whole list stays sorted.
        self.docs = np.repeat(self.lasts, BLOCK)[: self.count]
        self.scores = np.zeros(self.count, np.int64)
        self.open = np.zeros(len(self.lasts), bool)

    def unpack(self, blocks: np.ndarray) -> None:
        for b in blocks[~self.open[blocks]].tolist():
            low, high = b * BLOCK, min((b + 1) * BLOCK, self.count)
            first, second = int(self.widths[b]) % 8, int(self.widths[b]) // 8
            at, size = int(self.offsets[b]), high - low
            gaps = np.frombuffer(self.data, f"<u{first}", size, at)
            tf = np.frombuffer(self.data, f"<u{second}", size, at + size * first).astype(np.int64) + 1
            docs = self.firsts[b] + np.cumsum(gaps, dtype=np.int64)
            self.docs[low:high], self.scores[low:high] = docs, self.weight * impact(tf, self.m[docs])
            self.open[b] = True

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the postings in [low, high)."""
        b0, b1 = np.searchsorted(self.lasts, low), np.searchsorted(self.firsts, high)
        self.unpack(np.arange(b0, b1))
        part = slice(b0 * BLOCK, min(b1 * BLOCK, self.count))
        docs = self.docs[part]
        inside = slice(*np.searchsorted(docs, [low, high]))
        return docs[inside], self.scores[part][inside]

    def tops_at(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block each document could stand in (-1: none) and that block's highest score."""
        block = np.searchsorted(self.lasts, docs)
        inside = block < len(self.lasts)
        inside[inside] = self.firsts[block[inside]] <= docs[inside]
        block = np.where(inside, block, -1)
        return block, np.where(inside, self.tops[block], 0)

    def scores_at(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        asked = np.flatnonzero(block >= 0)
        if len(asked):
            self.unpack(np.unique(block[asked]))
            at = np.minimum(np.searchsorted(self.docs, docs[asked]), self.count - 1)
            out[asked] = np.where(self.docs[at] == docs[asked], self.scores[at], 0)
        return out


def _best(docs: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(docs) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows = np.flatnonzero(scores >= least)
        return rows[np.lexsort((docs[rows], -scores[rows]))[:k]]
    return np.lexsort((docs, -scores))[:k]


def search_shard(lists: list[PostingList], documents: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best by score, then by document; documents are numbers within the shard."""
    lists = sorted((one for one in lists if one.bound > 0), key=lambda one: one.bound)
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not lists:
        return found, scores
    sums = np.cumsum([one.bound for one in lists])
    need = 1
    # The most promising block sets a first threshold.
    lead = lists[-1]
    peak = int(lead.tops.argmax())
    lead.unpack(np.array([peak]))
    docs = lead.docs[peak * BLOCK : (peak + 1) * BLOCK]
    if len(docs) >= k:
        total = sum(one.scores_at(docs, one.tops_at(docs)[0]) for one in lists)
        need = max(need, int(np.partition(total, len(total) - k)[len(total) - k]))
    for low in range(0, documents, WINDOW):
        high = min(low + WINDOW, documents)
        essential = int(np.searchsorted(sums, need))  # lists before it cannot reach the threshold together
        if essential == len(lists):
            break
        total = np.zeros(high - low, np.int64)
        for one in lists[essential:]:
            docs, part = one.between(low, high)
            total[docs - low] += part
        rest = int(sums[essential - 1]) if essential else 0
        docs = np.flatnonzero((total > 0) & (total + rest >= need))
        total, docs = total[docs], docs + low
        if essential and len(docs):
            at = [one.tops_at(docs) for one in lists[:essential]]
            above = total + sum(top for _, top in at)
            live = np.flatnonzero(above >= need)
            for i in reversed(range(essential)):
                if not len(live):
                    break
                block, top = at[i]
                part = lists[i].scores_at(docs[live], block[live])
                total[live] += part
                above[live] += part - top[live]
                live = live[above[live] >= need]
            docs, total = docs[live], total[live]
        found, scores = np.append(found, docs), np.append(scores, total)
        keep = _best(found, scores, k)
        found, scores = found[keep], scores[keep]
        if len(found) == k:
            need = max(need, int(scores[-1]) + 1)  # later documents must be better, not as good
    return found, scores


def _searcher(k: int, documents: int, occurrences: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows[rows["term"].isna()].iloc[0]
        lengths = np.asarray(head["lengths"], np.int64)
        m = 10 + 90 * lengths * documents // occurrences
        of_item: dict[int, list] = {}
        for row in rows[rows["term"].notna()].itertuples(index=False):
            weight = math.floor(1000 * math.log((2 * documents + 2) / (2 * int(row.df) + 1)))
            one = PostingList(row, weight, m, documents, occurrences)
            for item in row.items:
                of_item.setdefault(int(item), []).append(one)
        out = []
        for item, lists in of_item.items():
            out += [(item, int(d), int(s)) for d, s in zip(*search_shard(lists, len(lengths), k))]
        answer = pd.DataFrame(out, columns=["item", "doc", "score"], dtype="int64")
        ids = head["docs"]
        answer["doc_id"] = pd.array([None if pd.isna(ids[d]) else int(ids[d]) for d in answer["doc"]], dtype="Int64")
        return answer[["item", "doc_id", "score"]]

    return run


def _small(words: DataFrame) -> DataFrame:
    """The terms of all items, broadcast while few, so that lists of other terms go nowhere."""
    return F.broadcast(words) if words.count() <= BROADCAST_ROWS else words


def search(index: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every row of `items` with a score above 0.

    Equal scores go by ascending doc_id, null ids last. Items without a term, or with none that a document holds, have no
    rows; repeated and null item ids are items of their own. Items are searched in blocks against all shards. An empty
    index or no items: an empty result; other columns are not read.
    """
    asked = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), distinct_terms(F.col(text)).alias("terms"))
    asked = store(asked, "search-items")
    blocks = max(1, -(-asked.count() // ITEMS))
    heads = index.filter("term IS NULL")
    documents, occurrences = heads.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    number = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    words = asked.select("item", number.alias("part"), F.explode("terms").alias("term"))
    # At most about ITEMS numbers a row.
    words = _small(store(words.groupBy("part", "term").agg(F.collect_list("item").alias("items")), "search-words"))
    held = index.filter("term IS NOT NULL").select("term", "count")
    df = held.join(words.select("part", "term"), "term").groupBy("part", "term").agg(F.sum("count").alias("df"))
    known = _small(store(words.join(df, ["part", "term"]), "search-terms"))
    lists = index.filter("term IS NOT NULL").drop("docs", "lengths", "total").join(known, "term")
    parts = heads.select("shard", "docs", "lengths", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"))
    rows = lists.unionByName(parts, allowMissingColumns=True)
    best = rows.groupBy("shard", "part").applyInPandas(_searcher(k, documents, occurrences), "item bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
