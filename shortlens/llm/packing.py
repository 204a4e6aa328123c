"""Packing: documents as token ids into sequences of a fixed capacity by multiway differencing (Karmarkar and Karp).

A document is cut into whole sequences and a rest. A task encodes what it reads and packs rests that follow each other in
groups of bounded size, so ids never travel. In a group every rest starts as a partition of its own into k windows with one window filled; the two partitions that are most
uneven are merged, the fullest window of one onto the emptiest of the other, until one partition is left, whose windows
are nearly equal. If its fullest window exceeds the capacity, k rises by one and the group is done again.
"""

from __future__ import annotations

import heapq
import itertools
import re
import sys
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlens.llm.common import as_bytes, process_memory, slices

CAPACITY = 4096
END_ID = 2
# A group is at most about this many sequences and pieces.
GROUP_SEQUENCES = 256
GROUP_PIECES = 20_000
# Words a Python process remembers.
KNOWN_CHUNKS = 100_000
KNOWN_WORDS = 200_000
# Bytes of text a task should have, for some groups; ids of one Arrow batch.
PART_BYTES = 1 << 22
BATCH_TOKENS = 1 << 20
# Letters, then marks other than an apostrophe, which may begin a contraction.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space and never joins across it, each distinct word encoded once.

    Words of plain letters go straight to the tokenizer's merges; all other words go through the whole tokenizer, as they
    are. Ids are kept as bytes, so that a text's ids are one join.
    """

    def __init__(self, path: str):
        memory = process_memory(f"words of {path}")
        if not memory:
            from tokenizers import Tokenizer

            memory |= {"tokenizer": Tokenizer.from_file(path), "chunks": {}, "words": {}}
        self.tokenizer, self.chunks, self.words = memory["tokenizer"], memory["chunks"], memory["words"]
        self.merge = self.tokenizer.model.tokenize
        self.letters = {b: c for b, c in enumerate(byte_letters())}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32).tobytes()

    def _word(self, word: str) -> bytes:
        plain = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return b"".join(t.id.to_bytes(4, sys.byteorder) for t in self.merge(plain))

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        match = _PLAIN.fullmatch(text.lower()) if len(text) < 64 else None
        if not match:
            return self._encode(text)
        word, marks = match.groups()
        ids = self.words.get(word)
        if ids is None:
            ids = self._word(word)
            if len(self.words) < KNOWN_WORDS:
                self.words[word] = ids
        if marks:
            tail = self.words.get(marks)
            if tail is None:
                tail = self._encode(marks)
                if len(self.words) < KNOWN_WORDS:
                    self.words[marks] = tail
            ids += tail
        return ids

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [text.split() for text in texts]
        needed = set(itertools.chain.from_iterable(split))
        known, room = {}, KNOWN_CHUNKS - len(self.chunks)
        for chunk in needed:
            ids = self.chunks.get(chunk)
            if ids is None:
                ids = self._chunk(chunk)
                if room > 0:
                    self.chunks[chunk], room = ids, room - 1
            known[chunk] = ids
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in split]


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each piece."""
    n = len(sizes)
    parent = np.arange(n)
    heap = []
    for piece in np.argsort(-sizes, kind="stable").tolist():
        sums, bins = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], bins[0] = sizes[piece], piece  # fullest window first
        heap.append((-int(sizes[piece]) if k > 1 else 0, len(heap), sums, bins))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, sums, bins = heapq.heappop(heap)
        _, _, other, more = heapq.heappop(heap)
        other, more = other[::-1], more[::-1]
        both = (bins >= 0) & (more >= 0)
        parent[more[both]] = bins[both]
        bins = np.where(bins >= 0, bins, more)
        sums = sums + other
        order = np.argsort(-sums, kind="stable")
        sums, bins = sums[order], bins[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), serial, sums, bins))
        serial += 1
    bins = heap[0][3] if heap else np.zeros(0, np.int64)
    while True:  # every piece to the root of its window
        above = parent[parent]
        if np.array_equal(above, parent):
            break
        parent = above
    window = np.zeros(n, np.int64)
    filled = np.flatnonzero(bins >= 0)
    window[parent[bins[filled]]] = filled
    return window[parent]


def pack_rests(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece, as few windows as differencing manages within the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, sizes).max(initial=0) <= capacity:
            return window
        k += 1


class Waiting:
    """Documents a task has encoded and not yet packed: whole sequences leave at once, rests wait for their group."""

    def __init__(self, partition: int, capacity: int):
        self.capacity, self.next = capacity, partition << 32
        self.rests: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        """(doc_id, start, ids, doc_tokens, sequence_id, offset) of the whole sequences of a document."""
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            yield doc_id, start, ids[start : start + self.capacity], len(ids), self.next, 0
            self.next += 1
        if whole < len(ids):
            self.rests.append((doc_id, whole, ids[whole:], len(ids)))
            self.tokens += len(ids) - whole

    def full(self) -> bool:
        # Twice a group, so that what is left at the end is a whole group too.
        return self.tokens >= 2 * GROUP_SEQUENCES * self.capacity or len(self.rests) >= 2 * GROUP_PIECES

    def pack(self, everything: bool = False) -> Iterator[tuple]:
        """Pack the first half of the rests, or all."""
        group, self.rests = (self.rests, []) if everything else (self.rests[: len(self.rests) // 2], self.rests[len(self.rests) // 2 :])
        self.tokens = sum(len(r[2]) for r in self.rests)
        sizes = np.array([len(r[2]) for r in group], np.int64)
        window = pack_rests(sizes, self.capacity)
        order = np.argsort(window, kind="stable")
        last, offset = -1, 0
        for i in order.tolist():
            if window[i] != last:  # windows that stay empty get no number
                self.next, offset, last = self.next + (last >= 0), 0, int(window[i])
            doc_id, start, ids, doc_tokens = group[i]
            yield doc_id, start, ids, doc_tokens, self.next, offset
            offset += len(ids)
        self.next += last >= 0


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset): one row per piece, each id in exactly one piece.

    Null and empty texts are the end id alone. Repeated rows and null ids are documents of their own; very long texts are
    encoded whole. A sequence never exceeds `capacity`; offsets run gapless from 0. `ids_crc32` is of the ids as unsigned
    little-endian 32-bit numbers; `with_ids=False` leaves the ids themselves out. An empty table gives an empty result; other
    columns are not read. A task packs what it reads, so parts that are too small to be packed well are read together.
    """
    from pyspark import TaskContext

    table = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = table.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    table = table.coalesce(max(1, size // PART_BYTES))
    kind = table.schema["doc_id"].dataType
    schema = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def batch(pieces: list[tuple], ids_type: pa.DataType) -> pa.RecordBatch:
        doc_ids, starts, ids, counts, sequences, offsets = zip(*pieces)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        numbers = [starts, lengths, [zlib.crc32(np.ascontiguousarray(x, "<i4")) for x in ids], counts, sequences, offsets]
        columns = [pa.array(doc_ids, ids_type), *[pa.array(x, pa.int64()) for x in numbers]]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, waiting, out, held, ids_type = WordEncoder(path), Waiting(TaskContext.get().partitionId(), capacity), [], 0, None
        for part in slices(batches):
            ids_type = part.column(0).type
            for number, ids in zip(part.column(0).to_pylist(), words.encode(as_bytes(part.column(1)))):
                ready = list(waiting.add(number, np.append(ids, np.int32(end_id))))
                if waiting.full():
                    ready += waiting.pack()
                out += ready
                held += sum(len(piece[2]) for piece in ready)
                if held >= BATCH_TOKENS:
                    yield batch(out, ids_type)
                    out, held = [], 0
        out += waiting.pack(everything=True)
        if out:
            yield batch(out, ids_type)

    ids = ", ids array<int>" if with_ids else ""
    pieces = table.mapInArrow(run, f"doc_id {kind.simpleString()}, {schema}{ids}")
    return pieces.select("doc_id", "start", "length", *(["ids"] if with_ids else []), "ids_crc32", "doc_tokens", "sequence_id", "offset")
