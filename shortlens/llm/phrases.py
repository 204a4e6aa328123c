"""Phrase collocations: frequent word sequences counted in hash tries and scored by their weakest cut.

A task counts into a trie whose upper levels are word ids and whose leaves are hash containers of the words that follow. A
container that grows too large bursts: it becomes a node with a container for each next word. When the trie is full its
largest subtrees leave as sorted runs; runs are merged per prefix of the phrase.

Phrases are counted length by length. A sequence can only be frequent if the two sequences one word shorter inside it are, so
each length reads only the stretches of text that the length before leaves possible. Which sequences were frequent travels as a bit table of
bounded size that may say yes too often, which costs time, and never says no wrongly.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shortlens.llm.common import SHINGLE_FACTORS, as_bytes, mix, store

MIN_COUNT = 100
LONGEST = 5
PER_LANGUAGE = 2_000
# A shorter phrase goes when a longer one around it is at least this share (percent) as frequent.
COVERED = 100
UNKNOWN = "und"

# Entries of a container before it bursts, entries of a trie before subtrees leave.
BURST = 4_096
CAPACITY = 400_000
# Words a task numbers before it starts anew; with one word a phrase, words times languages.
KNOWN_WORDS = 600_000
# Bytes of texts counted at a time; bytes of all texts for each part in which runs are merged.
SLICE_BYTES = 1 << 22
PART_BYTES = 1 << 24
# Bits of a table of frequent sequences, for each of them and at most; probes for each.
BITS_PER_ENTRY = 16
MOST_BITS = 1 << 27
PROBES = 4
COUNT_TYPE = "lang string, phrase string, f bigint"
COUNT_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

# Capitals to small letters, tabs to blanks, marks that end a piece to line ends.
TO_PIECES = bytes(0x0A if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 9 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
BREAK, BLANK = -1, -2


class Words(dict):
    """word (bytes) -> number; line ends are breaks, what stands between two blanks is nothing."""

    def __init__(self):
        super().__init__({b"\n": BREAK, b"": BLANK})
        self.names: list[bytes] = []
        self._hashes = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        self.names.append(word)
        return number

    def read(self, text: bytes) -> np.ndarray:
        parts = text.translate(TO_PIECES).replace(b"\n", b" \n ").split(b" ")
        numbers = np.fromiter(map(self.__getitem__, parts), np.int32, len(parts))
        return numbers[numbers != BLANK]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, by number."""
        new = self.names[len(self._hashes) :]
        if new:
            self._hashes = np.append(self._hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new)))
        return self._hashes

    def phrases(self, rows: np.ndarray) -> pa.Array:
        """The words of each row of numbers, joined by blanks."""
        names = pa.array(self.names, pa.binary())
        columns = [names.take(pa.array(np.ascontiguousarray(rows[:, k]))) for k in range(rows.shape[1])]
        return pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())) if len(columns) > 1 else columns[0]


def sequence_hashes(lang: bytes, columns: list[np.ndarray]) -> np.ndarray:
    """One hash a sequence, from the hashes of its first, second … words and its language."""
    total = np.full(len(columns[0]), xxhash.xxh64_intdigest(lang), np.uint64)
    for factor, column in zip(SHINGLE_FACTORS, columns):
        total += column * factor
    return mix(total)


def row_keys(rows: np.ndarray) -> list[bytes]:
    return np.ascontiguousarray(rows, np.int32).view(f"V{4 * rows.shape[1]}").ravel().tolist()


def groups(column: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, behind the last) of every stretch of equal values."""
    opens = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    return zip(opens.tolist(), np.append(opens[1:], len(column)).tolist())


class HashTrie:
    """Counts of word sequences of one length, two words or more, of one or more languages.

    The first level is (language, word). Below it is a container, a counter of the words that follow, as bytes; a container
    that burst is a dict from the second word to smaller containers.
    """

    def __init__(self, length: int, burst: int = BURST, capacity: int = CAPACITY):
        self.length, self.burst, self.capacity = length, burst, capacity
        self.root: dict[tuple[bytes, int], Counter | dict] = {}
        self.sizes: Counter = Counter()
        self.entries = 0

    def add(self, lang: bytes, rows: np.ndarray) -> None:
        """Count the rows of a matrix of word numbers."""
        if not len(rows):
            return
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        rests = row_keys(rows[:, 1:])
        deeper = None
        for low, high in groups(rows[:, 0]):
            key = lang, int(rows[low, 0])
            node = self.root.get(key)
            if node is None:
                node = self.root[key] = Counter()
            if isinstance(node, Counter):
                before = len(node)
                node.update(rests[low:high])
                grown = len(node) - before
                if len(node) > self.burst and self.length > 2:
                    self.root[key] = self._burst(node)
            else:
                grown = 0
                if deeper is None:
                    deeper = row_keys(rows[:, 2:])
                for a, b in groups(rows[low:high, 1]):
                    container = node.setdefault(int(rows[low + a, 1]), Counter())
                    before = len(container)
                    container.update(deeper[low + a : low + b])
                    grown += len(container) - before
            self.sizes[key] += grown
            self.entries += grown

    @staticmethod
    def _burst(container: Counter) -> dict[int, Counter]:
        node: dict[int, Counter] = {}
        for rest, count in container.items():
            node.setdefault(int.from_bytes(rest[:4], sys.byteorder), Counter())[rest[4:]] = count
        return node

    def overflow(self) -> dict[bytes, list[int]]:
        """By language, the first words of the largest subtrees; without them a full trie is half full."""
        leave: dict[bytes, list[int]] = {}
        left = self.entries
        if left > self.capacity:
            for (lang, word), size in self.sizes.most_common():
                if left <= self.capacity // 2:
                    break
                leave.setdefault(lang, []).append(word)
                left -= size
        return leave

    def everything(self) -> dict[bytes, list[int]]:
        leave: dict[bytes, list[int]] = {}
        for lang, word in self.root:
            leave.setdefault(lang, []).append(word)
        return leave

    def take(self, lang: bytes, words: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Remove the subtrees of these first words: rows of word numbers, and counts."""
        containers: dict[int, list[tuple[tuple[int, ...], Counter]]] = {}  # by the length of their path
        for word in words:
            node = self.root.pop((lang, word))
            self.entries -= self.sizes.pop((lang, word))
            if isinstance(node, Counter):
                containers.setdefault(1, []).append(((word,), node))
            else:
                containers.setdefault(2, []).extend(((word, second), c) for second, c in node.items())
        rows, counts = [], []
        for depth, parts in containers.items():
            sizes = [len(c) for _, c in parts]
            heads = np.repeat(np.array([path for path, _ in parts], np.int32), sizes, axis=0)
            rests = np.frombuffer(b"".join(chain.from_iterable(c for _, c in parts)), np.int32)
            rows.append(np.hstack([heads, rests.reshape(-1, self.length - depth)]))
            counts.append(np.fromiter(chain.from_iterable(c.values() for _, c in parts), np.int64, sum(sizes)))
        return np.concatenate(rows), np.concatenate(counts)


class BitTable:
    """Membership of (language, sequence) by their hashes, with false alarms and no misses."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in probes(hashes, self.bits):
            found &= (self.table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = hashes >> np.uint64(32)
    for probe in range(PROBES):
        yield (hashes + np.uint64(probe) * step) & np.uint64(bits - 1)


def bit_table(frequent: DataFrame) -> BitTable | None:
    """The table of all rows of `frequent`; None when there are none. At most `MOST_BITS` bits (16 MB) reach the driver."""
    rows = frequent.count()
    if not rows:
        return None
    bits = min(MOST_BITS, max(1 << 10, 1 << (rows * BITS_PER_ENTRY - 1).bit_length()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for lang, phrase in zip(as_bytes(batch.column(0)), as_bytes(batch.column(1))):
                words = [np.array([xxhash.xxh64_intdigest(w)], np.uint64) for w in phrase.split(b" ")]
                places += [int(at[0]) for at in probes(sequence_hashes(lang, words), bits)]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64())], names=["at"])

    at = frequent.select("lang", "phrase").mapInArrow(run, "at bigint")
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
    found = words.toPandas()
    table = np.zeros(bits >> 6, np.uint64)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return BitTable(bits, table)


class Task:
    """What one task does: read slices of texts of one language and find the sequences that tables leave possible."""

    def __init__(self, length: int, tables: dict[int, BitTable], parts: int = 1):
        self.length, self.tables, self.parts = length, tables, parts
        self._start()

    def _start(self) -> None:
        self.words = Words()
        self.trie = HashTrie(self.length)
        self.singles: dict[bytes, np.ndarray] = {}

    def starts(self, lang: bytes, numbers: np.ndarray, length: int) -> np.ndarray:
        """Per word, whether a sequence of `length` words that begins there is possible."""
        good, hashes = numbers >= 0, self.words.hashes()
        for width in range(1, length + 1):
            if width > 1:
                good = np.append(good[:-1] & good[1:], False)
            if width in self.tables:
                at = np.flatnonzero(good)
                good[at] = self.tables[width](sequence_hashes(lang, [hashes[numbers[at + k]] for k in range(width)]))
        return good

    @staticmethod
    def _windows(numbers: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        return numbers[starts[:, None] + np.arange(width)[None, :]]

    def count(self, lang: bytes, text: bytes) -> Iterator[pa.RecordBatch]:
        """Count the sequences of a slice; runs of subtrees that must leave."""
        numbers = self.words.read(text)
        if self.length == 1:
            counts = np.bincount(numbers[numbers >= 0], minlength=len(self.words.names))
            before = self.singles.get(lang, np.zeros(0, np.int64))
            counts[: len(before)] += before
            self.singles[lang] = counts
        else:
            at = np.flatnonzero(self.starts(lang, numbers, self.length))
            self.trie.add(lang, self._windows(numbers, at, self.length))
            for one, leave in self.trie.overflow().items():
                yield from self._run(one, *self.trie.take(one, leave))
        yield from self._forget()

    def cut(self, lang: bytes, text: bytes) -> Iterator[pa.RecordBatch]:
        """The stretches of a slice in which every sequence of `length` words is possible and there is more than one."""
        numbers = self.words.read(text)
        good = self.starts(lang, numbers, self.length)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
        begins, ends = edges[::2], edges[1::2]
        long = ends - begins > 1
        names, parts = self.words.names, []
        for begin, end in zip(begins[long].tolist(), ends[long].tolist()):
            parts.append(b" ".join([names[w] for w in numbers[begin : end + self.length - 1].tolist()]))
        if parts:
            yield pa.RecordBatch.from_arrays([_text([lang]), _text([b".".join(parts)])], names=["lang", "text"])
        yield from self._forget()

    def _forget(self) -> Iterator[pa.RecordBatch]:
        if len(self.words.names) * max(1, len(self.singles)) > KNOWN_WORDS:
            yield from self.rest()
            self._start()

    def rest(self) -> Iterator[pa.RecordBatch]:
        """Runs of all that is left; the empty phrase stands for all words of a language."""
        for lang, counts in self.singles.items():
            words = np.flatnonzero(counts).astype(np.int32)
            yield from self._run(lang, words[:, None], counts[words])
            yield self._block(0, lang, pa.array([b""], pa.binary()), pa.array([int(counts.sum())], pa.int64()))
        for lang, leave in self.trie.everything().items():
            yield from self._run(lang, *self.trie.take(lang, leave))

    def _run(self, lang: bytes, rows: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The phrases in order of their word numbers, cut by the part in which their first two words are merged."""
        if not len(rows):
            return
        hashes = self.words.hashes()
        heads = sequence_hashes(lang, [hashes[rows[:, k]] for k in range(min(2, self.length))])
        part = ((heads >> np.uint64(40)) % np.uint64(self.parts)).astype(np.int32)
        order = np.lexsort((*rows.T[::-1], part))
        phrases, counts = self.words.phrases(rows[order]), pa.array(counts[order])
        for low, high in groups(part[order]):
            yield self._block(int(part[order[low]]), lang, phrases.slice(low, high - low), counts.slice(low, high - low))

    @staticmethod
    def _block(part: int, lang: bytes, phrases: pa.Array, counts: pa.Array) -> pa.RecordBatch:
        """One row: a stretch of a sorted run, compressed."""
        sink = pa.BufferOutputStream()
        rows = pa.RecordBatch.from_arrays([phrases, counts], names=["phrase", "f"])
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(rows)
        columns = [pa.array([part], pa.int32()), _text([lang]), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "lang", "run"])


def _text(values) -> pa.Array:
    return (values if isinstance(values, pa.Array) else pa.array(values, pa.binary())).cast(pa.string())


def merge_runs(min_count: int):
    """Add up the runs of one part: the phrases that reach `min_count`."""

    def merge(blocks: pa.Table) -> pa.Table:
        by_lang: dict[str, list[pa.Table]] = {}
        for lang, run in zip(blocks.column("lang").to_pylist(), blocks.column("run").to_pylist()):
            by_lang.setdefault(lang, []).append(pa.ipc.open_stream(run).read_all())
        out = []
        for lang, runs in by_lang.items():
            merged = pa.concat_tables(runs).group_by("phrase").aggregate([("f", "sum")])
            merged = merged.filter(pc.greater_equal(merged.column("f_sum"), min_count))
            langs = pa.array([lang] * len(merged), pa.string())
            out.append(pa.table([langs, merged.column("phrase").cast(pa.string()), merged.column("f_sum").cast(pa.int64())], schema=COUNT_SCHEMA))
        return pa.concat_tables(out)

    return merge


def by_slices(batches: Iterable[pa.RecordBatch], use) -> Iterator[pa.RecordBatch]:
    """`use(lang, text)` on texts of one language at a time, joined by line ends to about `SLICE_BYTES`."""
    waiting: dict[bytes, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(as_bytes(batch.column(0)), as_bytes(batch.column(1))):
            waiting.setdefault(lang, []).append(text)
            size += len(text)
            if size >= SLICE_BYTES:
                for one, held in waiting.items():
                    yield from use(one, b"\n".join(held))
                waiting, size = {}, 0
    for one, held in waiting.items():
        yield from use(one, b"\n".join(held))


def count_phrases(texts: DataFrame, length: int, tables: dict[int, BitTable], min_count: int) -> DataFrame:
    """(lang, phrase, f): sequences of `length` words that occur `min_count` times or more. With length 1, the empty phrase
    stands for all words of a language."""
    shared = texts.sparkSession.sparkContext.broadcast(tables)  # at most 16 MB a table
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // PART_BYTES))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Task(length, shared.value, parts)
        yield from by_slices(batches, task.count)
        yield from task.rest()

    # Runs meet by their first two words, the longest prefix under which a subtree leaves.
    runs = texts.mapInArrow(run, "part int, lang string, run binary")
    return store(runs.groupBy("part").applyInArrow(merge_runs(min_count), COUNT_TYPE), f"phrases-{length}")


def cut_texts(texts: DataFrame, length: int, tables: dict[int, BitTable]) -> DataFrame:
    """(lang, text): what is left of `texts` for sequences longer than `length` words, stored once."""
    shared = texts.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_slices(batches, Task(length, shared.value).cut)

    return store(texts.mapInArrow(run, "lang string, text string"), f"phrase-texts-{length}")


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, f, words): every sequence of 1 to `longest` words inside a piece that occurs `min_count` times or more,
    and the empty phrase (words 0) with the number of all words of a language that reaches `min_count`."""
    texts = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found, words = None, {}
    for length in range(1, longest + 1):
        level = count_phrases(texts, length, words if length == 2 else {}, min_count)
        rows = level.withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(length))
        found = rows if found is None else found.unionByName(rows)
        table = bit_table(level) if length < longest else None
        if table is None:
            break
        if length == 1:
            words = {1: table}
        else:
            texts = cut_texts(texts, length, (words if length == 2 else {}) | {length: table})
    return found


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    top: int = PER_LANGUAGE,
    covered: int = COVERED,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language by the score of their weakest cut.

    Null texts are empty, a null language is `und`. Empty texts add nothing; very long texts are read whole; repeated rows
    count each time. A table without frequent phrases gives an empty result; other columns are not read. Counts are exact.
    """
    counted = frequent_phrases(docs, lang, text, min_count, longest)
    totals = counted.filter("words = 0").select("lang", F.col("f").alias("n"))
    parts = counted.filter("words > 0").select("lang", "phrase", "f")
    several = counted.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"), "words")

    inner = F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(ws, i, m), ' '))))"
    )
    inside = several.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    widest = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = several.join(widest, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {int(covered)} * a").drop("longer")

    cuts = kept.select("lang", "phrase", "a", "ws", "words", F.expr("explode(sequence(1, words - 1))").alias("k"))
    cuts = cuts.withColumns({"first": F.expr("array_join(slice(ws, 1, k), ' ')"), "rest": F.expr("array_join(slice(ws, k + 1, words - k), ' ')")})
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.drop("ws", "words").join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    whole = "cast({} as decimal(38, 0))"
    score = F.expr(f"{whole.format(1000)} * {whole.format('a')} * {whole.format('n')} div ({whole.format('l')} * {whole.format('r')})")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    scored = weakest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
