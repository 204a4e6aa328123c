"""What several of these operators share: reliable intermediate tables, words of a text, small slices of Arrow batches."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlens.runtime import scratch_path

# Rows of an Arrow batch handled at a time; bounds what a task holds beside the batch itself.
SLICE_ROWS = 256
# Distinct words a task remembers before it starts anew.
REMEMBERED_WORDS = 150_000


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder once and read it back: lineage is cut, a lost executor costs a read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def as_bytes(column) -> list[bytes]:
    """The UTF-8 of every text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if b is None else b for b in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """word (bytes) -> a 64-bit hash that is the same on every machine. `bytes.split()` cuts at space and \\x09-\\x0D only."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finalizer of a well-known 64-bit mixer)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


SHINGLE_FACTORS = odd_numbers(64, 20240229)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash per run of `width` word hashes; fewer words than that are one run."""
    if not len(words):
        return words
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total += words[k : len(words) - width + 1 + k] * SHINGLE_FACTORS[k]
    return mix(total)


def text_key(text: str | Column = "text") -> Column:
    """A strong digest by which equal texts are found; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def free_name(taken: list[str], name: str) -> str:
    """`name`, made longer until no column is called so; Spark does not tell upper from lower case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def process_memory(name: str) -> dict:
    """A dict that lives as long as the Python process, so that tasks one after another share what they worked out."""
    home = sys.modules.setdefault("_shortlens_memory", types.ModuleType("_shortlens_memory"))
    return home.__dict__.setdefault(name, {})
