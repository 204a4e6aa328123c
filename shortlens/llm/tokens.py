"""Token counts by section: a document is encoded once, whole, and its tokens are dealt out to sections by their places.

Sections follow one another, each up to the start of the next, and cover the text. A token that crosses a border goes to the
section that holds most of its bytes, the earlier one if two hold as many, so that every token is counted exactly once;
`share` splits it by bytes instead.
"""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlens.llm.common import as_bytes, process_memory

KNOWN_PIECES = 200_000
# A section ends behind each of these.
LINE_END = r"\n"
SECTIONS_TYPE = "array<struct<section:int,start:bigint,end:bigint,n_tokens:bigint,n_crossing:bigint,share:double>>"
_ARROW_TYPE = pa.list_(
    pa.struct([("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("share", pa.float64())])
)


class PieceLengths(dict):
    """piece of text (as the tokenizer cuts it before merging) -> the bytes of each of its tokens."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        memory = process_memory(f"pieces of {path}")
        if not memory:
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            encoding = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            memory |= {"encoding": encoding, "bytes": {i: len(t) for t, i in ranks.items()}, "known": {}}
        self.encoding, self.sizes, self.known = memory["encoding"], memory["bytes"], memory["known"]

    def __missing__(self, piece: str) -> tuple:
        value = self.known.get(piece)
        if value is None:
            value = tuple(self.sizes[i] for i in self.encoding.encode_ordinary(piece))
            if len(self.known) < KNOWN_PIECES:
                self.known[piece] = value
            elif len(self) > KNOWN_PIECES:
                self.clear()
        if len(self) <= KNOWN_PIECES:
            self[piece] = value
        return value


def token_ends(text: str, pieces: PieceLengths, split) -> np.ndarray:
    """The byte at which each token of the whole text ends."""
    return np.cumsum(np.fromiter(itertools.chain.from_iterable(map(pieces.__getitem__, split(text))), np.int64))


def attribute(ends: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, crossing tokens, shares) of each section from the ends of tokens and the starts of sections, in bytes."""
    n = len(starts)
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    stops = np.append(starts[1:], size)
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, np.maximum(ends - 1, begins), "right") - 1
    # Empty sections share a start with the next one; a token belongs to the last that starts there.
    owner, share = first.copy(), np.zeros(n)
    crossing = np.flatnonzero(first != last)
    inside = np.ones(len(ends), bool)
    inside[crossing] = False
    share += np.bincount(first[inside], minlength=n)
    for t in crossing.tolist():
        low, high = int(begins[t]), int(ends[t])
        parts = np.arange(first[t], last[t] + 1)
        held = np.minimum(stops[parts], high) - np.maximum(starts[parts], low)
        owner[t] = parts[int(np.argmax(held))]
        share[parts] += held / (high - low)
    tokens = np.bincount(owner, minlength=n)
    return tokens, np.bincount(owner[crossing], minlength=n), share


def ended_by(section_end: str) -> Callable:
    """(UTF-8, starts of sections) of texts whose sections end behind each match."""

    def cut(texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
        find = re.compile(section_end.encode()).finditer
        for raw in as_bytes(texts):
            yield raw, np.array([0, *[m.end() for m in find(raw) if m.end() < len(raw)]], np.int64)

    return cut


def joined_by(mark: str) -> Callable:
    """The same of lists of texts, which `mark` joins; where each begins follows from the lengths of those before."""

    def cut(lists: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
        between = mark.encode()
        for texts in lists.to_pylist():
            raws = [(t or "").encode() for t in texts]
            sizes = np.array([len(r) + len(between) for r in raws], np.int64)
            yield between.join(raws), sizes.cumsum() - sizes

    return cut


def counter(path: str, pattern: str, cut: Callable):
    @F.arrow_udf(returnType=SECTIONS_TYPE)
    def sections(text: pa.Array) -> pa.Array:
        pieces, split = PieceLengths(path, pattern), regex.compile(pattern).findall
        parts = []
        for at in range(0, len(text), 128):
            columns, sizes = [], []
            for raw, starts in cut(text.slice(at, 128)):
                ends = token_ends(raw.decode("utf-8", "replace"), pieces, split)
                tokens, crossing, share = attribute(ends, starts, len(raw))
                data = np.frombuffer(raw, np.uint8)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                borders = points[np.append(starts, len(raw))]
                columns.append(np.stack([np.arange(len(starts)), borders[:-1], borders[1:], tokens, crossing, share], 1))
                sizes.append(len(starts))
            table = np.concatenate(columns)
            kinds = _ARROW_TYPE.value_type
            fields = [pa.array(table[:, k].astype(np.int64)).cast(kinds[k].type) if k < 5 else pa.array(table[:, k]) for k in range(6)]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, fields=[kinds[k] for k in range(6)])))
        return pa.concat_arrays(parts) if parts else pa.array([], _ARROW_TYPE)

    # Declared not repeatable: else the optimizer works it out once more for a filter that it infers or pushes down.
    return sections.asNondeterministic()


def section_tokens(
    docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str | Column = "text", section_end: str = LINE_END
) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing, share): tokens of each section of each row.

    A section ends behind each match of `section_end` (bytes); `start` and `end` count code points. The tokens of a document's
    sections add up to those of its whole text. `n_crossing` is how many of them reach into another section. Null and empty
    texts have one empty section without tokens. Repeated rows are counted each; null ids are kept. An empty table gives an
    empty result; other columns are not read.
    """
    column = F.col(text) if isinstance(text, str) else text
    table = docs.select(F.col(doc_id).alias("doc_id"), column.alias("text"))
    counted = table.select("doc_id", counter(path, pattern, ended_by(section_end))("text").alias("s"))
    return counted.select("doc_id", F.explode("s").alias("s")).select("doc_id", "s.*")


def field_tokens(docs: DataFrame, fields: list[str], path: str, pattern: str, doc_id: str = "doc_id", mark: str = "\x1e") -> DataFrame:
    """(doc_id, field, n_tokens, n_crossing, share): the fields of a row joined by `mark` and encoded as one text.

    Every row gives one row per field, whatever its texts hold; a field has the mark behind it. Null and empty fields are
    empty. Null ids are kept, repeated rows counted each. An empty table gives an empty result.
    """
    texts = F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    counted = docs.select(F.col(doc_id).alias("doc_id"), counter(path, pattern, joined_by(mark))(texts).alias("s"))
    names = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("s.section") + 1)
    return counted.select("doc_id", F.explode("s").alias("s")).select("doc_id", names.alias("field"), "s.n_tokens", "s.n_crossing", "s.share")
