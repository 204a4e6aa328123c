"""N-gram Jaccard join by chosen paths: sets that share a path of sampled shingles meet in a bucket.

A document is the set of its runs of five words. In a run of the method every set samples about `1 / similarity` of its
shingles by a hash of run and shingle; each sampled shingle opens a bucket, inside which the set samples again with a hash
of the path so far. Similar sets sample the same shingles, so they share paths; a passage common to many documents is only
a part of each and its bucket falls apart at the next level. A bucket with few members is brute-forced as it is, a larger
one is split by the next level, and what is still large at the last level is compared in blocks. Runs repeat until the
recall of the last level is reached.

Equal sets are one node. In a bucket nodes are compared by a small min-hash sketch, with a margin that loses about one
pair in 30,000; nodes linked so far form groups, and inside a group every pair is compared exactly. Neither step emits the
pairs of a group: tasks return forest edges and link counts, at most one row per node and block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shortlens.llm.common import WordHashes, as_bytes, free_name, mix, odd_numbers, shingle_hashes, store, text_key
from shortlens.plans.components import components

WIDTH = 5
SIMILARITY = 0.8
RECALL = 0.99
LEVELS = 3
# A bucket up to this size is compared whole; a larger one is split by the next level.
BUCKET = 64
# Rows that meet in one task where splitting has come to an end.
BUCKET_BLOCK = 1024
GROUP_BLOCK = 512
SKETCH = 128
# Texts whose paths are sampled together: a level looks at every shingle once for each of about 12 paths.
SAMPLED_ROWS = 64
_PATH = "array<struct<a:bigint,b:bigint,c:bigint>>"
SAMPLED_TYPE = f"set_key string, n int, sketch binary, paths {_PATH}"


def runs_needed(similarity: float, recall: float, levels: int = LEVELS) -> int:
    """Runs after which a pair at the limit has met at the last level. Shared children are Poisson with mean 1 or more."""
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def shingles(text: bytes, hashes: WordHashes, width: int) -> np.ndarray:
    words = np.array([hashes[w] for w in text.split()], np.uint64)
    return np.unique(shingle_hashes(words, width))


_EDGES = (np.arange(SKETCH, dtype=np.uint64) << np.uint64(64 - 7)).astype(np.uint64)


def sketch(items: np.ndarray) -> bytes:
    """The least shingle of each of 128 ranges, cut to one byte; 0 where a range is empty."""
    at = np.searchsorted(items, _EDGES)
    filled = at < len(items)
    value = items[np.minimum(at, len(items) - 1)]
    filled &= (value >> np.uint64(57)) == np.arange(SKETCH, dtype=np.uint64)
    return np.where(filled, mix(value) % np.uint64(255) + np.uint64(1), np.uint64(0)).astype(np.uint8).tobytes()


def _pieces(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of many stretches one after another, and the number of the stretch of each."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(starts, sizes) + within, owner


def sample_paths(sets: list[np.ndarray], similarity: float, runs: int) -> list[np.ndarray]:
    """For each set its paths as rows (a, b, c); 0 where a path ended early. A set keeps at least the paths of length 1."""
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    items = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    limit = np.minimum(2.0**64 / (similarity * np.maximum(sizes, 1)), 2.0**64 - 2048).astype(np.uint64)
    seeds = odd_numbers(runs, 32452843)
    owners, paths = [], []
    item_limit = np.repeat(limit, sizes)
    item_owner = np.repeat(np.arange(len(sets)), sizes)
    for seed in seeds:
        hit = np.flatnonzero(items * seed < item_limit)
        owners.append(item_owner[hit])
        paths.append(mix(items[hit] ^ seed))
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    columns = [np.concatenate(paths) if paths else np.zeros(0, np.uint64)]
    for _ in range(1, LEVELS):
        live = np.flatnonzero(columns[-1])
        at, row = _pieces(starts[owner[live]], sizes[owner[live]])
        seed = columns[-1][live] | np.uint64(1)
        hit = np.flatnonzero(items[at] * seed[row] < limit[owner[live]][row])
        parent = live[row[hit]]
        child = mix(columns[-1][parent] + items[at[hit]])
        ended = np.setdiff1d(np.arange(len(owner)), parent)
        order = np.concatenate([parent, ended])
        columns = [c[order] for c in columns] + [np.concatenate([child, np.zeros(len(ended), np.uint64)])]
        owner = owner[order]
    table = np.stack(columns, 1)
    order = np.argsort(owner, kind="stable")
    return np.split(table[order], np.cumsum(np.bincount(owner, minlength=len(sets)))[:-1]) if sets else []


def sampler(width: int, similarity: float, runs: int):
    @F.arrow_udf(returnType=SAMPLED_TYPE)
    def sampled(text: pa.Array) -> pa.Array:
        hashes, parts = WordHashes(), []
        kind = pa.struct(
            [("set_key", pa.string()), ("n", pa.int32()), ("sketch", pa.binary()), ("paths", pa.list_(pa.struct([(c, pa.int64()) for c in "abc"])))]
        )
        for start in range(0, len(text), SAMPLED_ROWS):
            sets = [shingles(t, hashes, width) for t in as_bytes(text.slice(start, SAMPLED_ROWS))]
            paths = sample_paths(sets, similarity, runs)
            flat = np.concatenate(paths).astype(np.int64) if paths else np.zeros((0, 3), np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
            inner = pa.StructArray.from_arrays([pa.array(flat[:, k], mask=flat[:, k] == 0) for k in range(3)], names=list("abc"))
            parts.append(
                pa.StructArray.from_arrays(
                    [
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets], pa.string()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), inner),
                    ],
                    fields=list(kind),
                )
            )
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return sampled


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, size, node): the shallowest bucket of each path that is small, else the deepest."""
    live = nodes.select("node", F.explode("paths").alias("p")).select("node", "p.*")
    parts = []
    for level, name in enumerate("abc"):
        # A node with several paths through a bucket counts once for each: only the split, not the result, depends on it.
        sizes = live.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("size")).filter("size > 1")
        sized = live.join(sizes, name)
        if level == LEVELS - 1:
            parts.append(sized.select(F.col(name).alias("bucket"), "size", "node").distinct())
            break
        parts.append(sized.filter(F.col("size") <= BUCKET).select(F.col(name).alias("bucket"), "size", "node").distinct())
        live = store(sized.filter(F.col("size") > BUCKET).drop("size"), "jaccard-large")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _in_blocks(rows: DataFrame, size: str, block: int, key: str) -> DataFrame:
    """Rows of a group, once for each pair of blocks that its block is part of: `i` <= `j` name the pair, `side` the block."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    placed = rows.withColumn("_n", blocks).withColumn("side", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    pairs = placed.withColumn("_o", other)
    return pairs.withColumn("i", F.least("side", "_o")).withColumn("j", F.greatest("side", "_o")).drop("_n", "_o")


def _whole_groups(handle: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], keys: list[str]):
    """Feed `handle` tables of whole groups, with the first row of each group, from batches sorted by the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            starts = group_starts(held)
            if len(starts) > 1 and held.num_rows >= 256:
                yield from handle(held.slice(0, starts[-1]).combine_chunks(), starts[:-1])
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from handle(held.combine_chunks(), group_starts(held))

    def group_starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for key in keys:
            values = table.column(key).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    return run


def _alike(left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sketches may belong to sets of the similarity: four standard deviations below it still pass."""
    either = ((left > 0) | (right > 0)).sum(-1)
    equal = ((left == right) & (left > 0)).sum(-1)
    return equal >= similarity * either - 4 * np.sqrt(similarity * (1 - similarity) * either)


def _forest(alike: Callable[[int, np.ndarray], np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what is alike: a row is compared with the later rows it is not yet connected to."""
    label, edges = np.arange(len(side)), []
    for p in range(len(side) - 1):
        rest = p + 1 + np.flatnonzero(label[p + 1 :] != label[p])
        if not len(rest):
            continue
        near = rest[alike(p, rest)]
        if len(near):
            met, first = np.unique(label[near], return_index=True)
            edges.extend((p, int(q)) for q in near[first])
            label[np.isin(label, met)] = label[p]
    return edges


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _candidates(similarity: float):
    def handle(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node = table.column("node").to_numpy()
        side = table.column("side").to_numpy()
        marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), SKETCH)
        sizes = np.diff(np.append(starts, len(node)))
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes <= 16, sizes)
        a, b = [], []
        for step in range(1, int(min(sizes.max(initial=0), 16))):
            at = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
            for part in range(0, len(at), 4096):
                left = at[part : part + 4096]
                hit = left[_alike(marks[left], marks[left + step], similarity)]
                a.append(node[hit])
                b.append(node[hit + step])
        for start, size in zip(starts, sizes):
            if size <= 16:
                continue
            own = marks[start : start + size]
            edges = _forest(lambda p, rest: _alike(own[p], own[rest], similarity), side[start : start + size])
            if edges:
                pairs = np.array(edges) + start
                a.append(node[pairs[:, 0]])
                b.append(node[pairs[:, 1]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=_EDGE)

    return _whole_groups(handle, ["bucket", "i", "j"])


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _links(similarity: float):
    """Exact comparison inside a pair of blocks: link counts of its nodes (b null) and edges of a forest (links 0)."""
    share = round(similarity * 10_000)

    def handle(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, side = table.column("node").to_numpy(), table.column("side").to_numpy()
        i, j, weight = (table.column(c).to_numpy() for c in ("i", "j", "copies"))
        raw = table.column("items").to_pylist()
        a, b, links = [], [], []
        for start, end in zip(starts, np.append(starts[1:], len(node))):
            sets = [np.frombuffer(x, np.uint64) for x in raw[start:end]]
            size = np.array([len(s) for s in sets])
            first = np.cumsum(size) - size
            _, ids = np.unique(np.concatenate(sets), return_inverse=True)
            here = side[start:end]
            own_block = i[start] == j[start]
            mark = np.zeros(ids.max(initial=0) + 1, bool)
            count, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
            for p in range(len(sets)):
                if not own_block and here[p] != i[start]:
                    continue
                others = np.arange(p + 1, len(sets)) if own_block else np.flatnonzero(here != here[p])
                least, most = np.minimum(size[others], size[p]), np.maximum(size[others], size[p])
                others = others[least * 10_000 >= share * most]
                if not len(others):
                    continue
                at, owner = _pieces(first[others], size[others])
                mark[ids[first[p] : first[p] + size[p]]] = True
                common = np.bincount(owner[mark[ids[at]]], minlength=len(others))
                mark[ids[first[p] : first[p] + size[p]]] = False
                near = others[common * 10_000 >= share * (size[others] + size[p] - common)]
                if not len(near):
                    continue
                count[p] += weight[start:end][near].sum()
                count[near] += weight[start + p]
                met, at_first = np.unique(label[near], return_index=True)
                for q in near[at_first][met != label[p]]:
                    a.append(node[start + p])
                    b.append(node[start + q])
                    links.append(0)
                label[np.isin(label, met)] = label[p]
            for p in np.flatnonzero(count):
                a.append(node[start + p])
                b.append(None)
                links.append(int(count[p]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], schema=_LINK)

    return _whole_groups(handle, ["component", "i", "j"])


@F.arrow_udf(returnType=T.BinaryType())
def _items(text: pa.Array, width: pa.Array) -> pa.Array:
    hashes = WordHashes()
    wide = width[0].as_py() if len(width) else WIDTH
    return pa.array([shingles(t, hashes, wide).tobytes() for t in as_bytes(text)], pa.binary())


def jaccard_join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """(doc_id, text_key, class_id, class_key, n_links, n_copies): one row per row of `docs`.

    Documents are linked when the Jaccard similarity of their word n-grams reaches `similarity`; a class is what links
    connect. `class_id` is the smallest doc_id of the class, `n_links` counts linked documents, equal ones included,
    `n_copies` the documents with the same set, the row itself included. A text with fewer words than `width` is one
    n-gram. Null, empty and blank texts have no n-grams: they are linked to nothing and their class is their own id.
    Repeated rows are copies of each other. Null ids are kept; a class of null ids alone has a null `class_id`. An empty
    table gives an empty result; other columns are not read.
    """
    table = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sampled = sampler(width, similarity, runs_needed(similarity, recall))
    members = store(table.withColumn("text_key", text_key()).withColumn("s", sampled("text")).select("doc_id", "text_key", "s.*"), "jaccard-members")
    nodes = members.filter("set_key is not null").groupBy("set_key").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"), F.any_value(F.struct("n", "sketch", "paths")).alias("s")
    )
    nodes = store(nodes.select(F.monotonically_increasing_id().alias("node"), "set_key", "copies", "doc_id", "text_key", "s.*"), "jaccard-nodes")

    bucketed = _in_blocks(_buckets(nodes), "size", BUCKET_BLOCK, "bucket").join(nodes.select("node", "sketch"), "node")
    near = bucketed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "node")
    edges = near.select("bucket", "i", "j", "side", "node", "sketch").mapInArrow(_candidates(similarity), "a bigint, b bigint")
    groups = store(components(edges).select(F.col("id").alias("node"), "component"), "jaccard-groups")

    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    wanted = groups.join(sizes, "component").join(nodes.select("node", "text_key", "copies"), "node")
    texts = table.select(text_key().alias("text_key"), "text").join(wanted, "text_key").dropDuplicates(["node"])
    sets = texts.select("component", "size", "node", "copies", _items("text", F.lit(width)).alias("items"))
    placed = _in_blocks(sets, "size", GROUP_BLOCK, "component").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "side", "node")
    links = placed.select("component", "i", "j", "side", "node", "copies", "items").mapInArrow(_links(similarity), "a bigint, b bigint, links bigint")
    links = store(links, "jaccard-links")

    counts = links.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(links.filter("b is not null")).select(F.col("id").alias("node"), "component")
    named = nodes.select("node", "set_key", "copies", "doc_id").join(classes, "node", "left").join(counts, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    heads = named.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.min("set_key").alias("class_key"))
    # A hot class is many nodes on one side, one row on the other: adaptive execution splits it.
    classed = named.join(heads, "component").select(
        F.col("set_key").alias("_set"), "class_id", "class_key", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = members.select("doc_id", "text_key", "set_key").join(classed, F.col("set_key") == F.col("_set"), "left")
    lonely = F.col("set_key").isNull()
    return out.select(
        "doc_id",
        "text_key",
        F.when(lonely, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "class_key",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` per class, the one with the smallest id (then text digest); rows without words all stay."""
    key, head, head_key = (free_name(docs.columns, name) for name in ("_text_key", "_head", "_head_key"))
    joined = jaccard_join(docs, doc_id, text)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    heads = joined.filter("class_key is not null").groupBy("class_key").agg(first).select(F.col("first.doc_id").alias(head), F.col("first.text_key").alias(head_key))
    keyed = docs.withColumn(key, text_key(F.col(text)))
    blank = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "") == ""
    chosen = keyed.filter(~blank).join(heads, F.col(doc_id).eqNullSafe(F.col(head)) & (F.col(key) == F.col(head_key)), "left_semi")
    # Rows equal in id and text are copies of each other too.
    return chosen.dropDuplicates([doc_id, key]).unionByName(keyed.filter(blank)).drop(key)
