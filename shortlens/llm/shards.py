"""Sharding by fixed virtual slots: a record hashes into one of thousands of slots for good; a small table says which shard
holds each slot. Rebalancing edits the latest version of that table by the bytes the slots now hold, and every edit is a new
version of it; earlier ones stay as they are."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlens.llm.common import store
from shortlens.operators.ranking import with_position
from shortlens.runtime import scratch_path

SLOTS = 4096
MAP_TYPE = "version int, slot int, shard int"


def first_map(slots: int, shards: int) -> list[int]:
    """Shard of each slot before anything is known of their sizes: equal stretches."""
    return [slot * shards // slots for slot in range(slots)]


def rebalance(shard_of: list[int], sizes: list[int], shards: int, tolerance: float = 0.0, most_moved: int | None = None) -> list[int]:
    """Move slots from the fullest shard to the emptiest while that narrows the gap; ties to the smaller number.

    Shards beyond those in the map start empty, so growing by one shard only moves slots into it first. Slots of shards that
    are no more go to the emptiest, largest first. Nothing else moves once the gap is at most `tolerance` of a shard's fair
    share of the bytes, nor after `most_moved` moves.
    """
    shard_of, load = list(shard_of), [0] * shards
    members: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        if shard < shards:
            load[shard] += sizes[slot]
            members[shard].append((sizes[slot], slot))
    homeless = [slot for slot, shard in enumerate(shard_of) if shard >= shards]
    for slot in sorted(homeless, key=lambda s: (-sizes[s], s)):
        # Slots without bytes are dealt out by number.
        shard = shard_of[slot] = min(range(shards), key=lambda s: (load[s], len(members[s]), s))
        load[shard] += sizes[slot]
        members[shard].append((sizes[slot], slot))
    fair, moves = sum(sizes) / shards, 0
    while True:
        full, empty = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        # The best move halves the gap; one of the gap's size or more would not narrow it.
        fitting = [(abs(gap - 2 * size), size, slot) for size, slot in members[full] if 0 < size < gap]
        if not fitting or gap <= tolerance * fair or moves == most_moved:
            return shard_of
        moves += 1
        _, size, slot = min(fitting)
        members[full].remove((size, slot))
        members[empty].append((size, slot))
        load[full] -= size
        load[empty] += size
        shard_of[slot] = empty


def save_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """Add a version to the stored map; earlier versions stay as they are."""
    rows = [(version, slot, shard) for slot, shard in enumerate(shard_of)]
    spark.createDataFrame(rows, MAP_TYPE).coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    rows = spark.read.schema(MAP_TYPE).parquet(f"{path}/version={version}").select("slot", "shard").collect()  # one row per slot
    return [shard for _, shard in sorted(rows)]


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The newest whole version of the map under `path`; one whose writer died before its end has no rows and does not count."""
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(home):
        return None
    return spark.read.schema(MAP_TYPE).parquet(path).agg(F.max("version")).first()[0]


def edit_map(spark: SparkSession, path: str, sizes: list[int], shards: int, tolerance: float = 0.0, most_moved: int | None = None) -> tuple[int, list[int]]:
    """(version, shard of each slot): the latest version under `path`, edited by the bytes that slots hold now.

    Without any, version 0 deals slots out evenly. An edit that moves nothing adds no version. Of two writers that edit the
    same version the later one fails, since the next version is there already, and can run again.
    """
    version = latest_version(spark, path)
    if version is None:
        version = 0
        save_map(spark, path, version, first_map(len(sizes), shards))
    before = load_map(spark, path, version)
    if len(before) != len(sizes):
        raise ValueError(f"the map has {len(before)} slots, not {len(sizes)}; their number is fixed")
    after = rebalance(before, sizes, shards, tolerance, most_moved)
    if after != before:
        version += 1
        save_map(spark, path, version, after)
    return version, after


def measured(docs: DataFrame, doc_id: str, text: str, slots: int) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    table = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("bigint").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32")
    )
    return table.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def shard(
    docs: DataFrame,
    shards: int = 8,
    slots: int = SLOTS,
    doc_id: str = "doc_id",
    text: str = "text",
    map_path: str | None = None,
    tolerance: float = 0.0,
    most_moved: int | None = None,
) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot, map_version): one row per row of `docs`.

    `slot` numbers the rows of a shard from 0 without gaps, virtual slot after virtual slot. The latest map under `map_path`
    is edited by the bytes of its slots and stored as the next version, so rows of slots that need not move stay in their
    shard from run to run, also with more or fewer shards; `tolerance` and `most_moved` bound the moves. Without a path the
    map is a new one in the shared folder, which goes with the application. Equal texts under different ids are records of
    their own and spread over slots: a text that fills a third of the table would else fill a shard. Null texts count as empty, null ids are a value like any other, rows equal in id and text share a virtual slot. An empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = store(measured(docs, doc_id, text, slots).withColumn("_row", F.monotonically_increasing_id()), "sharding-rows")
    held = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # at most `slots` rows
    sizes, counts = [0] * slots, [0] * slots
    for slot, size, n in held:
        sizes[slot], counts[slot] = size, n
    path = map_path or scratch_path(spark, "slot-map")
    version, shard_of = edit_map(spark, path, sizes, shards, tolerance, most_moved)
    before = [0] * slots
    for _, group in itertools.groupby(sorted(range(slots), key=lambda s: (shard_of[s], s)), key=lambda s: shard_of[s]):
        total = 0
        for slot in group:
            before[slot] = total
            total += counts[slot]
    places = spark.createDataFrame(list(zip(range(slots), shard_of, before)), "virtual_slot int, shard int, _before bigint")
    numbered = with_position(rows, "virtual_slot", ["doc_id", "text_crc32", "size", "_row"], "_position")
    # One row per slot, a fixed number: it may travel to every task.
    placed = numbered.join(F.broadcast(places), "virtual_slot")
    slot = (F.col("_before") + F.col("_position") - 1).cast("bigint")
    return placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", slot.alias("slot"), F.lit(version).alias("map_version"))
