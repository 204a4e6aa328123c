"""Exact nearest-neighbour work over vectors without a cross join.

Points are placed in the cell of their nearest pivot, and visit another cell only when the plane between the two pivots is
within reach, so far-apart points never meet. Neighbouring cells form groups, and a point travels once to every group it
visits. A task holds some blocks of members and visitors of a group, and each block pair in it is one small matrix product;
a cell with a third of all points is just more tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shortlens.functions.vectors import doubles, l2_normalize, norm
from shortlens.operators.aggregates import group_means
from shortlens.runtime import as_list, settle, small_table

# Rows of one side of a block pair: bounds the matrix that is worked on at a time (32 MB) and what it can emit at once.
BLOCK = 2048
# Blocks of one side that a task holds, and cells of a group: each row is copied to so many times fewer tasks. As many as
# numbers of one side may be held (64 MB), within these bounds; a mask has a bit for each cell of a group.
BLOCKS_A_TASK = 16
MOST_BLOCKS = 62
HELD = 1 << 23
# From this many cells on there are so many groups, and visitors come in shares as large as a group: copies of a row do not
# grow with the table until groups are full.
LEAST_GROUPS = 4
# Up to so many cells it does not pay to see first what hangs together inside them.
FEW_CELLS = 8
# One point in so many looks around before the others, so that cells join.
FIRST_OF = 32
# Shares of all rows in the approximate join, at least.
LEAST_SHARES = 8
# Rows that block pairs of a task may give before they are merged.
MERGED = 1 << 20
# Numbers held at a time while points are placed.
PLACED = 1 << 22
# Numbers of near-equal rows held at a time while they are measured again (8 MB a side).
REMEASURED = 1 << 20
# Share of a block pair above which measuring some of its pairs is no cheaper than all.
FEW = 0.06
# Pivots travel with each task, so their number is bounded.
MAX_PIVOTS = 4096
# Hash tables of the approximate join: how many, how many signs each, and how many rows may be compared for the price of
# sending one row to another table.
MAX_TABLES = 512
MAX_BITS = 24
ROWS_FOR_A_COPY = 64
# Points whose exact partners are looked up to measure recall, and pairs of theirs that are looked at.
SAMPLE_POINTS = 256
SAMPLE_PAIRS = 5_000


def distinct_vectors(df: DataFrame, id: str, vec: str, within=None) -> DataFrame:
    """(within…, id, vec, copies): one row per distinct vector, named by its smallest id. Copies combine before the shuffle."""
    within = as_list(within) if within else []
    points = df.filter(F.col(vec).isNotNull()).select(*within, F.col(id).alias("id"), doubles(F.col(vec)).alias("vec"))
    return points.groupBy(*within, "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def distinct_rows(df: DataFrame, id: str, vec: str, within=None) -> DataFrame:
    """(within…, id, vec, copies): one row per id and vector, so rows with equal vectors stay apart; without an id, none."""
    within = as_list(within) if within else []
    points = df.select(*within, F.col(id).alias("id"), doubles(F.col(vec)).alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL")
    return points.groupBy(*within, "id", "vec").agg(F.count("*").alias("copies"))


def copies_of(df: DataFrame, id: str, vec: str, reps: DataFrame, within=None) -> DataFrame:
    """(id, rep): which distinct vector each row stands for."""
    within = as_list(within) if within else []
    points = df.select(*within, F.col(id), doubles(F.col(vec)).alias("vec"))
    return points.join(reps.select(*within, "vec", F.col("id").alias("rep")), [*within, "vec"]).select(id, "rep")


def unit(points: DataFrame) -> DataFrame:
    """Vectors of length 1, so that order by distance is order by cosine; those without length take no part."""
    return points.filter(norm(F.col("vec")) > 0).withColumn("vec", l2_normalize(F.col("vec")))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of every row of a to every row of b; near-equal rows are measured again by difference."""
    length = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    square = length - 2 * (a @ b.T)
    out = np.sqrt(np.maximum(square, 0))
    i, j = np.nonzero(square <= 1e-9 * length)
    step = max(1, REMEASURED // max(1, a.shape[1]))
    for k in range(0, len(i), step):
        m, n = i[k : k + step], j[k : k + step]
        out[m, n] = np.sqrt(((a[m] - b[n]) ** 2).sum(1))
    return out


def measured(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, by_cosine: bool = False) -> np.ndarray:
    """Distance (or product) of the rows x[i] and y[j], the same for a pair wherever it meets."""
    out, step = np.empty(len(i)), max(1, REMEASURED // max(1, x.shape[1]))
    for k in range(0, len(i), step):
        a, b = x[i[k : k + step]], y[j[k : k + step]]
        out[k : k + step] = (a * b).sum(1) if by_cosine else np.sqrt(((a - b) ** 2).sum(1))
    return out


def likely(x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(i, j): all rows of x and y with a distance of at most `reach` (a number for each row of x) and few others, to be measured.

    One product of half the precision decides, with its largest error as a margin. Nothing where it would keep many, or where
    numbers do not fit it: there all distances are cheaper.
    """
    far, wide = (x * x).sum(1), (y * y).sum(1)
    top = max(far.max(initial=0), wide.max(initial=0))
    if not 1e-200 < top < 1e200:
        return None
    # x·y - |y|²/2 + (reach² - |x|²)/2 >= 0, with rows no longer than 1. Nothing is farther than 2.
    limit = np.minimum(np.nan_to_num(reach, nan=np.inf) / np.sqrt(top), 2.1)
    a = np.column_stack([x / np.sqrt(top), np.ones(len(x)), (limit * limit - far / top) / 2]).astype(np.float32)
    b = np.column_stack([y / np.sqrt(top), wide / top / -2, np.ones(len(y))]).astype(np.float32)
    at = np.flatnonzero(a @ b.T >= -5 * (a.shape[1] + 8) * 2.0**-24)
    if len(at) > FEW * len(x) * len(y):
        return None
    return np.divmod(at, len(y))


def blocks_a_share(blocks: int, dims: int) -> int:
    """How many of `blocks` blocks a task holds of one side: a LEAST_GROUPS-th of them, as long as that many may be held."""
    most = min(MOST_BLOCKS, max(BLOCKS_A_TASK, HELD // (BLOCK * max(1, dims))))
    shares = max(min(LEAST_GROUPS, blocks), -(-blocks // most), 1)
    return max(1, -(-blocks // shares))


def cells_a_group(pivots: np.ndarray) -> int:
    """How many of the cells of `pivots`, which follow each other, form a group."""
    return blocks_a_share(len(pivots), pivots.shape[1]) if len(pivots) else 1


def _runs(m: pd.DataFrame, v: pd.DataFrame, block: int) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """What has to meet in a group of cells: members of cells that follow each other, about a block, and who visits one of them."""
    if "_mask" not in v:
        yield m, v
        return
    m = m.sort_values("_cell", kind="stable", ignore_index=True)
    cells, starts = np.unique(m["_cell"].to_numpy(), return_index=True)
    masks, ends = v["_mask"].to_numpy(), [*starts[1:], len(m)]
    per = int(m["_per"].iloc[0])
    i = 0
    while i < len(cells):
        j = i + 1
        while j < len(cells) and ends[j] - starts[i] <= block:
            j += 1
        asked = sum(1 << int(c % per) for c in cells[i:j])
        yield m.iloc[starts[i] : ends[j - 1]], v[masks & asked != 0]
        i = j


def _blocks(rows: pd.DataFrame, block: int) -> list[pd.DataFrame]:
    """Rows in blocks; equal ids stay together."""
    n = -(-len(rows) // block)
    if n <= 1:
        return [rows] if len(rows) else []
    at = pd.factorize(rows["id"])[0] % n
    return [rows[at == k] for k in range(n)]


def meet(members: DataFrame, visitors: DataFrame, on: list[str], kernel: Callable, schema: str, block: int = BLOCK, merge: Callable | None = None, blocks: int = BLOCKS_A_TASK, gather: Callable | None = None) -> DataFrame:
    """Run `kernel(members, visitors)` on every pair of bounded blocks of rows that share `on`.

    Both sides need a column `id`, which spreads rows over tasks and blocks; equal ids stay together. A task holds up to
    `blocks` blocks of a side, or as many as `_wide` says. The kernel gives a table or, where that may be large, several. Visitors with a `_mask` (`asking`) share a group of cells with the members and meet those
    in the cells of the mask, maybe others of the group. `merge` makes less of the rows that several block pairs gave, where
    their number matters; what the kernel gives without it leaves the task block pair by block pair. Instead of a kernel,
    `gather(members, visitors)` may make an object for a task, which is shown its block pairs (`add`) and asked for `parts`.
    """
    in_groups = "_group" in on and "_wide" in members.columns
    wide = F.max("_wide") if in_groups else F.lit(blocks)
    sizes = members.groupBy(*on).agg(F.count("*").alias("_mn"), wide.alias("_blocks"))
    members, visitors = members.drop("_wide"), visitors.drop("_wide")
    sizes = sizes.join(visitors.groupBy(*on).agg(F.count("*").alias("_vn")), on)

    def tasks(own: str, other: str) -> Column:
        # Small shares cost little while the other side, which is copied for each of them, is one block. A share of a group
        # may be half as large again, so that a group somewhat above the mean is not dealt twice.
        share = F.col(own) / (block * F.col("_blocks"))
        dealt = F.greatest(F.ceil(share - 0.5), F.lit(1)) if in_groups else F.ceil(share)
        return F.when(F.col(other) <= block, F.ceil(F.col(own) / block)).otherwise(dealt)

    sizes = sizes.select(*on, tasks("_mn", "_vn").alias("_ms"), tasks("_vn", "_mn").alias("_vs"))
    if on in (["_cell"], ["_group"], ["_all"]):
        # At most MAX_PIVOTS cells exist, so this table is small whatever the data.
        sizes = F.broadcast(sizes)
    zero, own = F.lit(0), F.xxhash64("id")
    left = members.join(sizes, on).withColumn("_m", F.pmod(own, F.col("_ms")))
    left = left.withColumn("_v", F.explode(F.sequence(zero, F.col("_vs") - 1))).drop("_ms", "_vs")
    right = visitors.join(sizes, on).withColumn("_v", F.pmod(own, F.col("_vs")))
    right = right.withColumn("_m", F.explode(F.sequence(zero, F.col("_ms") - 1))).drop("_ms", "_vs")
    key = [*on, "_m", "_v"]
    # Both sides travel as one table, so that a task can give its rows bit by bit.
    m_row, v_row = F.struct(*members.columns), F.struct(*visitors.columns)
    none = {c: F.lit(None).cast(df.schema) for c, df in (("_member", members), ("_visitor", visitors))}
    left = left.select(*key, m_row.alias("_member"), none["_visitor"].alias("_visitor"))
    right = right.select(*key, none["_member"].alias("_member"), v_row.alias("_visitor"))
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def side(batches: list[pa.RecordBatch], name: str) -> pd.DataFrame:
        parts = [batch.column(name) for batch in batches]
        return pa.Table.from_batches([pa.RecordBatch.from_struct_array(p.filter(p.is_valid())) for p in parts]).to_pandas()

    def rows(found: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(found[fields.names], schema=fields, preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        m, v = side(batches, "_member"), side(batches, "_visitor")
        del batches
        held, n, limit = [], 0, MERGED
        all_pairs = gather(m, v) if gather and len(m) and len(v) else None
        for some, asked in _runs(m, v, block) if len(m) and len(v) else ():
            own = _blocks(some, block)
            for b in _blocks(asked, block):
                for a in own:
                    if all_pairs:
                        all_pairs.add(a, b)
                        continue
                    found = kernel(a, b)
                    for part in [found] if isinstance(found, pd.DataFrame) else found:
                        if merge is None and len(part):
                            yield rows(part)
                        elif len(part):
                            held.append(part)
                            n += len(part)
                    if n > limit:
                        held = [merge(pd.concat(held, ignore_index=True))]
                        n = len(held[0])
                        limit = MERGED + 2 * n
        if held:
            yield rows(merge(pd.concat(held, ignore_index=True)) if len(held) > 1 else held[0])
        for part in all_pairs.parts() if all_pairs else ():
            yield rows(part)

    return left.unionByName(right).groupBy(*key).applyInArrow(run, schema)


def choose_pivots(points: DataFrame, n: int, apart: float = 0.0) -> tuple[list, np.ndarray]:
    """(ids, vectors) of a repeatable spread of points: the first by hash, leaving out those within `apart` of another.

    A dense clump then has one cell and not many that all reach each other.
    """
    wanted = min(n if apart == 0 else 4 * n, MAX_PIVOTS)
    rows = points.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    vectors = np.array([r["vec"] for r in rows], dtype=np.float64)
    nearest_kept = np.full(len(rows), np.inf)
    kept = []
    for i in range(len(rows)):
        if len(kept) < n and nearest_kept[i] > apart:
            kept.append(i)
            nearest_kept = np.minimum(nearest_kept, np.sqrt(((vectors - vectors[i]) ** 2).sum(1)))
    order = [kept[i] for i in _side_by_side(vectors[kept])]
    return [rows[i]["id"] for i in order], vectors[order]


def _side_by_side(x: np.ndarray) -> list[int]:
    """An order in which near rows follow each other: halves along the dimension of the widest spread, and so on."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        part = todo.pop()
        if len(part) <= 1:
            done += part.tolist()
            continue
        part = part[np.argsort(x[part, np.ptp(x[part], axis=0).argmax()], kind="stable")]
        todo += [part[len(part) // 2 :], part[: len(part) // 2]]
    return done


def place(vec: Column, reach: Column, pivots: np.ndarray, half: bool) -> Column:
    """struct(home, off, visits): the nearest pivot's cell, the distance to it, and every cell that may hold a point within reach.

    `visits` has a mask for each group of cells, the lowest bit for its first cell. A point at signed distance h beyond the
    plane between two pivots is at least h away from all points of the other cell. With `half`, only cells numbered up to the
    home are visited, so each pair meets from one side.
    """
    squares = (pivots * pivots).sum(1)
    gaps = distances(pivots, pivots)
    per = cells_a_group(pivots)
    groups = -(-len(pivots) // per)
    bits = np.int64(1) << np.arange(per, dtype=np.int64)

    def some(x: np.ndarray, reaches: np.ndarray) -> pd.DataFrame:
        square = (x * x).sum(1)[:, None] + squares[None, :] - 2 * (x @ pivots.T)
        home = square.argmin(1)
        beyond = square - square[np.arange(len(x)), home][:, None]
        with np.errstate(invalid="ignore"):
            near = beyond <= 2 * (reaches[:, None] + 1e-9) * gaps[home] + 1e-9
        if half:
            near &= np.arange(len(pivots))[None, :] <= home[:, None]
        near[np.arange(len(x)), home] = True
        off = np.sqrt(((x - pivots[home]) ** 2).sum(1))
        near = np.pad(near, ((0, 0), (0, groups * per - len(pivots)))).reshape(len(x), groups, per)
        return pd.DataFrame({"home": home.astype("int32"), "off": off, "visits": list(near @ bits)})

    @F.pandas_udf("struct<home:int,off:double,visits:array<bigint>>")
    def run(vecs: pd.Series, reaches: pd.Series) -> pd.DataFrame:
        step = max(1, PLACED // len(pivots))
        parts = [some(matrix(vecs[k : k + step]), reaches[k : k + step].to_numpy(np.float64)) for k in range(0, len(vecs), step)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["home", "off", "visits"])

    return run(vec, reach)


def grouped(rows: DataFrame, home: str, pivots: np.ndarray, n: int, block: int) -> DataFrame:
    """Members of cells: the `n` `rows` with the `_cell` they are in, as `home` says, and its `_group`.

    `_per` is how many cells a group has, `_wide` how many blocks a task holds; few cells may have many points.
    """
    per = cells_a_group(pivots)
    wide = max(per, blocks_a_share(-(-n // block), pivots.shape[-1]))
    group = F.floor(F.col(home) / per).cast("int")
    return rows.withColumns({"_cell": F.col(home), "_group": group, "_per": F.lit(per), "_wide": F.lit(wide)})


def asking(rows: DataFrame, visits: str | Column) -> DataFrame:
    """Visitors of cells: `rows` once for each group of cells in which they visit one, with the `_mask` of cells."""
    rows = rows.withColumn("_visits", F.col(visits) if isinstance(visits, str) else visits).drop("_group", "_cell")
    return rows.select("*", F.posexplode("_visits").alias("_group", "_mask")).filter("_mask <> 0").drop("_visits")


def cover(points: DataFrame, reach: float, half: bool, block: int = BLOCK) -> tuple[DataFrame, list]:
    """(placed, pivot ids): points with `_home`, `_off` (distance to the pivot) and `_visits`; few points share one cell.

    `points` should be settled, as it is read for the count, the pivots and the placing.
    """
    return _cover(points, reach, half, block)[:2]


def _cover(points: DataFrame, reach: float, half: bool, block: int) -> tuple[DataFrame, list, np.ndarray]:
    """The same with the pivots."""
    n = points.count()
    if n <= 2 * block:
        alone = {"_home": F.lit(0), "_off": F.lit(float("inf")), "_visits": F.array(F.lit(1).cast("bigint"))}
        none = np.empty((0, 0))
        return grouped(points.withColumns(alone), "_home", none, n, block), [], none
    ids, pivots = choose_pivots(points, -(-n // block), reach / 2)
    placed = points.withColumn("_at", place(F.col("vec"), F.lit(float(reach)), pivots, half))
    fields = {f"_{f}": F.col(f"_at.{f}") for f in ("home", "off", "visits")}
    return settle(grouped(placed.withColumns(fields).drop("_at"), "_home", pivots, n, block)), ids, pivots


def members_of(placed: DataFrame) -> DataFrame:
    return placed.drop("_off", "_visits")


def visitors_of(placed: DataFrame) -> DataFrame:
    return asking(placed, "_visits").drop("_off")


def _codes(m: pd.DataFrame, v: pd.DataFrame, ordered: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in place of the ids of both sides, equal where ids are, in their order if asked; texts compare slowly."""
    a, b = m["id"].to_numpy(), v["id"].to_numpy()
    if a.dtype != object and b.dtype != object:
        return a, b
    codes, _ = pd.factorize(np.concatenate([a, b]), sort=ordered)
    return codes[: len(a)], codes[len(a) :]


def _once(m: pd.DataFrame, v: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which (visitor i, member j) count when each pair shall count once: at home only the smaller id is a member."""
    a, b = _codes(m, v, True)
    cell, home, a, b = m["_cell"].to_numpy()[j], v["_home"].to_numpy()[i], a[j], b[i]
    return ((cell < home) & (a != b)) | ((cell == home) & (a < b))


def _other(m: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
    a, b = _codes(m, v)
    return a[None, :] != b[:, None]


def _type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _reach_of(min_sim: float) -> float:
    return float(np.sqrt(max(2 - 2 * min_sim, 0.0)))


def close_pairs(points: DataFrame, limit: float, metric: str, within=None, block: int = BLOCK) -> DataFrame:
    """(within…, id1, id2, value): pairs of `points` at cosine of at least, or distance of at most, the limit.

    Where points have `copies`, a pair comes once for each copy of one with each copy of the other.
    """
    within = as_list(within) if within else []
    by_cosine, many = metric == "cosine", "copies" in points.columns
    points = unit(points) if by_cosine else points
    points = settle(points)
    kind = _type_of(points, "id")
    reach = _reach_of(limit) if by_cosine else float(limit)
    placed, _ = cover(points, reach, True, block)
    # Units are of length 1 but for the last digits.
    reaches = np.full(block, reach * (1 + 1e-9) + 1e-9)

    def some(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        a, b = matrix(v["vec"]), matrix(m["vec"])
        found = likely(a, b, reaches[: len(a)])
        if found is None:
            value = a @ b.T if by_cosine else distances(a, b)
            found = np.nonzero((value >= limit) if by_cosine else (value <= limit))
            value = value[found]
        else:
            value = measured(a, b, *found, by_cosine)
        kept = _once(m, v, *found) & ((value >= limit) if by_cosine else (value <= limit))
        i, j, value = found[0][kept], found[1][kept], value[kept]
        x, y = v["id"].to_numpy()[i], m["id"].to_numpy()[j]
        first = x < y
        out = pd.DataFrame({"id1": np.where(first, x, y), "id2": np.where(first, y, x), "value": value})
        if many:
            out["times"] = v["copies"].to_numpy()[i] * m["copies"].to_numpy()[j]
        for w in within:
            out[w] = m[w].iloc[0] if len(m) else None
        return out

    def kernel(m: pd.DataFrame, v: pd.DataFrame) -> Iterator[pd.DataFrame]:
        # Equal vectors may all be pairs, so only some rows of a block meet at a time.
        step = min(block, max(1, MERGED // max(1, len(m))))
        for k in range(0, len(v), step):
            yield some(m, v.iloc[k : k + step])

    extra = "".join(f", {w} {_type_of(points, w)}" for w in within)
    schema = f"id1 {kind}, id2 {kind}, value double{', times bigint' if many else ''}{extra}"
    found = meet(members_of(placed), visitors_of(placed), [*within, "_group"], kernel, schema, block)
    if not many:
        return found
    return found.withColumn("times", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).drop("times")


def similar_pairs(df: DataFrame, id: str, vec: str, min_sim: float, within=None, block: int = BLOCK, copies: bool = False) -> DataFrame:
    """(within…, id1, id2, similarity): pairs with cosine of at least `min_sim`, each once, exact.

    With `copies`, pairs of all rows: those of equal vectors, and those that each copy of a vector has with others; a row that
    comes twice gives its pairs twice. Without, equal vectors are one point, named by the smallest id (`copies_of` leads back).
    """
    points = distinct_rows(df, id, vec, within) if copies else distinct_vectors(df, id, vec, within).drop("copies")
    return close_pairs(points, min_sim, "cosine", within, block).withColumnRenamed("value", "similarity")


@dataclass
class Tables:
    """Hash tables over directions: in each, a vector's bucket is the signs of its products with `bits` random ones.

    `recall` is the share of `sampled` exact pairs that meet in one of the tables; null where the sample held none.
    """

    bits: int
    tables: int
    dims: int
    seed: int
    recall: float | None = None
    sampled: int = 0

    def planes(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.tables * self.bits, self.dims))

    def codes(self, x: np.ndarray, planes: np.ndarray) -> np.ndarray:
        """One bucket number per row and table."""
        signs = (x @ planes.T > 0).reshape(len(x), self.tables, self.bits)
        return signs @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))


def sampled_pairs(points: DataFrame, min_sim: float, sample: int = SAMPLE_POINTS) -> DataFrame:
    """(id1, id2, vec1, vec2): every pair of `min_sim` or more that has one of `sample` chosen points in it, exact.

    The chosen ones travel with the tasks; all points are compared with them.
    """
    rows = points.orderBy(F.xxhash64("id", F.lit("sample")), "id").select("id", "vec").limit(sample).collect()
    ids, chosen = [r["id"] for r in rows], np.array([r["vec"] for r in rows], np.float64)
    kind = _type_of(points, "id")

    def run(batches):
        for batch in batches:
            x = matrix(batch["vec"])
            i, j = np.nonzero(x @ chosen.T >= min_sim)
            own = batch["id"].to_numpy()
            out = pd.DataFrame({"id1": [ids[k] for k in j], "id2": own[i], "vec1": [chosen[k].tolist() for k in j], "vec2": [x[k].tolist() for k in i]})
            yield out[out["id1"] != out["id2"]]

    return points.select("id", "vec").mapInPandas(run, f"id1 {kind}, id2 {kind}, vec1 array<double>, vec2 array<double>")


def choose_tables(points: DataFrame, min_sim: float, recall: float = 0.95, seed: int = 11, sample: int = SAMPLE_POINTS) -> Tables:
    """Tables that meet `recall` of all pairs of `min_sim` or more: enough for a pair right at the limit, then as many more as
    the exact pairs of a sample ask for. `points` are settled unit vectors.
    """
    n = points.count()
    first = points.select(F.size("vec")).first()
    dims = first[0] if first else 1
    agree = 1 - np.arccos(np.clip(min_sim, -1, 1)) / np.pi
    best = None
    for bits in range(1, MAX_BITS + 1):
        share = agree**bits
        tables = 1 if share >= recall else int(np.ceil(np.log(1 - recall) / np.log1p(-share)))
        if tables <= MAX_TABLES:
            # A row is sent once per table and meets those that share its bucket.
            cost = tables * (1 + n / 2.0**bits / ROWS_FOR_A_COPY)
            if best is None or cost < best[0]:
                best = cost, bits, tables
    if best is None:
        raise ValueError(f"a cosine of {min_sim} takes more than {MAX_TABLES} tables; the exact join is cheaper there")
    _, bits, tables = best
    pairs = sampled_pairs(points, min_sim, sample).orderBy(F.xxhash64("id1", "id2")).limit(SAMPLE_PAIRS).collect()
    while True:
        made = Tables(bits, tables, dims, seed)
        if not pairs:
            return made
        planes = made.planes()
        one, two = (made.codes(np.array([r[c] for r in pairs], np.float64), planes) for c in ("vec1", "vec2"))
        made.recall, made.sampled = float((one == two).any(1).mean()), len(pairs)
        if made.recall >= recall or tables == MAX_TABLES:
            return made
        tables = min(MAX_TABLES, tables + max(1, tables // 4))


def _in_tables(min_sim: float, found: Tables, within: list[str], block: int) -> Callable:
    """The pairs of two shares of all rows, table after table and bucket after bucket."""

    def hits(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, value) of rows with equal codes a and b, a bounded number at a time."""
        rows, columns = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, x, y = a[rows], b[columns], x[rows], y[columns]
        held, n = [], 0
        for code in np.intersect1d(a, b):
            (i0, i1), (j0, j1) = (np.searchsorted(side, [code, code + 1]) for side in (a, b))
            for i in range(i0, i1, block):
                for j in range(j0, j1, block):
                    value = x[i : min(i + block, i1)] @ y[j : min(j + block, j1)].T
                    at, to = np.nonzero(value >= min_sim)
                    if len(at):
                        held.append((rows[i + at], columns[j + to], value[at, to]))
                        n += len(at)
                    if n > MERGED:
                        yield tuple(np.concatenate(part) for part in zip(*held))
                        held, n = [], 0
        if held:
            yield tuple(np.concatenate(part) for part in zip(*held))

    def kernel(m: pd.DataFrame, v: pd.DataFrame) -> Iterator[pd.DataFrame]:
        planes = found.planes()
        x, y = matrix(v["vec"]), matrix(m["vec"])
        a, b = (np.concatenate([found.codes(side[k : k + BLOCK], planes).astype(np.int32) for k in range(0, len(side), BLOCK)]) for side in (x, y))
        v_id, m_id = _codes(m, v, True)[::-1]
        cell, home = m["_cell"].to_numpy(), v["_home"].to_numpy()
        ids = v["id"].to_numpy(), m["id"].to_numpy()
        for table in range(found.tables):
            for i, j, value in hits(a[:, table], b[:, table], x, y):
                new = (cell[j] < home[i]) | ((cell[j] == home[i]) & (m_id[j] < v_id[i]))
                i, j, value = i[new], j[new], value[new]
                if table and len(i):
                    new = np.concatenate([~(a[i[k : k + BLOCK], :table] == b[j[k : k + BLOCK], :table]).any(1) for k in range(0, len(i), BLOCK)])
                    i, j, value = i[new], j[new], value[new]
                first = v_id[i] < m_id[j]
                one, two = ids[0][i], ids[1][j]
                out = pd.DataFrame({"id1": np.where(first, one, two), "id2": np.where(first, two, one), "value": value})
                for w in within:
                    out[w] = m[w].iloc[0]
                yield out

    return kernel


def approx_pairs(points: DataFrame, min_sim: float, found: Tables, within=None, block: int = BLOCK) -> DataFrame:
    """(within…, id1, id2, value): the pairs of `close_pairs` that meet in a table, each once, with their exact cosine.

    A pair is given by the first table in which it meets, so tables need not be made distinct. A row goes to one task for each
    table; where that is more often than once to every share of all rows, it goes there and the task fills all tables.
    """
    within = as_list(within) if within else []
    kind = _type_of(points, "id")
    extra = "".join(f", {w} {_type_of(points, w)}" for w in within)
    schema = f"id1 {kind}, id2 {kind}, value double{extra}"
    n, wide = points.count(), block * BLOCKS_A_TASK
    shares = max(min(LEAST_SHARES, -(-n // block)), -(-n // wide))
    if found.tables > shares:
        placed = points.select(*within, "id", "vec", F.pmod(F.xxhash64("id", F.lit("share")), F.lit(shares)).cast("int").alias("_home"))
        members = placed.withColumns({"_cell": F.col("_home"), "_group": F.col("_home")})
        visitors = placed.withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_home"))))
        return meet(members, visitors, [*within, "_group"], _in_tables(min_sim, found, within, block), schema, wide, blocks=1)

    @F.pandas_udf("array<bigint>")
    def buckets(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes = found.planes()
        for part in parts:
            x, out = matrix(part), []
            for k in range(0, len(x), BLOCK):
                out += list(found.codes(x[k : k + BLOCK], planes))
            yield pd.Series(out, dtype=object)

    coded = settle(points.select(*within, "id", "vec").withColumn("codes", buckets("vec")))
    placed = coded.select("*", F.posexplode("codes").alias("table", "bucket"))

    def kernel(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        value = matrix(v["vec"]) @ matrix(m["vec"]).T
        i, j = np.nonzero((value >= min_sim) & (v["id"].to_numpy()[:, None] < m["id"].to_numpy()[None, :]))
        table = int(m["table"].iloc[0]) if len(m) else 0
        if len(i) and table:
            a, b = (np.array([codes[:table] for codes in side["codes"]], np.int64) for side in (v, m))
            new = np.concatenate([~(a[i[k : k + BLOCK]] == b[j[k : k + BLOCK]]).any(1) for k in range(0, len(i), BLOCK)])
            i, j = i[new], j[new]
        out = pd.DataFrame({"id1": v["id"].to_numpy()[i], "id2": m["id"].to_numpy()[j], "value": value[i, j]})
        for w in within:
            out[w] = m[w].iloc[0] if len(m) else None
        return out[["id1", "id2", "value", *within]]

    return meet(placed, placed, [*within, "table", "bucket"], kernel, schema, block)


def similar_pairs_approx(df: DataFrame, id: str, vec: str, min_sim: float, recall: float = 0.95, within=None, block: int = BLOCK) -> tuple[DataFrame, Tables]:
    """(pairs as `similar_pairs` gives them, the tables by which they were found with their measured recall).

    For vectors without structure, on which the exact join has nothing to leave out. No pair below `min_sim` is given;
    `recall` of the others are, or more, as measured on the exact pairs of a sample.
    """
    points = settle(unit(distinct_vectors(df, id, vec, within).drop("copies")))
    found = choose_tables(points, min_sim, recall)
    return approx_pairs(points, min_sim, found, within, block).withColumnRenamed("value", "similarity"), found


def near_pairs(df: DataFrame, id: str, vec: str, max_dist: float, within=None, block: int = BLOCK, copies: bool = True) -> DataFrame:
    """(within…, id1, id2, distance): the same by Euclidean distance of at most `max_dist`; of all rows unless told otherwise."""
    points = distinct_rows(df, id, vec, within) if copies else distinct_vectors(df, id, vec, within).drop("copies")
    return close_pairs(points, max_dist, "euclidean", within, block).withColumnRenamed("value", "distance")


def pairs(df: DataFrame, id: str, vec: str, metric: str, limit: float, within=None, approx: bool = False) -> DataFrame:
    """Every pair of rows once, globally or per category, down to a stated limit; there is no unlimited form.

    With `approx`, pairs of distinct vectors by cosine are looked for in hash tables and 0.95 of them or more are found.
    """
    if approx:
        if metric != "cosine":
            raise ValueError("the approximate form compares by cosine")
        return similar_pairs_approx(df, id, vec, limit, within=within)[0]
    return (similar_pairs if metric == "cosine" else near_pairs)(df, id, vec, limit, within, copies=True)


def _near_others(m: pd.DataFrame, v: pd.DataFrame, limit: float, by_cosine: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(visitor, member): those within the limit of each other, none with itself."""
    x, y = matrix(v["vec"]), matrix(m["vec"])
    found = likely(x, y, np.full(len(x), (_reach_of(limit) if by_cosine else limit) * (1 + 1e-9) + 1e-9))
    if found is None:
        value = x @ y.T if by_cosine else distances(x, y)
        return np.nonzero(((value >= limit) if by_cosine else (value <= limit)) & _other(m, v))
    value = measured(x, y, *found, by_cosine)
    a, b = _codes(m, v)
    kept = ((value >= limit) if by_cosine else (value <= limit)) & (a[found[1]] != b[found[0]])
    return found[0][kept], found[1][kept]


def core_points(points: DataFrame, eps: float, min_samples: int, block: int = BLOCK) -> DataFrame:
    """(id): points with at least `min_samples` others within eps. No pair is emitted.

    Points within eps/2 of one pivot are all within eps of each other, so a clump that is large enough is decided by
    counting. Of the others only those that have too few in their own cell look around.
    """
    points = points.select("id", "vec")
    placed, pivots = cover(points, eps, False, block)
    inner = F.col("_off") <= eps / 2 - 1e-9
    clumps = placed.filter(inner).groupBy("_home").agg(F.count("*").alias("_n")).filter(F.col("_n") > min_samples)
    # One row per cell at most, so the flag costs no shuffle of the points.
    flagged = placed.join(F.broadcast(clumps), "_home", "left").withColumn("_sure", inner & F.col("_n").isNotNull())
    sure, unsure = flagged.filter("_sure").select("id"), flagged.filter("NOT _sure").drop("_n", "_sure")

    def kernel(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        n = np.bincount(_near_others(m, v, eps)[0], minlength=len(v))
        return pd.DataFrame({"id": v["id"], "n": n})[n > 0]

    def added(found: pd.DataFrame) -> pd.DataFrame:
        return found.groupby("id", as_index=False, sort=False).sum()

    def enough(visitors: DataFrame, on: str) -> DataFrame:
        part = meet(members_of(placed), visitors, [on], kernel, f"id {_type_of(points, 'id')}, n bigint", block, added)
        return part.groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_samples).select("id")

    if pivots:
        at_home = settle(enough(unsure.drop("_off", "_visits", "_group"), "_cell"))
        sure, unsure = sure.unionByName(at_home), unsure.join(at_home, "id", "left_anti")
    return enough(visitors_of(unsure), "_group").unionByName(sure)


def _forest(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Star edges that connect what the edges (a, b) connect: each id to the smallest id it reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b):
            np.minimum.at(new, root[end], low)
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(ids))
    return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})


def goes_first(id: str) -> Column:
    """Which points look around before the others; the same on every run."""
    return F.pmod(F.xxhash64(id, F.lit("first")), F.lit(FIRST_OF)) == 0


def nearby_forest(found: pd.DataFrame) -> pd.DataFrame:
    return _forest(found["a"].to_numpy(), found["b"].to_numpy())


def links(points: DataFrame, limit: float, metric: str, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that connect exactly the points a chain of close pairs connects.

    Points within half the reach of their pivot are close to each other, so they just link to it and need not meet; a block
    pair of the rest emits at most one edge per point. A dense clump therefore costs one edge per point. Points meet those of
    their own cell first, and some look around. Where most points hang together then, only the others still look around: a
    close pair that adds something has one of them in it.
    """
    from shortlens.plans.components import components

    by_cosine = metric == "cosine"
    points = settle(unit(points.select("id", "vec"))) if by_cosine else points.select("id", "vec")
    reach = _reach_of(limit) if by_cosine else float(limit)
    placed, names, pivots = _cover(points, reach, True, block)

    def kernel(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        i, j = _near_others(m, v, limit, by_cosine)
        return _forest(v["id"].to_numpy()[i], m["id"].to_numpy()[j])

    kind = _type_of(points, "id")
    schema = f"a {kind}, b {kind}"

    def around(rows: DataFrame, visits: str | Column) -> DataFrame:
        # Nobody asks at home again.
        at_home = F.col("_group") == F.floor(F.col("_home") / F.col("_per"))
        others = F.col("_mask").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, _home % _per)")))
        visitors = asking(rows, visits).withColumn("_mask", F.when(at_home, others).otherwise(F.col("_mask")))
        visitors = visitors.filter("_mask <> 0").drop("_off")
        return meet(members_of(placed), visitors, ["_group"], kernel, schema, block, nearby_forest)

    if not names:
        return meet(members_of(placed), visitors_of(placed), ["_group"], kernel, schema, block, nearby_forest)
    inner = F.col("_off") <= reach / 2 - 1e-9
    centers = small_table(points.sparkSession, list(enumerate(names)), f"_home int, b {kind}")
    stars = placed.filter(inner).join(centers, "_home").select(F.col("id").alias("a"), "b").filter("a <> b")
    own = placed.filter(~inner).drop("_off", "_visits", "_group")
    found = settle(meet(members_of(placed), own, ["_cell"], kernel, schema, block, nearby_forest).unionByName(stars))
    if len(names) <= FEW_CELLS:
        return found.unionByName(around(placed, "_visits"))
    everywhere = place(F.col("vec"), F.lit(reach), pivots, False)["visits"]
    found = settle(found.unionByName(around(placed.filter(goes_first("id")), everywhere)))
    chains = settle(components(found))
    largest = chains.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").first()
    if largest is None or 2 * largest["n"] < placed.count():
        return found.unionByName(around(placed, "_visits"))
    whole = chains.filter(F.col("component") == F.lit(largest["component"])).select("id")
    rest = settle(placed.join(whole, "id", "left_anti"))
    return found.unionByName(around(rest, everywhere))


class _Nearest:
    """The k nearest members of each visitor of a task, ties to the smaller neighbour; what a visitor has bounds what it looks at."""

    def __init__(self, m: pd.DataFrame, v: pd.DataFrame, k: int):
        codes, self.names = pd.factorize(np.concatenate([m["id"].to_numpy(), v["id"].to_numpy()]), sort=True)
        m["_code"], v["_code"] = codes[: len(m)], codes[len(m) :]
        self.k, self.ids = k, v["id"].to_numpy()
        self.far, self.who = np.full((len(v), k), np.inf), np.full((len(v), k), -1)
        # What is measured again in another block may differ in the last digits.
        self.reach = v["_reach"].to_numpy(np.float64) * (1 + 1e-9) + 1e-12 if "_reach" in v else np.full(len(v), np.inf)

    def add(self, m: pd.DataFrame, v: pd.DataFrame) -> None:
        at, x, y = v.index.to_numpy(), matrix(v["vec"]), matrix(m["vec"])
        own, other = v["_code"].to_numpy(), m["_code"].to_numpy()
        reach = np.minimum(self.reach[at], self.far[at, -1])
        found = likely(x, y, reach) if np.isfinite(reach).any() else None
        if found is None:
            found = self._all(x, y, own, other, reach)
        i, j = found
        apart = measured(x, y, i, j)
        kept = (apart <= reach[i]) & (own[i] != other[j]) & np.isfinite(apart)
        self._merge(at, i[kept], other[j[kept]], apart[kept])

    def _all(self, x: np.ndarray, y: np.ndarray, own: np.ndarray, other: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those that may be among the k nearest, by all distances."""
        which = np.arange(len(y))
        while True:
            dist = np.where(own[:, None] != other[which][None, :], distances(x, y[which]), np.inf)
            top = min(self.k, dist.shape[1]) - 1
            kth = np.minimum(np.partition(dist, top, axis=1)[:, top], reach) * (1 + 1e-5) + 1e-12
            hit = (dist <= kth[:, None]) & np.isfinite(dist)
            if len(which) < len(y) or hit.sum() <= 8 * self.k * len(x):
                break
            # Of many equal vectors only the smallest ids can count, and one of them may be the visitor.
            order = np.lexsort([other, *y.T])
            new = np.concatenate([[True], (y[order[1:]] != y[order[:-1]]).any(1)])
            start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            which = order[np.arange(len(order)) - start <= self.k]
            if len(which) == len(y):
                break
        i, j = np.nonzero(hit)
        return i, which[j]

    def _merge(self, at: np.ndarray, i: np.ndarray, who: np.ndarray, apart: np.ndarray) -> None:
        if not len(i):
            return
        some = np.unique(i)
        rows, k = at[some], self.k
        i = np.concatenate([np.repeat(np.arange(len(some)), k), np.searchsorted(some, i)])
        far, who = np.concatenate([self.far[rows].ravel(), apart]), np.concatenate([self.who[rows].ravel(), who])
        order = np.lexsort([who, far, i])
        i, far, who = i[order], far[order], who[order]
        rank = np.arange(len(i)) - np.searchsorted(i, np.arange(len(some)))[i]
        kept = rank < k
        self.far[rows], self.who[rows] = far[kept].reshape(-1, k), who[kept].reshape(-1, k)

    def parts(self) -> Iterator[pd.DataFrame]:
        step = max(1, MERGED // self.k)
        for at in range(0, len(self.ids), step):
            i, j = np.nonzero(self.who[at : at + step] >= 0)
            who = self.names[self.who[at + i, j]]
            yield pd.DataFrame({"id": self.ids[at + i], "neighbor": who, "distance": self.far[at + i, j]})


def placed_by_pivot(points: DataFrame, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(placed, pivots): settled points with `_home`, `_cell` and `_group` of their nearest pivot; no pivots when one cell will do."""
    n = points.count()
    if n <= 2 * block:
        none = np.empty((0, 0))
        return grouped(points.withColumn("_home", F.lit(0)), "_home", none, n, block), none
    _, pivots = choose_pivots(points, -(-n // block))
    placed = points.withColumn("_home", place(F.col("vec"), F.lit(0.0), pivots, False)["home"])
    return settle(grouped(placed, "_home", pivots, n, block)), pivots


def nearest(points: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(id, rank, neighbor, distance): the k nearest other points, exact; ties go to the smaller id.

    First each cell answers for its own points; the k-th distance found there bounds how far a point must look.
    """
    points = settle(points.select("id", "vec"))
    kind = _type_of(points, "id")
    schema = f"id {kind}, neighbor {kind}, distance double"
    ranked = Window.partitionBy("id").orderBy("distance", "neighbor")

    def best(df: DataFrame) -> DataFrame:
        top = df.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
        return top.select("id", "rank", "neighbor", "distance")

    def top(m: pd.DataFrame, v: pd.DataFrame) -> _Nearest:
        return _Nearest(m, v, k)

    placed, pivots = placed_by_pivot(points, block)
    own = best(meet(placed, placed, ["_cell"], None, schema, block, gather=top))
    if not len(pivots):
        return own
    own = settle(own)
    bound = own.filter(F.col("rank") == k).select("id", F.col("distance").alias("_reach"))
    far = F.coalesce(F.col("_reach"), F.lit(float("inf")))
    bounded = placed.join(bound, "id", "left").withColumn("_reach", far)
    visitors = asking(bounded, place(F.col("vec"), F.col("_reach"), pivots, False)["visits"])
    return best(meet(placed, visitors, ["_group"], None, schema, block, gather=top))


def knn(df: DataFrame, id: str, vec: str, k: int, metric: str = "euclidean", block: int = BLOCK, copies: bool = True) -> DataFrame:
    """(id, rank, neighbor, distance) of every id; with cosine, the distance is that of the unit vectors.

    Ids with equal vectors are neighbours at distance 0; without `copies` they are one point, named by the smallest.
    """
    points = distinct_rows(df, id, vec) if copies else distinct_vectors(df, id, vec)
    return nearest(unit(points) if metric == "cosine" else points, k, block)


def core_distances(df: DataFrame, id: str, vec: str, k: int, block: int = BLOCK) -> DataFrame:
    """(id, core_distance): distance to the k-th nearest other distinct vector."""
    found = knn(df, id, vec, k, block=block, copies=False).filter(F.col("rank") == k)
    return found.select("id", F.col("distance").alias("core_distance"))


def _best_of_each(pairs: pa.Table, value: str) -> pa.Table:
    """The row of the largest (value, id2) of each id1."""
    pairs = pairs.sort_by([("id1", "ascending"), (value, "descending"), ("id2", "descending")]).combine_chunks()
    ids = pairs["id1"]
    other = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy()
    return pairs.filter(pa.array(np.concatenate([[True], other])))


def best_match(pairs: DataFrame, value: str = "similarity") -> DataFrame:
    """(id, match, value): the most similar partner of each row, ties to the larger key.

    Each task makes one row per id of the pairs it reads, both directions at a time, so the pairs are neither read twice nor
    sorted or shuffled.
    """
    pairs = pairs.select("id1", "id2", value)
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, limit = [], 0, MERGED
        for batch in batches:
            one = pa.Table.from_batches([batch])
            both = pa.concat_tables([one, one.select(["id2", "id1", value]).rename_columns(names).cast(one.schema)])
            # What does not compare is left to Spark.
            plain = pc.and_(pc.and_(both["id1"].is_valid(), both["id2"].is_valid()), pc.equal(both[value], both[value]).fill_null(False))
            yield from both.filter(pc.invert(plain)).to_batches()
            held.append(both.filter(plain))
            n += len(held[-1])
            if n > limit:
                held = [_best_of_each(pa.concat_tables(held), value)]
                n = len(held[0])
                limit = MERGED + 2 * n
        if n:
            yield from _best_of_each(pa.concat_tables(held), value).to_batches()

    kinds = ", ".join(f"{c} {_type_of(pairs, c)}" for c in names)
    both = pairs.mapInArrow(run, kinds)
    top = both.groupBy("id1").agg(F.max(F.struct(value, "id2")).alias("top"))
    return top.select(F.col("id1").alias("id"), F.col("top.id2").alias("match"), F.col(f"top.{value}").alias(value))


def centroid_distances(cents: DataFrame, n: int, cluster: str = "cluster", centroid: str = "centroid") -> DataFrame:
    """(cluster, rank, neighbor, distance): the n nearest other centroids of each, without a cross join."""
    points = cents.select(F.col(cluster).alias("id"), doubles(F.col(centroid)).alias("vec"))
    return nearest(points, n).withColumnRenamed("id", cluster)


def nearest_cluster(cents: DataFrame, cluster: str = "cluster", centroid: str = "centroid") -> DataFrame:
    """(cluster, neighbor, distance): the closest other centroid, also when two coincide; ties to the smaller id."""
    return centroid_distances(cents, 1, cluster, centroid).drop("rank")


def mean_intra_similarity(df: DataFrame, cluster: str, vec: str) -> DataFrame:
    """(cluster, members, mean_similarity): mean cosine over the pairs inside each cluster, in one pass.

    The length of the summed unit vectors holds the sum over all pairs, so none is formed. One member: null.
    """
    units = unit(df.select(cluster, doubles(F.col(vec)).alias("vec")).filter("vec is not null"))
    n = F.col("members").cast("double")
    square = F.pow(norm(F.col("centroid")), 2) * n * n
    mean = F.try_divide(square - n, F.nullif(n * (n - 1), F.lit(0.0)))
    return group_means(units, cluster, "vec").select(cluster, "members", mean.alias("mean_similarity"))
