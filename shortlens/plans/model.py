"""A stored density model: fitted once, kept in versions, asked later about vectors it has not seen.

The model is a folder with one table of points (vector, core distance, place in the cluster tree, cell) and one of pivots. Later
batches, also in other sessions, look their nearest stored points up cell by cell; nothing of the model is fitted again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shortlens.operators.neighbors import BLOCK, asking, copies_of, distances, distinct_vectors, grouped, matrix, meet, place, placed_by_pivot
from shortlens.plans.hierarchy import known_neighbors, tree_points
from shortlens.runtime import settle

# Distances below this count as this, so that a point on an exemplar has a share of nearly 1 there.
LEAST_DISTANCE = 1e-9
# Numbers of a distance matrix held at a time.
MATRIX = 1 << 22


@dataclass
class DensityModel:
    """`points`: (id, vec, core, w, cluster, formed, top, exemplar, home); `cluster` is null outside chosen clusters."""

    points: DataFrame
    pivots: np.ndarray
    min_samples: int
    version: int


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of whole versions under `path`; the table of pivots is written last."""
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = home.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(home):
        return []
    names = [s.getPath() for s in files.listStatus(home) if s.getPath().getName().startswith("v")]
    mark = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n.getName()[1:]) for n in names if files.exists(mark(f"{n.toString()}/pivots/_SUCCESS")))


def fit_model(
    df: DataFrame,
    id: str,
    vec: str,
    path: str,
    min_samples: int = 2,
    min_cluster_size: int = 5,
    method: str = "leaf",
    epsilon: float = 0.75,
    block: int = BLOCK,
) -> int:
    """Fit the cluster tree of `df` and store it as the next version under `path`; gives its number.

    Equal vectors are one point, null vectors take no part. Earlier versions stay as they are.
    """
    spark = df.sparkSession
    number = max(_versions(spark, path), default=0) + 1
    points = settle(distinct_vectors(df, id, vec).select("id", "vec"))
    # One search serves the tree and the core distances.
    near = settle(known_neighbors(points, min_samples, block))
    core = near.filter(F.col("rank") <= min_samples).groupBy("id").agg(F.max("distance").alias("core"))
    found = tree_points(df, id, vec, min_samples, min_cluster_size, method, epsilon, block, near)
    placed, pivots = placed_by_pivot(points, block)
    rows = placed.select("id", "vec", F.col("_home").cast("int").alias("home")).join(core, "id", "left").join(found, "id", "left")
    fields = ["id", "vec", F.coalesce("core", F.lit(0.0)).alias("core"), "w", "cluster", "formed", "top", F.coalesce("exemplar", F.lit(False)).alias("exemplar"), "home"]
    # Overwrites only what an unfinished run left in the folder of this number.
    rows.select(*fields).write.mode("overwrite").parquet(f"{path}/v{number}/points")
    table = [(i, p.tolist(), min_samples) for i, p in enumerate(pivots)] or [(-1, [], min_samples)]
    spark.createDataFrame(table, "pivot int, vec array<double>, min_samples int").coalesce(1).write.mode("overwrite").parquet(f"{path}/v{number}/pivots")
    return number


def load_model(spark: SparkSession, path: str, version: int | None = None) -> DensityModel:
    """The stored model, the latest version unless one is named."""
    known = _versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no such model under {path}: {version if known else 'none stored'}")
    version = version or known[-1]
    rows = spark.read.parquet(f"{path}/v{version}/pivots").orderBy("pivot").collect()  # at most MAX_PIVOTS
    pivots = np.array([r["vec"] for r in rows if r["pivot"] >= 0], dtype=np.float64)
    return DensityModel(spark.read.parquet(f"{path}/v{version}/points"), pivots, rows[0]["min_samples"], version)


def _closest(k: int):
    """The k nearest members of each visitor, ties to the smaller id."""

    def kernel(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(m) or not len(v):  # blocks are dealt by hash, so one can be empty
            return pd.DataFrame(columns=["id", "neighbor", "distance", "core"])
        dist = distances(matrix(v["vec"]), matrix(m["vec"]))
        top = min(k, dist.shape[1])
        kth = np.partition(dist, top - 1, axis=1)[:, top - 1]
        i, j = np.nonzero(dist <= kth[:, None])
        out = pd.DataFrame({"id": v["id"].to_numpy()[i], "neighbor": m["id"].to_numpy()[j], "distance": dist[i, j], "core": m["core"].to_numpy()[j]})
        return out.sort_values(["id", "distance", "neighbor"]).groupby("id", sort=False).head(k)

    return kernel


def _entry(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
    """The member with the least mutual reachability of each visitor, ties to the smaller id."""
    if not len(m) or not len(v):
        return pd.DataFrame(columns=["id", "reach", "neighbor"])
    m = m.sort_values("id")
    reach = distances(matrix(v["vec"]), matrix(m["vec"]))
    np.maximum(reach, v["core"].to_numpy()[:, None], out=reach)
    np.maximum(reach, m["core"].to_numpy()[None, :], out=reach)
    at = reach.argmin(1)
    return pd.DataFrame({"id": v["id"], "reach": reach[np.arange(len(v)), at], "neighbor": m["id"].to_numpy()[at]})


def _look_up(model: DensityModel, asked: DataFrame, block: int) -> DataFrame:
    """(id, core, reach, neighbor): by which stored point each of `asked` (id, vec) would enter the tree, and at which distance."""
    kind, own_kind = asked.schema["id"].dataType.simpleString(), model.points.schema["id"].dataType.simpleString()
    k, pivots = model.min_samples, model.pivots
    members = grouped(model.points.select("id", "vec", "core", "home"), "home", pivots, model.points.count(), block).drop("home")

    def visitors(rows: DataFrame, reach) -> DataFrame:
        return asking(rows, place(F.col("vec"), reach, pivots, False)["visits"]) if len(pivots) else rows.withColumn("_group", F.lit(0))

    def best(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("id").orderBy("distance", "neighbor")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    schema = f"id {kind}, neighbor {own_kind}, distance double, core double"
    def top(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["id", "distance", "neighbor"]).groupby("id", sort=False).head(k)

    def first(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["id", "reach", "neighbor"]).drop_duplicates("id")

    at = place(F.col("vec"), F.lit(-1.0), pivots, False)["home"] if len(pivots) else F.lit(0)
    near = settle(best(meet(members, asked.withColumn("_cell", at), ["_cell"], _closest(k), schema, block, top)))
    if len(pivots):
        bound = near.filter(F.col("rank") == k).select("id", F.col("distance").alias("_reach"))
        far = visitors(asked.join(bound, "id", "left"), F.coalesce("_reach", F.lit(float("inf")))).drop("_reach")
        near = settle(best(meet(members, far, ["_group"], _closest(k), schema, block, top)))
    cores = near.groupBy("id").agg(F.max("distance").alias("_core"))
    # One of the nearest offers a way in; a better one is nearer than that offer.
    offered = near.join(cores, "id").groupBy("id", F.col("_core").alias("core")).agg(F.min(F.greatest("distance", "_core", "core")).alias("_reach"))
    offers = visitors(asked.join(offered, "id"), F.col("_reach")).drop("_reach")
    found = meet(members, offers, ["_group"], _entry, f"id {kind}, reach double, neighbor {own_kind}", block, first)
    least = found.groupBy("id").agg(F.min(F.struct("reach", "neighbor")).alias("entry"))
    return least.join(cores, "id").select("id", F.col("_core").alias("core"), "entry.*")


def _back(df: DataFrame, id: str, vec: str, reps: DataFrame, answers: DataFrame, defaults: dict) -> DataFrame:
    """One row per row of `df`: the answer of its distinct vector (rep, …), else the defaults."""
    rows = copies_of(df, id, vec, reps).join(answers, "rep").drop("rep")
    out = df.select(id).join(rows, id, "left")
    return out.select(id, *[F.coalesce(name, value).alias(name) for name, value in defaults.items()])


def assign(model: DensityModel, df: DataFrame, id: str, vec: str, block: int = BLOCK) -> DataFrame:
    """(id, cluster, probability): where each vector belongs in the stored tree; -1 is noise, with probability 0.

    A vector the model holds keeps its place. Any other enters by the stored point of least mutual reachability (its own core
    distance is to the `min_samples`-th stored point), at that distance or where the point itself was taken in, if later. It
    is in the point's cluster if that has not merged by then. Null vectors are noise; `id` should be unique.
    """
    reps = settle(distinct_vectors(df, id, vec).select("id", "vec"))
    held = model.points.select("vec", "w", "cluster", "formed", "top")
    kept = reps.join(held, "vec").select(F.col("id").alias("rep"), F.col("w").alias("at"), "cluster", "formed", "top")
    asked = settle(reps.join(held.select("vec"), "vec", "left_anti").select("id", "vec"))
    entry = _look_up(model, asked, block)
    own = model.points.select(F.col("id").alias("neighbor"), "w", "cluster", "formed", "top").filter("cluster is not null")
    fresh = entry.join(own, "neighbor").select(F.col("id").alias("rep"), F.greatest("reach", "w").alias("at"), "cluster", "formed", "top")
    inside = kept.unionByName(fresh.filter(F.col("at") < F.col("top"))).filter("cluster is not null")
    answers = inside.select("rep", "cluster", (F.col("formed") / F.greatest("at", "formed")).alias("probability"))
    return _back(df, id, vec, reps, answers, {"cluster": F.lit(-1).cast("bigint"), "probability": F.lit(0.0)})


def _memberships(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
    """Per visitor over the clusters of these exemplars: sum of 1/distance, of that times strength, and the best of each."""
    if not len(m) or not len(v):
        return pd.DataFrame(columns=["id", "total", "value", "cluster", "strength"])
    m = m.sort_values("id", kind="stable")
    names, starts = np.unique(m["id"].to_numpy(), return_index=True)
    centers, core, formed = matrix(m["vec"]), m["core"].to_numpy(), m["formed"].to_numpy()[starts]
    out, step = [], max(1, MATRIX // len(m))
    for at in range(0, len(v), step):
        part = v.iloc[at : at + step]
        dist = distances(matrix(part["vec"]), centers)
        reach = np.maximum(np.maximum(dist, core[None, :]), part["core"].to_numpy()[:, None])
        pull = 1 / np.maximum(np.minimum.reduceat(dist, starts, axis=1), LEAST_DISTANCE)
        strength = formed[None, :] / np.maximum(np.minimum.reduceat(reach, starts, axis=1), formed[None, :])
        merged = pull * strength
        best = merged.argmax(1)
        out.append(pd.DataFrame({"id": part["id"], "total": merged.sum(1), "value": merged[np.arange(len(part)), best], "cluster": names[best], "strength": strength.max(1)}))
    return pd.concat(out)


def exemplar_membership(model: DensityModel, df: DataFrame, id: str, vec: str, block: int = BLOCK) -> DataFrame:
    """(id, soft_cluster, soft_probability): membership by the exemplars of each cluster, noise included.

    Two scores are merged for each cluster: one over the distance to its nearest exemplar, and its strength there, which is
    the distance at which the cluster formed over the least mutual reachability to an exemplar, at most 1. The product's share
    of the sum over clusters, times the largest strength, is the probability; ties go to the smaller cluster. Without
    clusters, or for a null vector, the answer is -1 and 0. All exemplars of a cluster meet a block of points in one task:
    about `min_cluster_size` for each leaf, more only where very many are equally dense.
    """
    reps = settle(distinct_vectors(df, id, vec).select("id", "vec"))
    kind = reps.schema["id"].dataType.simpleString()
    held = model.points.select("vec", F.col("core").alias("_core"))
    own = settle(reps.join(held, "vec", "left"))
    entry = _look_up(model, settle(own.filter("_core is null").select("id", "vec")), block).select("id", "core")
    asked = own.join(entry, "id", "left").select("id", "vec", F.coalesce("_core", "core").alias("core"), F.lit(0).alias("_all"))
    centers = model.points.filter("exemplar").select(F.col("cluster").alias("id"), "vec", "core", "formed", F.lit(0).alias("_all"))
    schema = f"id {kind}, total double, value double, cluster bigint, strength double"
    part = meet(centers, asked, ["_all"], _memberships, schema, block)
    merged = part.groupBy("id").agg(
        F.sum("total").alias("total"), F.max(F.struct("value", (-F.col("cluster")).alias("minus"))).alias("top"), F.max("strength").alias("strength")
    )
    answers = merged.select(F.col("id").alias("rep"), (-F.col("top.minus")).alias("soft_cluster"), (F.col("top.value") / F.col("total") * F.col("strength")).alias("soft_probability"))
    return _back(df, id, vec, reps, answers, {"soft_cluster": F.lit(-1).cast("bigint"), "soft_probability": F.lit(0.0)})
