"""Scores of a clustering. Noise counts as a cluster of its own unless `drop_noise`."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlens.functions.vectors import dot, doubles, euclidean, l2_normalize, norm, squared_distance
from shortlens.operators.aggregates import group_means
from shortlens.operators.neighbors import BLOCK, asking, core_distances, distances, goes_first, likely, matrix, measured, meet, nearby_forest, place, placed_by_pivot
from shortlens.plans.components import components
from shortlens.plans.hierarchy import STRETCH, join_parts, shortest_of_each, shortest_way_out
from shortlens.runtime import settle


def _points(df: DataFrame, id: str, vec: str, cluster: str, drop_noise: bool) -> DataFrame:
    kept = df.filter(F.col(cluster) != -1) if drop_noise else df
    return kept.select(F.col(id).alias("id"), doubles(F.col(vec)).alias("vec"), F.col(cluster).alias("cluster"))


def silhouette(
    df: DataFrame, id: str, vec: str, cluster: str = "cluster", metric: str = "euclidean", drop_noise: bool = False
) -> DataFrame:
    """One row: mean over points of (b - a) / max(a, b); a point alone in its cluster counts 0.

    Cosine and squared Euclidean distances to a whole cluster follow from its mean vector, in one pass. Euclidean ones are
    summed block by block, and a point looks only at clusters that may be its nearest: the mean distance to a cluster is at
    least the distance to its mean, and at most the root of its mean squared distance.
    """
    points = _points(df, id, vec, cluster, drop_noise)
    if metric == "cosine":
        return _linear_silhouette(points.withColumn("vec", l2_normalize(F.col("vec"))))
    if metric == "sqeuclidean":
        return _linear_silhouette(points)
    points = settle(points)
    means = group_means(points, "cluster", "vec")
    squares = points.groupBy("cluster").agg(F.avg(dot(F.col("vec"), F.col("vec"))).alias("_sq"))
    spread = F.greatest(F.col("_sq") - F.pow(norm(F.col("centroid")), 2), F.lit(0.0))
    stats = settle(means.join(squares, "cluster").select("cluster", "members", "centroid", spread.alias("spread")))
    visits = _candidate_clusters(points, stats)
    members = points.select("id", "vec", F.col("cluster").alias("_at"))
    kind = points.schema["id"].dataType.simpleString()

    def kernel(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        total = distances(matrix(v["vec"]), matrix(m["vec"])).sum(1)
        return pd.DataFrame({"id": v["id"], "at": v["_at"], "own": v["cluster"] == v["_at"], "total": total})

    schema = f"id {kind}, at {points.schema['cluster'].dataType.simpleString()}, own boolean, total double"
    def added(found: pd.DataFrame) -> pd.DataFrame:
        return found.groupby(["id", "at", "own"], as_index=False, sort=False).sum()

    sums = meet(members, visits, ["_at"], kernel, schema, merge=added).groupBy("id", "at", "own").agg(F.sum("total").alias("total"))
    sums = sums.join(stats.select(F.col("cluster").alias("at"), "members"), "at")
    a = F.max(F.when(F.col("own") & (F.col("members") > 1), F.col("total") / F.greatest(F.col("members") - 1, F.lit(1))))
    b = F.min(F.when(~F.col("own"), F.col("total") / F.col("members")))
    return _mean_score(sums.groupBy("id").agg(a.alias("a"), b.alias("b")))


def _mean_score(rows: DataFrame) -> DataFrame:
    score = F.try_divide(F.col("b") - F.col("a"), F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return rows.agg(F.avg(F.when(F.col("b").isNotNull(), F.coalesce(score, F.lit(0.0)))).alias("silhouette"))


def _bounds(stats: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Cluster ids, centroids and spreads while they are few enough to travel with a task."""
    rows = stats.limit(2049).collect()
    if len(rows) > 2048:
        return None
    rows.sort(key=lambda r: r["cluster"])
    return (
        np.array([r["cluster"] for r in rows]),
        np.array([r["centroid"] for r in rows], dtype=np.float64),
        np.array([r["spread"] for r in rows], dtype=np.float64),
    )


def _candidate_clusters(points: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, vec, cluster, _at): each point with its own cluster and all that may be the nearest other one."""
    carried = _bounds(stats)
    kind = points.schema["cluster"].dataType.simpleString()
    if carried is not None:
        names, centers, spreads = carried

        @F.pandas_udf(f"array<{kind}>")
        def near(vecs: pd.Series, own: pd.Series) -> pd.Series:
            low = distances(matrix(vecs), centers)
            mine = names[None, :] == own.to_numpy()[:, None]
            high = np.where(mine, np.inf, np.sqrt(low**2 + spreads[None, :])).min(1)
            return pd.Series([names[r] for r in mine | (low <= high[:, None] + 1e-9)])

        return points.withColumn("_at", F.explode(near(F.col("vec"), F.col("cluster"))))
    centers = stats.select(F.col("cluster").alias("id"), F.col("centroid").alias("vec"), "spread", F.lit(0).alias("_all"))
    asking = points.withColumn("_all", F.lit(0))
    id_kind = points.schema["id"].dataType.simpleString()

    def upper(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        high = np.sqrt(distances(matrix(v["vec"]), matrix(m["vec"])) ** 2 + m["spread"].to_numpy()[None, :])
        high = np.where(m["id"].to_numpy()[None, :] == v["cluster"].to_numpy()[:, None], np.inf, high)
        return pd.DataFrame({"id": v["id"], "high": high.min(1)})

    highs = meet(centers, asking, ["_all"], upper, f"id {id_kind}, high double").groupBy("id").agg(F.min("high").alias("high"))
    asking = asking.join(highs, "id")

    def within(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        low = distances(matrix(v["vec"]), matrix(m["vec"])) <= v["high"].to_numpy()[:, None] + 1e-9
        i, j = np.nonzero(low | (m["id"].to_numpy()[None, :] == v["cluster"].to_numpy()[:, None]))
        return pd.DataFrame({"id": v["id"].to_numpy()[i], "_at": m["id"].to_numpy()[j]})

    return points.join(meet(centers, asking, ["_all"], within, f"id {id_kind}, _at {kind}"), "id")


def _linear_silhouette(points: DataFrame) -> DataFrame:
    """Squared distances: the mean over a cluster is |x|² - 2 x·mean + the cluster's mean |y|². Scale does not matter."""
    points = settle(points)
    squares = points.groupBy("cluster").agg(F.avg(dot(F.col("vec"), F.col("vec"))).alias("square"))
    stats = group_means(points, "cluster", "vec").join(squares, "cluster").withColumn("_all", F.lit(0))
    centers = settle(stats.withColumnsRenamed({"cluster": "id", "centroid": "vec"}))
    kind = points.schema["id"].dataType.simpleString()

    def kernel(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        x = matrix(v["vec"])
        far = (x * x).sum(1)[:, None] - 2 * (x @ matrix(m["vec"]).T) + m["square"].to_numpy()[None, :]
        own = m["id"].to_numpy()[None, :] == v["cluster"].to_numpy()[:, None]
        n = m["members"].to_numpy()[None, :]
        inside = np.where(own & (n > 1), far * n / np.maximum(n - 1, 1), -np.inf).max(1)
        outside = np.where(own, np.inf, far).min(1)
        out = pd.DataFrame({"id": v["id"], "a": inside, "b": outside})
        return out.replace([np.inf, -np.inf], np.nan).astype(object).where(lambda d: d.notna(), None)

    part = meet(centers, points.withColumn("_all", F.lit(0)), ["_all"], kernel, f"id {kind}, a double, b double")
    return _mean_score(part.groupBy("id").agg(F.max("a").alias("a"), F.min("b").alias("b")))


def calinski_harabasz(df: DataFrame, id: str, vec: str, cluster: str = "cluster", drop_noise: bool = False) -> DataFrame:
    """One row: spread between clusters over spread within, each by its degrees of freedom. Linear in the points."""
    points = _points(df, id, vec, cluster, drop_noise)
    means = group_means(points, "cluster", "vec")
    # One vector comes to the driver.
    mean = group_means(points, [], "vec").first()
    center = F.lit(mean["centroid"] if mean["members"] else None).cast("array<double>")
    apart = F.col("members") * squared_distance(F.col("centroid"), center)
    off = points.join(means, "cluster").agg(F.sum(squared_distance(F.col("vec"), F.col("centroid"))))
    scores = means.agg(F.sum(apart).alias("between"), F.count("*").alias("k"), F.sum("members").alias("n"))
    scores = scores.withColumn("within", off.scalar())
    free = F.try_divide(F.col("n") - F.col("k"), F.nullif(F.col("k") - 1, F.lit(0)))
    return scores.select(F.try_divide(F.col("between") * free, F.nullif("within", F.lit(0.0))).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, id: str, vec: str, cluster: str = "cluster", drop_noise: bool = False) -> DataFrame:
    """One row: mean over clusters of the worst (scatter + scatter) / centroid distance. Clusters meet block by block."""
    points = _points(df, id, vec, cluster, drop_noise)
    means = group_means(points, "cluster", "vec")
    scatter = points.join(means, "cluster").groupBy("cluster").agg(
        F.avg(euclidean(F.col("vec"), F.col("centroid"))).alias("scatter"), F.first("centroid").alias("vec")
    )
    nodes = settle(scatter.withColumnRenamed("cluster", "id").withColumn("_all", F.lit(0)))
    kind = nodes.schema["id"].dataType.simpleString()

    def kernel(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        apart = distances(matrix(v["vec"]), matrix(m["vec"]))
        both = v["scatter"].to_numpy()[:, None] + m["scatter"].to_numpy()[None, :]
        same = v["id"].to_numpy()[:, None] == m["id"].to_numpy()[None, :]
        ratio = np.divide(both, apart, out=np.zeros_like(both), where=(apart > 0) & ~same)
        return pd.DataFrame({"id": v["id"], "worst": ratio.max(1)})

    worst = meet(nodes, nodes, ["_all"], kernel, f"id {kind}, worst double").groupBy("id").agg(F.max("worst").alias("worst"))
    return worst.agg(F.avg("worst").alias("davies_bouldin"))


def _light_tree(weight: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> pd.DataFrame:
    """A lightest spanning forest of the edges between rows and columns, named by ids that are unique on each side; inf means no
    edge. An id on both sides is one point."""
    ids, at = np.unique(np.concatenate([rows, columns]), return_inverse=True)
    row, column = at[: len(rows)], at[len(rows) :]
    weight, turned = np.ascontiguousarray(weight), np.ascontiguousarray(weight.T)
    as_row, as_column = np.full(len(ids), -1), np.full(len(ids), -1)
    as_row[row], as_column[column] = np.arange(len(row)), np.arange(len(column))
    best, parent, waiting = np.full(len(ids), np.inf), np.full(len(ids), -1), np.ones(len(ids), dtype=bool)
    edges, start = [], 0
    for _ in range(len(ids)):
        at = int(best.argmin())
        if np.isinf(best[at]):
            start += int(waiting[start:].argmax())
            at = start
        else:
            edges.append((parent[at], at, best[at]))
        best[at], waiting[at] = np.inf, False
        for place, ways, ends in ((as_row[at], weight, column), (as_column[at], turned, row)):
            if place >= 0:
                way = ways[place]
                closer = ends[(way < best[ends]) & waiting[ends]]
                if len(closer):
                    best[ends] = np.where(waiting[ends], np.minimum(way, best[ends]), np.inf)
                    parent[closer] = at
    a, b, w = (np.array(x) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 3
    return pd.DataFrame({"a": ids[a], "b": ids[b], "w": w.astype(np.float64)})


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, w): a lightest spanning forest of an edge list. Each round every tree takes its lightest way out."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = settle(edges.select(low.alias("a"), high.alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w")))
    tree, live = None, edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb"))
    while not live.isEmpty():
        row = F.struct("w", "a", "b", "ca", "cb")
        ends = live.select(F.col("ca").alias("c"), row.alias("e")).unionByName(live.select(F.col("cb").alias("c"), row.alias("e")))
        taken = settle(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        tree = taken.select("a", "b", "w") if tree is None else tree.unionByName(taken.select("a", "b", "w"))
        root = components(taken.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        for side in ("ca", "cb"):
            live = live.join(root.withColumnRenamed("id", side), side, "left")
            live = live.withColumn(side, F.coalesce("component", F.col(side))).drop("component")
        live = settle(live.filter("ca <> cb"))
    return edges.limit(0) if tree is None else tree


def _mutual_reach(v: pd.DataFrame, m: pd.DataFrame) -> np.ndarray:
    """The larger of the distance and both core distances."""
    cores = np.maximum(v["core"].to_numpy()[:, None], m["core"].to_numpy()[None, :])
    return np.maximum(distances(matrix(v["vec"]), matrix(m["vec"])), cores)


def _light_forest(a: np.ndarray, b: np.ndarray, w: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """(a, b, w): a lightest spanning forest of edges between the numbered `ids`."""
    order = np.argsort(w, kind="stable")
    a, b, w = a[order], b[order], w[order]
    tree, kept = np.arange(len(ids)), []
    live = np.flatnonzero(a != b)
    while len(live):
        x, y = tree[a[live]], tree[b[live]]
        # Edges lie in order of weight, so the first one of a tree is its lightest; one order of all leaves no cycle.
        first = np.full(len(ids), len(w))
        np.minimum.at(first, x, live)
        np.minimum.at(first, y, live)
        taken = np.unique(first[first < len(w)])
        kept.append(taken)
        x, y = tree[a[taken]], tree[b[taken]]
        name = np.arange(len(ids))
        while True:
            low = np.minimum(name[x], name[y])
            new = name.copy()
            for end in (x, y):
                np.minimum.at(new, name[end], low)
                np.minimum.at(new, end, low)
            new = new[new]
            if (new == name).all():
                break
            name = new
        tree = name[tree]
        live = live[tree[a[live]] != tree[b[live]]]
    at = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return pd.DataFrame({"a": ids[a[at]], "b": ids[b[at]], "w": w[at]})


def _block_tree(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
    """A lightest forest of the edges between both sides of one block pair of a cluster, within the cluster's reach."""
    m, v = m.drop_duplicates("id"), v.drop_duplicates("id")
    weight = _mutual_reach(v, m)
    out = _light_tree(np.where(weight <= v["reach"].iloc[0], weight, np.inf), v["id"].to_numpy(), m["id"].to_numpy())
    return out.assign(cluster=v["cluster"].iloc[0])


def _lighter(found: pd.DataFrame) -> pd.DataFrame:
    """A lightest forest of what block pairs of one cluster gave."""
    ids, at = np.unique(found[["a", "b"]].to_numpy(), return_inverse=True)
    at = at.reshape(-1, 2)
    return _light_forest(at[:, 0], at[:, 1], found["w"].to_numpy(), ids).assign(cluster=found["cluster"].iloc[0])


def _longest_edges(points: DataFrame, sizes: DataFrame, schema: str) -> DataFrame:
    """(cluster, loose): the longest edge of each cluster's lightest spanning tree; 0 for a single point.

    A cluster of one block is one task. The tree of a larger one cannot stay below its largest core distance, and within
    that reach mutual reachability is nothing but distance. So where its points hang together within that reach, that is the
    longest edge. They meet those of their own cell first, and some look around; then only points outside the largest part of
    the cluster do. Parts that are left take their shortest way out in rounds, as far as a reach that doubles.
    """
    small = points.join(sizes.filter(F.col("members") <= BLOCK).select("cluster"), "cluster")
    small = small.withColumn("reach", F.lit(float("inf")))
    longest = meet(small, small, ["cluster"], _block_tree, schema, BLOCK, _lighter).groupBy("cluster").agg(F.max("w").alias("loose"))
    large = points.join(sizes.filter(F.col("members") > BLOCK).select("cluster"), "cluster")
    least = large.groupBy("cluster").agg(F.max("core").alias("reach"))
    large = settle(large.join(least, "cluster"))
    if large.isEmpty():
        return longest
    kind = large.schema["id"].dataType.simpleString()
    placed, pivots = placed_by_pivot(large, BLOCK)
    at_home = placed.drop("_group")
    edges = meet(placed, at_home, ["cluster", "_cell"], _within_reach, f"a {kind}, b {kind}", BLOCK, nearby_forest)

    def around(rows: DataFrame) -> DataFrame:
        rows = asking(rows, place(F.col("vec"), F.col("reach"), pivots, False)["visits"]) if len(pivots) else rows
        return meet(placed, rows, ["cluster", "_group"], _within_reach, f"a {kind}, b {kind}", BLOCK, nearby_forest)

    edges = settle(edges.unionByName(around(placed.filter(goes_first("id")))))
    state = _parts(placed.select("id", "cluster", F.col("id").alias("component")), edges)
    state = _parts(state, settle(around(placed.join(_outside(state), ["id", "cluster"], "left_semi"))))
    found = settle(placed.groupBy("cluster").agg(F.max("reach").alias("loose"), F.max("reach").alias("reach")))
    while True:
        apart = state.groupBy("cluster").agg(F.count_distinct("component").alias("parts")).filter("parts > 1")
        todo = settle(found.join(apart, "cluster"))
        if todo.isEmpty():
            return longest.unionByName(found.select("cluster", "loose"))
        now = placed.drop("reach").join(state, ["id", "cluster"]).join(todo.select("cluster", (2 * F.col("reach")).alias("reach")), "cluster")
        now = settle(now)
        out = now.join(_outside(state), ["id", "cluster"], "left_semi")
        out = asking(out, place(F.col("vec"), F.col("reach"), pivots, False)["visits"]) if len(pivots) else out
        ways = meet(now, out, ["cluster", "_group"], _ways_out, f"cluster {_kind(points, 'cluster')}, component {kind}, w double, a {kind}, b {kind}", BLOCK, _shortest_ways)
        chosen = settle(ways.groupBy("cluster", "component").agg(F.min(F.struct("w", "a", "b")).alias("edge")).select("cluster", "edge.*"))
        steps = chosen.groupBy("cluster").agg(F.max("w").alias("_w"))
        # Where nothing was in reach the reach doubles, where parts joined it stays.
        widened = todo.select("cluster", (2 * F.col("reach")).alias("_wide")).join(steps.select("cluster"), "cluster", "left_anti")
        found = found.join(steps, "cluster", "left").join(widened, "cluster", "left")
        found = settle(found.select("cluster", F.greatest("loose", "_w").alias("loose"), F.coalesce("_wide", "reach").alias("reach")))
        few = todo.agg(F.sum("parts")).first()[0] <= STRETCH
        state = _parts(state, chosen, few)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _within_reach(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
    """(a, b): edges that connect what is within the `reach` of each other."""
    x, y, reach = matrix(v["vec"]), matrix(m["vec"]), v["reach"].to_numpy(np.float64)
    found = likely(x, y, reach * (1 + 1e-9))
    if found is None:
        found = np.nonzero(distances(x, y) <= reach[:, None])
    else:
        kept = measured(x, y, *found) <= reach[found[0]]
        found = found[0][kept], found[1][kept]
    a, b = v["id"].to_numpy()[found[0]], m["id"].to_numpy()[found[1]]
    return nearby_forest(pd.DataFrame({"a": a, "b": b})[a != b])


def _ways_out(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
    return shortest_way_out(m, v).assign(cluster=v["cluster"].iloc[0])


def _shortest_ways(found: pd.DataFrame) -> pd.DataFrame:
    """Of one cluster."""
    return shortest_of_each(found)


def _parts(state: DataFrame, edges: DataFrame, few: bool = False) -> DataFrame:
    """(id, cluster, component) after parts of clusters joined along edges between their points; `few` of them in one task."""
    at = state.select("id", "component")
    ends = edges.join(at.toDF("a", "_a"), "a").join(at.toDF("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    kind = _kind(state, "component")
    joined = join_parts(ends, f"component {kind}, _new {kind}") if few else components(ends).toDF("component", "_new")
    return settle(state.join(joined, "component", "left").select("id", "cluster", F.coalesce("_new", "component").alias("component")))


def _outside(state: DataFrame) -> DataFrame:
    """(id, cluster): the points outside the largest part of their cluster."""
    sizes = state.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("cluster").agg(F.max(F.struct("n", "component"))["component"].alias("component"))
    return state.join(largest, ["cluster", "component"], "left_anti").select("id", "cluster")


def density_validity(df: DataFrame, id: str, vec: str, cluster: str = "cluster", min_samples: int = 2) -> DataFrame:
    """One row: how far clusters are apart against how loose they are, weighted by size over all distinct vectors, noise too.

    Distance is mutual reachability. A cluster's looseness is the longest edge of its lightest spanning tree, its
    separation the least distance to another cluster. Block pairs emit a forest or one row per cluster, never their pairs.
    """
    core = settle(core_distances(df, id, vec, min_samples))
    total = core.count()
    points = _points(df, id, vec, cluster, True).join(core, "id").withColumnRenamed("core_distance", "core")
    points = settle(points)
    id_kind, kind = (points.schema[c].dataType.simpleString() for c in ("id", "cluster"))
    sizes = settle(points.groupBy("cluster").agg(F.count("*").alias("members")))
    loose = _longest_edges(points, sizes, f"a {id_kind}, b {id_kind}, w double, cluster {kind}")

    def gaps(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        same = v["cluster"].to_numpy()[:, None] == m["cluster"].to_numpy()[None, :]
        out = pd.DataFrame({"cluster": v["cluster"], "apart": np.where(same, np.inf, _mutual_reach(v, m)).min(1)})
        return closest(out)

    def closest(found: pd.DataFrame) -> pd.DataFrame:
        return found.groupby("cluster", as_index=False).min()

    # What a cluster finds in the cells of its own points bounds how far those points must look in other cells.
    schema = f"cluster {kind}, apart double"
    placed, pivots = placed_by_pivot(points, BLOCK)
    near = settle(meet(placed, placed, ["_cell"], gaps, schema, BLOCK, closest).groupBy("cluster").agg(F.min("apart").alias("apart")))
    apart = near
    if len(pivots):
        # Nothing is nearer to a point than its core distance.
        asked = settle(placed.join(near, "cluster").filter(F.col("core") <= F.col("apart")))
        visitors = asking(asked, place(F.col("vec"), F.col("apart"), pivots, False)["visits"]).drop("apart")
        most = near.agg(F.max("apart")).first()[0]
        apart = near.unionByName(meet(placed.filter(F.col("core") <= most), visitors, ["_group"], gaps, schema, BLOCK, closest))
    apart = apart.groupBy("cluster").agg(F.min("apart").alias("apart"))
    rows = sizes.join(apart, "cluster").join(loose, "cluster", "left").withColumn("loose", F.coalesce("loose", F.lit(0.0)))
    score = F.try_divide(F.col("apart") - F.col("loose"), F.nullif(F.greatest("apart", "loose"), F.lit(0.0)))
    lone = F.col("apart") == float("inf")
    part = F.when(lone, F.lit(None)).otherwise(score) * F.col("members") / F.lit(float(total))
    return rows.agg(F.sum(part).alias("density_validity"))
