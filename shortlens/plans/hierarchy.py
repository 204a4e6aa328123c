"""The density hierarchy of vectors: spanning tree of mutual reachability, condensed cluster tree, choice of clusters, strength.

Distance between two points is their mutual reachability: the largest of their distance and of both core distances. Every cut of
the lightest spanning tree at a distance gives the density clusters at that distance; the condensed tree keeps only what
happens to groups of at least `min_cluster_size` points as the distance grows: they appear, take in points, and merge.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlens.operators.neighbors import BLOCK, asking, copies_of, distances, distinct_vectors, likely, matrix, measured, meet, nearest, place, placed_by_pivot
from shortlens.operators.ranking import with_position
from shortlens.plans.components import components
from shortlens.runtime import settle

# Neighbours of each point known from the start; most merges need no further search.
NEIGHBORS = 8
# Edges that one task merges in order of length, about 2 KB each there; longer trees are merged stretch by stretch.
STRETCH = 250_000


def _reach(v: pd.DataFrame, m: pd.DataFrame) -> np.ndarray:
    """Mutual reachability between all rows of both, infinite inside a component."""
    out = distances(matrix(v["vec"]), matrix(m["vec"]))
    np.maximum(out, v["core"].to_numpy()[:, None], out=out)
    np.maximum(out, m["core"].to_numpy()[None, :], out=out)
    out[v["component"].to_numpy()[:, None] == m["component"].to_numpy()[None, :]] = np.inf
    return out


def shortest_way_out(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
    """(component, w, a, b): per component of the visitors the shortest edge to a member of another, no longer than their `reach`."""
    limit = v["reach"].to_numpy(np.float64)
    x, y = matrix(v["vec"]), matrix(m["vec"])
    found = likely(x, y, limit * (1 + 1e-9)) if np.isfinite(limit).any() else None
    if found is None:
        reach = _reach(v, m)
        j = reach.argmin(1)
        i, w = np.arange(len(v)), reach[np.arange(len(v)), j]
    else:
        i, j = found
        apart = v["component"].to_numpy()[i] != m["component"].to_numpy()[j]
        i, j = i[apart], j[apart]
        w = np.maximum(np.maximum(measured(x, y, i, j), v["core"].to_numpy()[i]), m["core"].to_numpy()[j])
    kept = np.isfinite(w) & (w <= limit[i])
    i, j = i[kept], j[kept]
    return shortest_of_each(pd.DataFrame({"component": v["component"].to_numpy()[i], "w": w[kept], "a": v["id"].to_numpy()[i], "b": m["id"].to_numpy()[j]}))


def shortest_of_each(ways: pd.DataFrame) -> pd.DataFrame:
    """The first of the shortest ways of each component."""
    return ways.sort_values(["w", "a", "b"]).drop_duplicates("component")


def join_parts(ways: DataFrame, schema: str) -> DataFrame:
    """(component, _new): what components become when they join along `ways`. One task; for at most `STRETCH` components."""

    def run(ways: pd.DataFrame) -> pd.DataFrame:
        above: dict = {}

        def root(x):
            while above.setdefault(x, x) != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for a, b in zip(ways["a"], ways["b"]):
            x, y = root(a), root(b)
            above[max(x, y)] = min(x, y)
        return pd.DataFrame({"component": list(above), "_new": [root(x) for x in above]})

    return ways.groupBy(F.lit(0).alias("_all")).applyInPandas(run, schema)


def known_neighbors(points: DataFrame, min_samples: int = 2, block: int = BLOCK) -> DataFrame:
    """(id, rank, neighbor, distance): the neighbours that `spanning_tree` starts from; the one of rank `min_samples` gives a point's core distance."""
    return nearest(points, max(min_samples, NEIGHBORS), block)


def spanning_tree(df: DataFrame, id: str, vec: str, min_samples: int = 2, block: int = BLOCK, near: DataFrame | None = None) -> DataFrame:
    """(a, b, w): edges of a lightest spanning tree of the distinct vectors by mutual reachability.

    In each round every component but the largest takes its shortest edge to another. The nearest neighbours of its points
    offer one; only points that could have a shorter one than that look around, and only in cells within that reach. Where
    edges are equally long a few more than needed may come back; they close cycles of equal edges and change no cluster.
    `near` are the settled `known_neighbors`, where the caller has them.
    """
    points = settle(distinct_vectors(df, id, vec).select("id", "vec"))
    kind = points.schema["id"].dataType.simpleString()
    k = max(min_samples, NEIGHBORS)
    near = near if near is not None else settle(known_neighbors(points, min_samples, block))
    far = near.groupBy("id").agg(F.max(F.when(F.col("rank") == min_samples, F.col("distance"))).alias("core"), F.max("distance").alias("least"), F.count("*").alias("known"))
    # Fewer neighbours than asked for: all points are known, so nothing shorter can be missed.
    far = far.select("id", F.coalesce("core", "least").alias("core"), F.when(F.col("known") < k, float("inf")).otherwise(F.col("least")).alias("least"))
    placed, pivots = placed_by_pivot(settle(points.join(far, "id")), block)
    ends = placed.select("id", "core")
    edges = near.select(F.col("id").alias("a"), F.col("neighbor").alias("b"), "distance")
    edges = edges.join(ends.select(F.col("id").alias("a"), F.col("core").alias("_a")), "a").join(ends.select(F.col("id").alias("b"), F.col("core").alias("_b")), "b")
    edges = settle(edges.select("a", "b", F.greatest("distance", "_a", "_b").alias("w")))
    state = settle(placed.select("id", F.col("id").alias("component")))
    tree = None
    while True:
        sizes = state.groupBy("component").agg(F.count("*").alias("n"))
        summary = sizes.agg(F.count("*"), F.max(F.struct("n", "component"))["component"]).first()
        if summary[0] <= 1:
            break
        largest = F.lit(summary[1])
        at_a, at_b = (state.select(F.col("id").alias(e), F.col("component").alias(f"_{e}")) for e in ("a", "b"))
        open_edges = edges.join(at_a, "a").join(at_b, "b").filter("_a <> _b")
        known = open_edges.select(F.col("_a").alias("component"), "w", "a", "b")
        turned = open_edges.select(F.col("_b").alias("component"), "w", F.col("b").alias("a"), F.col("a").alias("b"))
        shortest = F.min(F.struct("w", "a", "b")).alias("edge")
        offered = settle(known.unionByName(turned).groupBy("component").agg(shortest).filter(F.col("component") != largest))
        now = placed.join(state, "id")
        bound = F.coalesce(F.col("edge.w"), F.lit(float("inf")))
        visitors = now.filter(F.col("component") != largest).join(offered, "component", "left").withColumn("reach", bound)
        visitors = visitors.filter(F.col("least") < F.col("reach")).drop("edge")
        if len(pivots):
            visitors = asking(visitors, place(F.col("vec"), F.col("reach"), pivots, False)["visits"])
        found = meet(now, visitors, ["_group"], shortest_way_out, f"component {kind}, w double, a {kind}, b {kind}", block, shortest_of_each)
        candidates = offered.select("component", "edge.*").unionByName(found).groupBy("component").agg(shortest)
        chosen = settle(candidates.select(F.least("edge.a", "edge.b").alias("a"), F.greatest("edge.a", "edge.b").alias("b"), "edge.w").distinct())
        tree = chosen if tree is None else tree.unionByName(chosen)
        ways = chosen.join(at_a, "a").join(at_b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        joined = join_parts(ways, f"component {kind}, _new {kind}") if summary[0] <= STRETCH else components(ways).toDF("component", "_new")
        state = settle(state.join(joined, "component", "left").select("id", F.coalesce("_new", "component").alias("component")))
    return tree if tree is not None else edges.limit(0)


def _merge(edges: pd.DataFrame, min_cluster_size: int, first: int) -> tuple[list, list, list, list]:
    """Merge along edges, shortest first, all edges of one length at once.

    `edges` has (w, a, b) and for both ends the state of the node: size, cluster (null below `min_cluster_size`) and, there, the
    points. Gives points (id, cluster, w), clusters (cluster, w, size), merges (cluster, parent, w) and nodes (old, new, size,
    cluster, points). New clusters are numbered from `first`.
    """
    names, state = {}, []
    for end in ("a", "b"):
        for name, size, cluster, points in zip(edges[end], edges[f"{end}_size"], edges[f"{end}_cluster"], edges[f"{end}_points"]):
            if name not in names:
                names[name] = len(state)
                state.append((int(size), None if pd.isna(cluster) else int(cluster), [] if points is None else list(points)))
    above = list(range(len(state)))

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    edges = edges.sort_values("w", kind="stable")
    a, b = ([names[x] for x in edges[end]] for end in ("a", "b"))
    w = edges["w"].to_numpy()
    falls, clusters, merges, at = [], [], [], 0
    while at < len(w):
        stop = at
        while stop < len(w) and w[stop] == w[at]:
            stop += 1
        parts: dict[int, list[int]] = {}  # new root -> the roots that meet in it
        for i in range(at, stop):
            x, y = root(a[i]), root(b[i])
            if x != y:
                if len(parts.get(x, "")) < len(parts.get(y, "")):
                    x, y = y, x
                above[y] = x
                parts.setdefault(x, [x]).extend(parts.pop(y, [y]))
        for head, roots in parts.items():
            old = [state[r] for r in roots]
            size = sum(s[0] for s in old)
            grown = [s for s in old if s[1] is not None]
            loose = [p for s in old for p in s[2]]
            cluster = grown[0][1] if grown else None
            if len(grown) > 1 or (not grown and size >= min_cluster_size):
                cluster, first = first, first + 1
                clusters.append((cluster, w[at], size))
                merges += [(s[1], cluster, w[at], s[0]) for s in grown]
            if cluster is not None:
                falls += [(p, cluster, w[at]) for p in loose]
                loose = []
            state[head] = (size, cluster, loose)
        at = stop
    nodes = [(name, root(i)) for name, i in names.items()]
    back = {i: name for name, i in names.items()}
    nodes = [(name, back[r], *state[r]) for name, r in nodes]
    return falls, clusters, merges, nodes


def condense(tree: DataFrame, min_cluster_size: int = 5, stretch: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """The condensed tree: clusters (cluster, parent, formed, top, size) and points (id, cluster, w).

    `formed` is the distance at which a cluster appears, `top` the one at which it merges with another into its parent; a
    point belongs to the cluster that takes it in at distance `w`. Equal distances count at once, so the result does not
    depend on the order of ties. The last cluster (parent null) holds everything.
    """
    spark, kind = tree.sparkSession, tree.schema["a"].dataType.simpleString()
    left = settle(tree.select("a", "b", "w"))
    count = left.count()
    parts = max(1, -(-count // stretch))
    cuts = left.approxQuantile("w", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    node = f"name {kind}, size bigint, cluster bigint, points array<{kind}>"
    states = spark.createDataFrame([], node)
    schema = f"what string, id {kind}, other {kind}, cluster bigint, parent bigint, w double, size bigint, points array<{kind}>"

    def run(first: int):
        def merge(edges: pd.DataFrame) -> pd.DataFrame:
            falls, clusters, merges, nodes = _merge(edges, min_cluster_size, first)
            rows = [("point", i, None, c, None, w, None, None) for i, c, w in falls]
            rows += [("cluster", None, None, c, None, w, n, None) for c, w, n in clusters]
            rows += [("merge", None, None, c, p, w, n, None) for c, p, w, n in merges]
            rows += [("node", old, new, c, None, None, n, points) for old, new, n, c, points in nodes]
            return pd.DataFrame(rows, columns=["what", "id", "other", "cluster", "parent", "w", "size", "points"], dtype=object)

        return merge

    events = None
    bounds = [float("-inf"), *sorted(set(cuts)), float("inf")]
    for number, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
        edges = left.filter((F.col("w") > low) & (F.col("w") <= high))
        for end in ("a", "b"):
            known = states.select(F.col("name").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("size", "cluster", "points")])
            edges = edges.join(known, end, "left")
            fresh = F.col(f"{end}_size").isNull()
            edges = edges.withColumn(f"{end}_points", F.when(fresh, F.array(end)).otherwise(F.col(f"{end}_points")))
            edges = edges.withColumn(f"{end}_size", F.coalesce(f"{end}_size", F.lit(1).cast("bigint")))
        # One stretch is one task: at most about `stretch` edges, unless more are equally long.
        got = settle(edges.groupBy(F.lit(number).alias("_all")).applyInPandas(run(number << 40), schema))
        events = got if events is None else events.unionByName(got)
        if number == len(bounds) - 2:
            break
        nodes = got.filter("what = 'node'")
        fresh = nodes.filter("id = other").select(F.col("id").alias("name"), "size", "cluster", "points")
        states = settle(states.join(nodes.select(F.col("id").alias("name")), "name", "left_anti").unionByName(fresh))
        for end in ("a", "b"):
            renamed = nodes.select(F.col("id").alias(end), F.col("other").alias("_new"))
            left = left.filter(F.col("w") > low).join(renamed, end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
        left = settle(left)
    made = events.filter("what = 'cluster'").select("cluster", F.col("w").alias("formed"), "size")
    merged = events.filter("what = 'merge'").select("cluster", "parent", F.col("w").alias("top"), F.col("size").alias("grown"))
    clusters = made.join(merged, "cluster", "left").select("cluster", "parent", "formed", "top", F.coalesce("grown", "size").alias("size"))
    return settle(clusters), events.filter("what = 'point'").select("id", "cluster", "w")


def stabilities(clusters: DataFrame, points: DataFrame) -> DataFrame:
    """(cluster, stability): how long points stay, summed: over 1/distance, from where they leave to where the cluster ends."""
    own = points.groupBy("cluster").agg(F.sum(1 / F.col("w")).alias("own"), F.count("*").alias("n"))
    below = clusters.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster")).agg(F.sum("size").alias("inside"))
    rows = clusters.join(own, "cluster", "left").join(below, "cluster", "left").fillna(0, ["own", "n", "inside"])
    end = F.coalesce(1 / F.col("top"), F.lit(0.0))
    return rows.select("cluster", (F.col("own") - F.col("n") * end + F.col("inside") * (1 / F.col("formed") - end)).alias("stability"))


def _climb(clusters: DataFrame, stops: DataFrame) -> DataFrame:
    """(cluster, target): the first of `stops` (cluster) on the way up, itself included. Paths double their length each round."""
    stop = stops.select("cluster", F.lit(True).alias("_stop"))
    rows = clusters.select("cluster", "parent").join(stop, "cluster", "left")
    rows = settle(rows.select("cluster", F.when(F.col("_stop"), F.col("cluster")).otherwise(F.col("parent")).alias("target"), F.col("_stop").isNotNull().alias("done")))
    while rows.filter("NOT done AND target IS NOT NULL").limit(1).count():
        further = rows.select(F.col("cluster").alias("target"), F.col("target").alias("_next"), F.col("done").alias("_done"))
        step = rows.join(further, "target", "left")
        go = ~F.col("done") & F.col("target").isNotNull()
        rows = settle(step.select("cluster", F.when(go, F.col("_next")).otherwise(F.col("target")).alias("target"), F.when(go, F.col("_done")).otherwise(F.col("done")).alias("done")))
    return rows.filter("done").select("cluster", "target")


def _most_stable(clusters: DataFrame, points: DataFrame) -> DataFrame:
    """(cluster): those more stable than what is chosen inside them. One round for each level of the tree, leaves first."""
    rows = settle(clusters.join(stabilities(clusters, points), "cluster").select("cluster", "parent", "stability"))
    done = None
    todo = rows
    while not todo.isEmpty():
        # Clusters with no undecided cluster inside.
        ready = todo.join(todo.select(F.col("parent").alias("cluster")).distinct(), "cluster", "left_anti")
        if done is not None:
            inside = done.groupBy(F.col("parent").alias("cluster")).agg(F.sum("value").alias("_inside"))
            ready = ready.join(inside, "cluster", "left")
        else:
            ready = ready.withColumn("_inside", F.lit(None).cast("double"))
        keep = F.col("parent").isNotNull() & (F.col("_inside").isNull() | (F.col("stability") >= F.col("_inside")))
        decided = ready.select("cluster", "parent", keep.alias("kept"), F.greatest("stability", F.coalesce("_inside", "stability")).alias("value"))
        done = settle(decided if done is None else done.unionByName(decided))
        todo = settle(todo.join(done.select("cluster"), "cluster", "left_anti"))
    kept = done.filter("kept")
    # Of kept clusters inside each other the outermost counts.
    inside = kept.select("cluster", F.col("parent").alias("up")).join(_climb(clusters, kept).select(F.col("cluster").alias("up"), "target"), "up")
    return kept.join(inside.select("cluster"), "cluster", "left_anti").select("cluster")


def choose_clusters(clusters: DataFrame, points: DataFrame, method: str = "leaf", epsilon: float = 0.0) -> DataFrame:
    """(cluster, chosen): every cluster of the tree inside a chosen one (or chosen itself).

    `leaf` takes clusters with none inside, `stable` those that outlast what is inside them. One that merges at `epsilon` or
    nearer gives way to the cluster around it, as long as that is not the last one, which holds everything and is never chosen.
    """
    if method == "leaf":
        first = clusters.join(clusters.select(F.col("parent").alias("cluster")).distinct(), "cluster", "left_anti").filter("parent IS NOT NULL")
    elif method == "stable":
        first = _most_stable(clusters, points)
    else:
        raise ValueError(f"unknown method {method}")
    top = clusters.filter("parent IS NULL").select(F.col("cluster").alias("parent"))
    below = clusters.join(top, "parent", "left_semi").select("cluster")
    stays = clusters.filter(F.col("top") > epsilon).select("cluster").unionByName(below).distinct()
    chosen = first.select("cluster").join(_climb(clusters, stays), "cluster").select(F.col("target").alias("cluster")).distinct()
    return _climb(clusters, settle(chosen)).withColumnRenamed("target", "chosen")


def tree_points(df: DataFrame, id: str, vec: str, min_samples: int = 2, min_cluster_size: int = 5, method: str = "leaf", epsilon: float = 0.75, block: int = BLOCK, near: DataFrame | None = None) -> DataFrame:
    """(id, w, cluster, formed, top, exemplar): the distinct vectors inside chosen clusters, which are numbered from 0 by their smallest id.

    `w` is the distance at which the tree takes a point in, `formed` and `top` those at which the chosen cluster appears and
    merges. Exemplars are the points with which a leaf inside the chosen cluster appears: its densest ones.
    """
    tree = settle(spanning_tree(df, id, vec, min_samples, block, near))
    clusters, points = condense(tree, min_cluster_size)
    chosen = choose_clusters(clusters, points, method, epsilon).join(clusters.select(F.col("cluster").alias("chosen"), "formed", "top"), "chosen")
    inner = clusters.select("cluster", F.col("formed").alias("_born")).join(clusters.select(F.col("parent").alias("cluster")).distinct(), "cluster", "left_anti")
    found = points.join(chosen, "cluster").join(inner, "cluster", "left")
    found = settle(found.select("id", "w", "chosen", "formed", "top", F.coalesce(F.col("w") == F.col("_born"), F.lit(False)).alias("exemplar")))
    firsts = found.groupBy("chosen").agg(F.min("id").alias("first"))
    names = with_position(firsts.withColumn("_all", F.lit(0)), "_all", "first", "number")
    return found.join(names.select("chosen", (F.col("number") - 1).alias("cluster")), "chosen").drop("chosen")


def tree_clusters(
    df: DataFrame,
    id: str,
    vec: str,
    min_samples: int = 2,
    min_cluster_size: int = 5,
    method: str = "leaf",
    epsilon: float = 0.75,
    block: int = BLOCK,
) -> DataFrame:
    """(id, cluster, probability): clusters chosen from the condensed tree, numbered from 0 by their smallest id; -1 is noise.

    `probability` is how dense a point's place is against the densest of its cluster: one over the distance at which the
    cluster takes the point in, at most that of the cluster itself, as a share of the latter; noise has 0. Equal vectors are
    one point of the tree and share its answer; null vectors are noise.
    """
    found = settle(tree_points(df, id, vec, min_samples, min_cluster_size, method, epsilon, block))
    numbered = found.select(F.col("id").alias("rep"), "cluster", (F.col("formed") / F.greatest("w", "formed")).alias("probability"))
    reps = copies_of(df, id, vec, distinct_vectors(df, id, vec))
    rows = reps.join(numbered, "rep").select(id, "cluster", "probability")
    out = df.select(id).join(rows, id, "left")
    return out.select(id, F.coalesce("cluster", F.lit(-1).cast("bigint")).alias("cluster"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
