"""The density hierarchy against a brute-force version that works on the matrix of all distances."""

import numpy as np
import pandas as pd
import pytest
from shortlens.plans import hierarchy as hi


def blobs(seed=3, sizes=(40, 25, 12, 7), noise=30, width=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 6, (len(sizes), width))
    parts = [rng.normal(c, 0.3 + 0.25 * i, (n, width)) for i, (c, n) in enumerate(zip(centres, sizes))]
    return np.concatenate([*parts, rng.uniform(-12, 12, (noise, width))])


def closest_merge(x, min_samples):
    """The distance at which each pair first hangs together, by closing the matrix of mutual reachability."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, min_samples]
    u = np.maximum(np.maximum(d, core[:, None]), core[None])
    np.fill_diagonal(u, 0)
    for k in range(len(x)):
        u = np.minimum(u, np.maximum(u[:, k : k + 1], u[k : k + 1]))
    return u


def sets_of(u, size):
    """Every density cluster there is, as (points, distance at which it forms), from the matrix alone."""
    found = {}
    for w in np.unique(u)[1:]:
        for row in u <= w:
            if row.sum() >= size:
                found.setdefault(frozenset(np.flatnonzero(row).tolist()), w)
    return found


def plain_tree(u, size):
    """Condensed clusters: {cluster: (formed, top, parent, all points)}, where a cluster is named by the set it forms with."""
    sets = sorted(sets_of(u, size).items(), key=lambda s: (s[1], len(s[0])))
    born, clusters = {}, {}  # set -> its condensed cluster
    for points, w in sets:
        inside = [s for s in born if s < points]
        outer = {born[s] for s in inside if not any(s < t for t in inside)}
        if len(outer) == 1:
            born[points] = outer.pop()
            clusters[born[points]][3] = points
        else:
            born[points] = points
            clusters[points] = [w, np.inf, None, points]
            for child in outer:
                clusters[child][1:3] = [w, points]
    return clusters


def plain_choice(u, size, method, epsilon):
    """(label of each point by the smallest point of its cluster, probability)."""
    clusters = plain_tree(u, size)
    taken = np.sort(u, 1)[:, size - 1] if len(u) >= size else np.full(len(u), np.inf)
    home = {}
    for i in range(len(u)):
        holding = [c for c, (formed, top, _, points) in clusters.items() if i in points and formed <= taken[i] < top]
        home[i] = holding[0] if holding else None
    parents = {c[2] for c in clusters.values()}

    def below(c):
        return [d for d in clusters if clusters[d][2] == c]

    def stability(c):
        formed, top, _, points = clusters[c]
        end = 0 if np.isinf(top) else 1 / top
        return sum(1 / taken[i] - end for i in home if home[i] == c) + sum(len(clusters[d][3]) * (1 / formed - end) for d in below(c))

    def best(c):
        parts = [best(d) for d in below(c)]
        value, inner = sum(v for v, _ in parts), [x for _, chosen in parts for x in chosen]
        own = stability(c)
        if clusters[c][2] is not None and (not parts or own >= value):
            return own, [c]
        return value, inner

    root = [c for c in clusters if clusters[c][2] is None]
    if method == "leaf":
        chosen = [c for c in clusters if c not in parents and clusters[c][2] is not None]
    else:
        chosen = best(root[0])[1] if root else []
    final = set()
    for c in chosen:
        while clusters[c][1] <= epsilon and clusters[clusters[c][2]][2] is not None:
            c = clusters[c][2]
        final.add(c)
    label, probability = np.full(len(u), -1), np.zeros(len(u))
    for i, c in home.items():
        while c is not None and c not in final:
            c = clusters[c][2]
        if c is not None:
            label[i], probability[i] = min(clusters[c][3]), clusters[c][0] / max(taken[i], clusters[c][0])
    return label, probability


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, vec array<double>")


def check(spark, x, got, size, method, epsilon, min_samples=2):
    label, probability = plain_choice(closest_merge(x, min_samples), size, method, epsilon)
    order = {first: n for n, first in enumerate(sorted(set(label.tolist()) - {-1}))} | {-1: -1}
    rows = {r["id"]: r for r in got.collect()}
    assert len(rows) == len(x)
    assert [rows[i]["cluster"] for i in range(len(x))] == [order[k] for k in label.tolist()]
    assert np.allclose([rows[i]["probability"] for i in range(len(x))], probability)
    return len(order) - 1


@pytest.mark.parametrize("method, epsilon", [("leaf", 1.5), ("stable", 0.0)])
def test_tree_clusters_equal_brute_force(spark, method, epsilon):
    x = blobs()
    got = hi.tree_clusters(frame(spark, x), "id", "vec", 2, 5, method, epsilon, block=16)
    assert check(spark, x, got, 5, method, epsilon) > 1


def test_spanning_tree_has_the_least_weight_in_many_cells(spark):
    x = blobs(5, sizes=(60, 30, 30), noise=60)
    tree = hi.spanning_tree(frame(spark, x), "id", "vec", 3, block=12).collect()
    u = closest_merge(x, 3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, 3]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    above = list(range(len(x)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    total = 0
    for r in sorted(tree, key=lambda r: r["w"]):
        assert abs(reach[r["a"], r["b"]] - r["w"]) < 1e-9 and abs(u[r["a"], r["b"]] - r["w"]) < 1e-9
        a, b = root(r["a"]), root(r["b"])
        if a != b:
            above[a], total = b, total + r["w"]
    assert len({root(i) for i in range(len(x))}) == 1
    left, inside, least = set(range(1, len(x))), {0}, 0
    while left:
        w, j = min((reach[i, j], j) for i in inside for j in left)
        least, inside = least + w, inside | {j}
        left.remove(j)
    assert abs(total - least) < 1e-6


def test_stretches_give_the_same_tree(spark):
    x = blobs(9)
    tree = hi.spanning_tree(frame(spark, x), "id", "vec", 2).cache()
    answers = []
    for stretch in (1_000, 20):
        clusters, points = hi.condense(tree, 5, stretch)
        sizes = {r["cluster"]: (r["formed"], r["top"], r["size"]) for r in clusters.collect()}
        answers.append((sorted(map(str, sizes.values())), sorted((r["id"], r["w"], str(sizes[r["cluster"]])) for r in points.collect())))
    assert answers[0] == answers[1] and len(answers[0][0]) > 3


def test_equal_distances_copies_and_nulls(spark):
    grid = np.array([[i, j] for i in range(4) for j in range(4)] + [[50 + i, j] for i in range(3) for j in range(3)], float)
    rows = [(f"p{i:02}", r.tolist()) for i, r in enumerate(grid)] + [("copy", grid[0].tolist()), ("none", None)]
    named = {r["id"]: r for r in hi.tree_clusters(spark.createDataFrame(rows, "id string, vec array<double>"), "id", "vec", 2, 5, "leaf", 0.0).collect()}
    assert named["copy"]["cluster"] == named["p00"]["cluster"] != -1 and named["none"]["cluster"] == -1 and len(named) == len(rows)
    label, probability = plain_choice(closest_merge(grid, 2), 5, "leaf", 0.0)
    assert sorted(set(label.tolist())) == [0, 16]
    for i, (k, p) in enumerate(zip(label.tolist(), probability.tolist())):
        assert named[f"p{i:02}"]["cluster"] == (k > 0) and abs(named[f"p{i:02}"]["probability"] - p) < 1e-9


def test_small_tables_are_noise(spark):
    for n in (0, 3):
        rows = hi.tree_clusters(frame(spark, np.eye(4)[:n]), "id", "vec").collect()
        assert [r["cluster"] for r in rows] == [-1] * n and all(r["probability"] == 0 for r in rows)


def test_a_stretch_is_small_enough_for_one_task():
    # About 2 KB an edge in the task that merges it: a fraction of what an executor's Python may hold.
    assert hi.STRETCH * 2_048 <= 600 << 20


def test_the_shortest_way_out_measures_what_is_within_reach(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((60, 6)), rng.standard_normal((300, 6))
    dist = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    reach = np.sort(dist, 1)[:, 3]
    v = pd.DataFrame({"id": np.arange(60), "vec": list(x), "core": 0.1, "component": np.arange(60) % 7, "reach": reach})
    m = pd.DataFrame({"id": np.arange(300) + 60, "vec": list(y), "core": rng.uniform(0, 2, 300), "component": np.arange(300) % 9})
    seen, measured = [], hi.measured
    monkeypatch.setattr(hi, "measured", lambda *of: (seen.append(len(of[2])), measured(*of))[1])
    w = np.maximum(np.maximum(dist, 0.1), m["core"].to_numpy()[None, :])
    w[(v["component"].to_numpy()[:, None] == m["component"].to_numpy()[None, :]) | (w > reach[:, None])] = np.inf
    found = hi.shortest_way_out(m, v).set_index("component")["w"]
    least = {c: w[c::7].min() for c in range(7) if np.isfinite(w[c::7].min())}
    assert found.to_dict() == pytest.approx(least) and 0 < sum(seen) < dist.size / 10
    every = hi.shortest_way_out(m, v.assign(reach=np.inf)).set_index("component")["w"]
    assert len(every) == 7 and all(every[c] <= least[c] + 1e-12 for c in least)
