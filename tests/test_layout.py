"""The neighbour map and the approximate pair join, against all pairs."""

import numpy as np
import pytest
from shortlens.operators import neighbors as nb
from shortlens.plans import embedding as em
from shortlens.plans import layout as lt


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>").repartition(4)


@pytest.fixture(scope="module")
def groups():
    """Twelve groups in as many directions of 24 dimensions: no plane shows them all apart."""
    rng = np.random.default_rng(3)
    centres = np.linalg.qr(rng.standard_normal((24, 24)))[0][:12] * 3
    return np.vstack([rng.normal(c, 0.35, (30, 24)) for c in centres])


def places(rows, n):
    found = {r["id"]: (r["x"], r["y"]) for r in rows.collect()}
    return np.array([found[i] for i in range(n)])


def test_bandwidths_reach_the_perplexity():
    squares = np.sort(np.random.default_rng(1).random((20, 60)), 1) * 5
    squares[3, 40:] = np.inf
    p = lt.bandwidths(squares, 20)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(p > 0, p * np.log(p), 0).sum(1)
    assert np.allclose(p.sum(1), 1) and np.allclose(np.exp(entropy), 20, rtol=1e-3) and (p[3, 40:] == 0).all()
    few = lt.bandwidths(np.array([[0.1, 0.2, np.inf]]), 20)
    assert np.allclose(few, [[0.5, 0.5, 0]], atol=1e-3)


def test_affinities_are_symmetric_and_sum_to_one(spark, groups):
    points = nb.unit(table(spark, groups[::3]))
    p = {(r["a"], r["b"]): r["p"] for r in lt.affinities(points, 10).collect()}
    assert abs(sum(p.values()) - 1) < 1e-9 and all(abs(p[b, a] - v) < 1e-12 for (a, b), v in p.items())


@pytest.mark.parametrize("block", [1024, 120])
def test_map_keeps_neighbours(spark, groups, block):
    df = table(spark, groups)
    unit = groups / np.linalg.norm(groups, axis=1)[:, None]
    flat = places(em.project_2d(df, "vec"), len(groups))
    shown = places(lt.neighbor_map(df, "id", "vec", block=block), len(groups))
    assert lt.trustworthiness(unit, shown, 10) > max(0.9, lt.trustworthiness(unit, flat, 10) + 0.1)
    gap = np.sqrt(((shown[:, None] - shown[None]) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    assert (np.arange(len(groups)) // 30 == gap.argmin(1) // 30).mean() > 0.97


def test_edges_of_the_map_stay_where_they_are(spark, groups, monkeypatch):
    one_round = lt._round

    def watched(state, edges, *args):
        out = one_round(state, edges, *args)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
        # A point is sent once to each other share that asks for it, not once for each edge.
        asked = state.selectExpr("id", "share", "explode(asked) AS other").collect()
        assert len(asked) == len(set(asked)) and all(r["share"] != r["other"] for r in asked)
        return out

    monkeypatch.setattr(lt, "_round", watched)
    monkeypatch.setattr(lt, "LEAST_SHARES", 3)
    out = lt.neighbor_map(table(spark, groups), "id", "vec", 8, steps=50, block=40)
    assert out.filter("x IS NOT NULL").count() == len(groups)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("shortlens_dealt")]


def test_map_is_the_same_on_every_run(spark, groups):
    one, two = (places(lt.neighbor_map(table(spark, groups[:150]), "id", "vec", 8, steps=100, block=60), 150) for _ in range(2))
    assert np.abs(one - two).max() <= 1e-6 * np.abs(one).max()


def test_map_of_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0])], "id long, vec array<double>")
    rows = {r["id"]: (r["x"], r["y"]) for r in lt.neighbor_map(df, "id", "vec", steps=20).collect()}
    assert rows[1] == rows[2] != rows[5] and rows.get(3, (None, None)) == (None, None) and 4 not in rows
    assert [tuple(r) for r in lt.neighbor_map(df.filter("id = 1"), "id", "vec").collect()] == [(1, 0.0, 0.0)]
    assert lt.neighbor_map(df.limit(0), "id", "vec").count() == 0


@pytest.mark.parametrize("limit", [0.5, 0.85])
def test_approximate_pairs(spark, limit):
    """Vectors without structure, some with near copies; a clump holds many of them."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 32))
    x = np.vstack([base, base[:100] + rng.normal(0, 0.3, (100, 32)), base[0] + rng.normal(0, 0.05, (80, 32)), base[:5]])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    sim = u[:480] @ u[:480].T
    truth = {(i, j) for i, j in zip(*np.nonzero(sim >= limit)) if i < j}
    pairs, found = nb.similar_pairs_approx(table(spark, x), "id", "vec", limit, block=32)
    rows = pairs.collect()
    got = {(r["id1"], r["id2"]) for r in rows}
    assert len(rows) == len(got) and got <= truth and len(got) >= 0.95 * len(truth)
    assert all(abs(r["similarity"] - sim[r["id1"], r["id2"]]) < 1e-9 for r in rows)
    assert found.recall >= 0.95 and found.sampled > 0


def test_approximate_pairs_within_a_category_and_odd_tables(spark):
    df = table(spark, [[1, 0], [1, 0.01], [0, 0], [0.99, 0]]).selectExpr("id", "vec", "cast(id = 3 as int) as kind")
    rows = nb.pairs(df, "id", "vec", "cosine", 0.9, within="kind", approx=True).collect()
    assert [(r["kind"], r["id1"], r["id2"]) for r in rows] == [(0, 0, 1)]
    assert nb.pairs(df.limit(0), "id", "vec", "cosine", 0.9, approx=True).count() == 0
    with pytest.raises(ValueError, match="cosine"):
        nb.pairs(df, "id", "vec", "euclidean", 0.9, approx=True)


def test_edges_come_to_a_round_as_one_row_for_each_point(spark, groups, monkeypatch):
    one_round, rows = lt._round, []

    def watched(state, edges, *args):
        if not rows:
            rows.extend(edges.selectExpr("a", "size(ends) AS n", "size(p) AS m").collect())
        return one_round(state, edges, *args)

    monkeypatch.setattr(lt, "_round", watched)
    places(lt.neighbor_map(table(spark, groups[:150]), "id", "vec", 8, steps=30, block=60), 150)
    assert len(rows) == len({r["a"] for r in rows}) == 150
    assert all(r["n"] == r["m"] >= 24 for r in rows)
