import itertools

import duckdb
import numpy as np
import pandas as pd
import pytest
from oracle import compare
from pyspark import TaskContext
from pyspark.sql import functions as F
from shortlens.catalog import QUERIES, SQL
from shortlens.functions import vectors as vec
from shortlens.operators import neighbors as nb
from shortlens.plans import clusters as cl
from shortlens.plans import embedding as em
from shortlens.plans import quality as ql
from shortlens.plans.components import components


def table(spark, x, extra=None):
    rows = [(i, [float(v) for v in row], *( [extra[i]] if extra is not None else [])) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>" + (", cluster int" if extra is not None else "")).repartition(4)


@pytest.fixture(scope="module")
def cloud():
    """Three loose groups, a dense clump holding a third of the points, and far single points."""
    rng = np.random.default_rng(7)
    groups = [rng.normal(c, 0.4, (40, 4)) for c in ([0, 0, 0, 3], [4, 0, 0, 3], [0, 4, 1, 3])]
    clump = rng.normal([9, 9, 9, 9], 0.01, (70, 4))
    return np.vstack([*groups, clump, rng.uniform(-20, 20, (10, 4))])


def brute(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))


def chains(near):
    label = np.arange(len(near))
    for _ in range(len(near)):
        new = np.where(near, label[None, :], len(near)).min(1)
        new = np.minimum(new, label)
        if (new == label).all():
            break
        label = new
    return label


def test_pairs_across_cells(spark, cloud):
    dist = brute(cloud)
    out = nb.near_pairs(table(spark, cloud), "id", "vec", 0.9, block=16).collect()
    expected = {(i, j) for i, j in itertools.combinations(range(len(cloud)), 2) if dist[i, j] <= 0.9}
    assert {(r.id1, r.id2) for r in out} == expected and len(out) == len(expected)
    assert all(abs(r.distance - dist[r.id1, r.id2]) < 1e-9 for r in out)


def test_cosine_pairs_within_category_across_cells(spark, cloud):
    kinds = [i % 2 for i in range(len(cloud))]
    u = cloud / np.linalg.norm(cloud, axis=1)[:, None]
    sim = u @ u.T
    out = nb.similar_pairs(table(spark, cloud, kinds), "id", "vec", 0.97, within="cluster", block=16).collect()
    pairs = itertools.combinations(range(len(cloud)), 2)
    expected = {(i, j) for i, j in pairs if sim[i, j] >= 0.97 and kinds[i] == kinds[j]}
    assert {(r.id1, r.id2) for r in out} == expected and len(out) == len(expected)


def test_copies_are_one_point(spark):
    df = table(spark, [[1, 0]] * 50 + [[1, 0.01], [0, 1], [0, 0]])
    out = nb.similar_pairs(df, "id", "vec", 0.9).collect()
    assert [(r.id1, r.id2) for r in out] == [(0, 50)]
    reps = nb.distinct_vectors(df, "id", "vec")
    assert nb.copies_of(df, "id", "vec", reps).filter("rep = 0").count() == 50
    found = {r.id: r.cluster for r in cl.similarity_clusters(df, "id", "vec", 0.9, 0.5).collect()}
    assert {found[i] for i in range(51)} == {0} and found[51] == found[52] == -1


def test_nearest_across_cells(spark, cloud):
    dist = brute(cloud)
    np.fill_diagonal(dist, np.inf)
    out = nb.knn(table(spark, cloud), "id", "vec", 3, block=16).collect()
    got = {(r.id, r["rank"]): (r.neighbor, r.distance) for r in out}
    assert len(got) == 3 * len(cloud)
    for i in range(len(cloud)):
        order = np.lexsort((np.arange(len(cloud)), dist[i]))[:3]
        for k, j in enumerate(order, 1):
            assert got[i, k][0] == j and abs(got[i, k][1] - dist[i, j]) < 1e-9


def test_core_points_and_links_across_cells(spark, cloud):
    dist, eps = brute(cloud), 0.8
    points = nb.distinct_vectors(table(spark, cloud), "id", "vec")
    cores = {r.id for r in nb.core_points(points, eps, 4, block=16).collect()}
    assert cores == {i for i in range(len(cloud)) if (dist[i] <= eps).sum() - 1 >= 4}
    edges = nb.links(points, eps, "euclidean", block=16)
    found = {r.id: r.component for r in components(edges).collect()}
    label = chains(dist <= eps)
    assert all(found.get(i, i) == label[i] for i in range(len(cloud)))
    assert edges.count() < 16 * len(cloud)


def test_density_clusters(spark, cloud):
    dist, eps = brute(cloud), 0.8
    core = (dist <= eps).sum(1) - 1 >= 2
    near = (dist <= eps) & core[:, None] & core[None, :]
    label = chains(near)
    size = np.bincount(label[core], minlength=len(cloud))
    first = [int(label[i]) if core[i] and size[label[i]] >= 5 else -1 for i in range(len(cloud))]
    numbers = {c: n for n, c in enumerate(sorted(set(first) - {-1}))}
    expected = [numbers.get(c, -1) for c in first]
    found = {r.id: r.cluster for r in cl.density_clusters(table(spark, cloud), "id", "vec", eps, 2, 5).collect()}
    assert [found[i] for i in range(len(cloud))] == expected
    named = table(spark, cloud).withColumn("id", F.format_string("url_%05d", "id"))
    found = {r.id: r.cluster for r in cl.density_clusters(named, "id", "vec", eps, 2, 5).collect()}
    assert [found[f"url_{i:05d}"] for i in range(len(cloud))] == expected


def test_near_equal_rows_are_measured_again(monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(40, 5)) * 1e3
    b = np.concatenate([a[:20] + 1e-7, a[20:]])
    expected = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    for held in (1, 17, 1 << 20):
        monkeypatch.setattr(nb, "REMEASURED", held)
        assert np.allclose(nb.distances(a, b), expected, rtol=1e-6, atol=0)


def test_relaxed_similarity_keeps_earlier_clusters(spark):
    x = [[1, 0], [1, 0.05], [0, 1], [0.4, 1]]
    strict = {r.id: r.cluster for r in cl.similarity_clusters(table(spark, x), "id", "vec", 0.99, 0.9).collect()}
    relaxed = {r.id: r.cluster for r in cl.similarity_clusters(table(spark, x), "id", "vec", 0.99, 0.9, (0.04, 0.91)).collect()}
    assert strict == {0: 0, 1: 0, 2: -1, 3: -1} and relaxed == {0: 0, 1: 0, 2: 1, 3: 1}


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(0, 300)]
    hub = [(1000, 1001 + i) for i in range(500)]
    out = {r.id: r.component for r in components(spark.createDataFrame(path + hub, "a long, b long")).collect()}
    assert {out[i] for i in range(301)} == {0} and {out[1000 + i] for i in range(501)} == {1000}
    assert len(out) == 802
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_zero_and_empty_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(vec.cosine(F.col("a"), F.col("b")), vec.l2_normalize(F.col("a")), vec.argmax(F.array().cast("array<double>"))).first()
    assert tuple(row) == (None, [0.0, 0.0], None)


def test_nearest_cluster_when_centroids_coincide(spark):
    cents = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [5.0, 0.0])], "cluster int, centroid array<double>")
    out = {r.cluster: (r.neighbor, r.distance) for r in nb.nearest_cluster(cents).collect()}
    assert out == {0: (1, 0.0), 1: (0, 0.0), 2: (0, 5.0)}


def soft_expected(x, centers):
    d = np.sqrt(((x[:, None, :] - centers[None]) ** 2).sum(2))
    return d.argmin(1), np.where(d.min(1) == 0, 1.0, (1 / np.maximum(d, 1e-300)).max(1) / (1 / np.maximum(d, 1e-300)).sum(1))


@pytest.mark.parametrize("carried", [2048, 2])
def test_soft_clusters_both_ways(spark, cloud, monkeypatch, carried):
    monkeypatch.setattr(cl, "CARRIED_CENTROIDS", carried)
    centers = cloud[[0, 50, 100, 130]]
    cents = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)], "cluster int, centroid array<double>")
    out = {r.id: (r.soft_cluster, r.soft_probability) for r in cl.soft_clusters(table(spark, cloud), cents, "id", "vec").collect()}
    names, probs = soft_expected(cloud, centers)
    assert all(out[i][0] == names[i] and abs(out[i][1] - probs[i]) < 1e-9 for i in range(len(cloud)))


def silhouette_of(dist, label):
    scores = []
    for i in range(len(label)):
        own = (label == label[i]) & (np.arange(len(label)) != i)
        if not own.any():
            scores.append(0.0)
            continue
        a = dist[i, own].mean()
        b = min(dist[i, label == c].mean() for c in set(label) if c != label[i])
        scores.append((b - a) / max(a, b))
    return np.mean(scores)


@pytest.mark.parametrize("few", [True, False])
def test_silhouette_both_ways(spark, cloud, monkeypatch, few):
    label = np.array([i // 40 for i in range(120)] + [3] * 70 + [4] * 9 + [5])
    if not few:
        monkeypatch.setattr(ql, "_bounds", lambda stats: None)
    df = table(spark, cloud, [int(c) for c in label])
    assert abs(ql.silhouette(df, "id", "vec").first()[0] - silhouette_of(brute(cloud), label)) < 1e-9
    u = cloud / np.linalg.norm(cloud, axis=1)[:, None]
    score = ql.silhouette(df, "id", "vec", metric="cosine").first()[0]
    assert abs(score - silhouette_of(1 - u @ u.T, label)) < 1e-9


def validity_of(x, label, k):
    dist = brute(x)
    off = dist + np.where(np.eye(len(x)) == 1, np.inf, 0)
    core = np.sort(off, axis=1)[:, k - 1]
    reach = np.maximum(np.maximum(core[:, None], core[None, :]), dist)
    total = 0.0
    for c in set(label) - {-1}:
        inside = np.flatnonzero(label == c)
        other = np.flatnonzero((label != c) & (label != -1))
        joined, waiting, longest = [inside[0]], set(inside[1:]), 0.0
        while waiting:
            step, nxt = min((reach[i, j], j) for i in joined for j in waiting)
            longest = max(longest, step)
            joined.append(nxt)
            waiting.remove(nxt)
        apart = reach[np.ix_(inside, other)].min()
        total += len(inside) / len(x) * (apart - longest) / max(apart, longest)
    return total


@pytest.mark.parametrize("block", [1024, 16])
def test_density_validity_by_hand(spark, cloud, monkeypatch, block):
    label = np.array([i // 40 for i in range(120)] + [3] * 70 + [-1] * 10)
    monkeypatch.setattr(ql, "BLOCK", block)
    score = ql.density_validity(table(spark, cloud, [int(c) for c in label]), "id", "vec").first()[0]
    assert abs(score - validity_of(cloud, label, 2)) < 1e-9


def test_spanning_forest_is_lightest(spark):
    edges = [(0, 1, 4.0), (1, 2, 1.0), (0, 2, 2.0), (2, 3, 7.0), (1, 3, 3.0), (8, 9, 5.0)]
    out = ql.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double")).collect()
    assert sorted(tuple(r) for r in out) == [(0, 2, 2.0), (1, 2, 1.0), (1, 3, 3.0), (8, 9, 5.0)]


def test_noise_counts_unless_dropped(spark, cloud):
    label = [i // 40 for i in range(120)] + [3] * 70 + [-1] * 10
    df = table(spark, cloud, label)
    for score in (ql.silhouette, ql.calinski_harabasz, ql.davies_bouldin):
        with_noise, without = score(df, "id", "vec").first()[0], score(df, "id", "vec", drop_noise=True).first()[0]
        assert with_noise != without


def test_membership(spark, cloud):
    df = table(spark, cloud)
    found = cl.density_clusters(df, "id", "vec", 0.8, 2, 5)
    out = cl.membership(df, found, "id", "vec", 2).collect()
    assert all((r.probability == 0) == (r.cluster == -1) and 0 <= r.probability <= 1 for r in out) and len(out) == len(cloud)
    assert {r.cluster for r in out if r.probability == 1} == {r.cluster for r in out} - {-1}


def test_pca_keeps_most_variance_first(spark, cloud):
    out = np.array([r.p for r in em.pca(table(spark, cloud), "vec", 3, "p").collect()])
    variance = out.var(0)
    values = np.sort(np.linalg.eigvalsh(np.cov(cloud.T, bias=True)))[::-1][:3]
    assert (np.diff(variance) <= 0).all() and np.allclose(variance, values, rtol=1e-6)
    flat = em.project_2d(table(spark, cloud), "vec")
    assert set(flat.columns) == {"id", "vec", "x", "y"}


def test_a_row_travels_once_to_a_group_of_cells_and_meets_all_the_same(spark):
    x = np.random.default_rng(5).standard_normal((640, 8))
    points = nb.distinct_vectors(table(spark, x), "id", "vec").select("id", "vec").cache()
    placed, pivots = nb.cover(points, 3.0, False, block=16)
    assert len(pivots) > 2 * nb.LEAST_GROUPS
    # With a reach that leaves little out every row visited nearly every cell.
    assert nb.visitors_of(placed).count() <= len(x) * nb.LEAST_GROUPS
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    found = nb.close_pairs(points, 3.0, "euclidean", block=16).collect()
    assert {(r["id1"], r["id2"]) for r in found} == {(i, j) for i, j in zip(*np.nonzero(apart <= 3.0)) if i < j}
    assert len(found) == len({(r["id1"], r["id2"]) for r in found})
    near = {(r["id"], r["rank"]): r["neighbor"] for r in nb.nearest(points, 2, block=16).collect()}
    order = apart.argsort(1, kind="stable")
    assert near == {(i, k + 1): order[i, k] for i in range(len(x)) for k in range(2)}


def test_block_pairs_of_a_task_give_one_merged_answer(spark):
    x = np.random.default_rng(6).standard_normal((200, 4))
    points = nb.distinct_vectors(table(spark, x), "id", "vec").select("id", "vec").withColumn("_all", F.lit(0)).cache()

    def kernel(m, v):
        return pd.DataFrame({"id": v["id"], "n": len(m)})

    def added(found):
        return found.groupby("id", as_index=False).sum()

    found = nb.meet(points, points, ["_all"], kernel, "id bigint, n bigint", 16, added).collect()
    assert [r["n"] for r in found] == [200] * 200 and len({r["id"] for r in found}) == 200


def test_copies_of_a_row_do_not_grow_with_the_table(spark):
    cells = {n: nb.cells_a_group(np.empty((n, 64))) for n in (6, 51, 301)}
    assert all(-(-n // per) <= 5 for n, per in cells.items()) and max(cells.values()) < 63
    assert nb.cells_a_group(np.empty((301, 1024))) == 16  # wide vectors: less rows at a time
    x = np.random.default_rng(9).standard_normal((1280, 8))
    copies = []
    # At this reach no point is apart from the first pivot; at the other there is a cell for each block.
    for n, reach in ((320, 100.0), (1280, 100.0), (1280, 3.0)):
        points = nb.distinct_vectors(table(spark, x[:n]), "id", "vec").select("id", "vec").cache()
        placed, _ = nb.cover(points, reach, False, block=16)
        # Every block pair of a task names its members and visitors; those a task holds are the copies sent to it.
        where = "m bigint, v bigint, task string"

        def pairs(m, v):
            task = f"{TaskContext.get().partitionId()}-{m['_group'].iloc[0]}-{v['_group'].iloc[0]}"
            return pd.DataFrame([(i, j, task) for i in m["id"] for j in v["id"]], columns=["m", "v", "task"])

        met = nb.meet(nb.members_of(placed), nb.visitors_of(placed), ["_group"], pairs, where, 16).cache()
        assert reach < 100 or met.count() == n * n
        copies.append((met.select("m", "task").distinct().count() + met.select("v", "task").distinct().count()) / n)
    assert max(copies) <= 2 * nb.LEAST_GROUPS + 1 and copies[1] <= 1.2 * copies[0]


def test_best_match_reads_its_pairs_once_and_keeps_the_larger_key(spark):
    rows = [(1, 2, 0.5), (1, 3, 0.5), (2, 3, 0.9), (4, 5, None), (6, 7, float("nan")), (6, 8, 0.3), (9, 10, -0.1)]
    pairs = spark.createDataFrame(rows, "id1 long, id2 long, similarity double").repartition(3)
    expected = {1: (3, 0.5), 2: (3, 0.9), 3: (2, 0.9), 4: (5, None), 5: (4, None), 6: (7, "nan"), 7: (6, "nan"), 8: (6, 0.3), 9: (10, -0.1), 10: (9, -0.1)}

    def found(out):
        return {r["id"]: (r["match"], "nan" if r["similarity"] is not None and np.isnan(r["similarity"]) else r["similarity"]) for r in out.collect()}

    out = nb.best_match(pairs)
    assert found(out) == expected
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    named = pairs.select(F.format_string("p%02d", "id1").alias("id1"), F.format_string("p%02d", "id2").alias("id2"), "similarity")
    assert found(nb.best_match(named)) == {f"p{i:02}": (f"p{m:02}", v) for i, (m, v) in expected.items()}
    assert nb.best_match(pairs.limit(0)).count() == 0


def test_lightest_forest_of_block_pairs():
    rng = np.random.default_rng(7)
    w = rng.random((30, 30))
    w = np.minimum(w, w.T)
    ids = np.array([f"p{i:02}" for i in range(30)])

    def weight(a, b, w):
        tree, total = {i: i for i in ids}, 0.0
        for k in np.argsort(w, kind="stable"):
            one, two = a[k], b[k]
            while tree[one] != one:
                one = tree[one]
            while tree[two] != two:
                two = tree[two]
            if one != two:
                tree[one] = two
                total += w[k]
        return total

    i, j = np.nonzero(~np.eye(30, dtype=bool))
    least = weight(ids[i], ids[j], w[i, j])
    parts = [(r, c) for r in (slice(0, 12), slice(12, 30)) for c in (slice(0, 20), slice(20, 30))]
    found = pd.concat(ql._light_tree(w[r, c], ids[r], ids[c]) for r, c in parts)
    merged = ql._lighter(found.assign(cluster=1))
    assert len(merged) == 29 and np.isclose(merged["w"].sum(), least)
    assert np.isclose(ql._light_tree(w, ids, ids)["w"].sum(), least)


def test_approximate_pairs_in_many_tables_do_not_copy_rows_for_each(spark):
    x = np.random.default_rng(8).standard_normal((150, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    points = nb.distinct_vectors(table(spark, x), "id", "vec").select("id", "vec").cache()
    found = nb.Tables(3, 40, 6, 1)
    out = nb.approx_pairs(points, 0.4, found, block=16)
    codes = found.codes(x, found.planes())
    wanted = {(i, j) for i in range(150) for j in range(i + 1, 150) if x[i] @ x[j] >= 0.4 and (codes[i] == codes[j]).any()}
    rows = out.collect()
    assert len(rows) == len(wanted) and {(r["id1"], r["id2"]) for r in rows} == wanted
    assert "bucket" not in out._jdf.queryExecution().toString()


def with_copies():
    """(ids, vectors): groups, two vectors that many ids share, a row that comes twice, and an id with two vectors."""
    rng = np.random.default_rng(17)
    x = np.vstack([rng.normal(c, 0.3, (25, 4)) for c in ([0, 0, 0, 3], [3, 0, 0, 3])])
    x = np.vstack([x, np.repeat(x[:2], 20, 0), x[5:6], x[30:31]])
    return [*range(90), 5, 6], x


@pytest.mark.parametrize("metric, limit", [("cosine", 0.995), ("euclidean", 0.4)])
@pytest.mark.parametrize("within", [None, "cluster"])
def test_pairs_of_all_rows_with_copies(spark, metric, limit, within):
    ids, x = with_copies()
    kinds = [i % 2 for i in ids]
    rows = [(i, [float(f) for f in row], k) for i, row, k in zip(ids, x, kinds)]
    df = spark.createDataFrame([*rows, (None, rows[0][1], 0), (200, None, 0)], "id long, vec array<double>, cluster int").repartition(4)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    close = (u @ u.T >= limit) if metric == "cosine" else (brute(x) <= limit)
    some = [(a, b) for a, b in itertools.permutations(range(len(ids)), 2) if ids[a] < ids[b] and close[a, b]]
    expected = sorted((ids[a], ids[b]) for a, b in some if not within or kinds[a] == kinds[b])
    out = nb.pairs(df, "id", "vec", metric, limit, within)
    assert sorted((r["id1"], r["id2"]) for r in out.collect()) == expected
    form = nb.similar_pairs if metric == "cosine" else nb.near_pairs
    out = form(df, "id", "vec", limit, within, block=16, copies=True)
    assert sorted((r["id1"], r["id2"]) for r in out.collect()) == expected
    named = form(df.withColumn("id", F.format_string("p%03d", "id")).filter("id <> 'pnull'"), "id", "vec", limit, within, block=16, copies=True)
    assert sorted((int(r["id1"][1:]), int(r["id2"][1:])) for r in named.collect()) == expected


@pytest.mark.parametrize("block", [16, 2048])
def test_nearest_of_every_id_with_copies(spark, block):
    ids, x = with_copies()
    x = x[:90]
    dist = brute(x)
    np.fill_diagonal(dist, np.inf)
    found = {(r["id"], r["rank"]): (r["neighbor"], r["distance"]) for r in nb.knn(table(spark, x), "id", "vec", 3, block=block).collect()}
    assert len(found) == 3 * len(x)
    for i in range(len(x)):
        for k, j in enumerate(np.lexsort((np.arange(len(x)), dist[i]))[:3], 1):
            assert found[i, k][0] == j and abs(found[i, k][1] - dist[i, j]) < 1e-9
    one = nb.knn(table(spark, [[1, 2]] * 3), "id", "vec", 1, block=block).collect()
    assert sorted((r["id"], r["neighbor"], r["distance"]) for r in one) == [(0, 1, 0.0), (1, 0, 0.0), (2, 0, 0.0)]


@pytest.mark.parametrize("name", ["c14_similar_pairs", "c14_near_pairs", "c6_pairs_within", "e5_knn", "e6_best_match", "g2_symmetrize"])
def test_queries_give_the_pairs_of_copies(spark, tmp_path, name):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 8))
    x = np.vstack([x, np.repeat(x[:3], 4, 0)]) / 8
    rows = [(i, [float(f) for f in row], i % 3) for i, row in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert compare(QUERIES[name](spark, str(tmp_path)), con, SQL[name]) == ""


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e30])
def test_likely_pairs_leave_nothing_out(scale):
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((200, 24)), rng.standard_normal((300, 24))
    y[:20] = x[:20] + rng.normal(0, 1e-9, (20, 24))
    y[20:40] = x[20:40]
    dist = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    reach = np.sort(dist, 1)[:, 5]
    reach[:5] = 0
    reach[20] = 0
    i, j = nb.likely(x * scale, y * scale, reach * scale)
    wanted = set(zip(*np.nonzero(dist <= reach[:, None])))
    assert wanted <= set(zip(i, j)) and len(i) < 2 * len(wanted)
    assert np.allclose(nb.measured(x * scale, y * scale, i, j), dist[i, j] * scale)
    assert nb.likely(x, y, np.full(200, np.inf)) is None
    assert nb.likely(x * np.nan, y, reach) is None


@pytest.mark.parametrize("block", [7, 16, 90])
def test_nearest_of_a_task_hold_k_of_each_visitor_and_measure_few(block, monkeypatch):
    x = np.vstack([with_copies()[1][:90], np.random.default_rng(2).normal(0, 3, (400, 4))])
    rows = pd.DataFrame({"id": [f"p{i:03}" for i in range(len(x))], "vec": list(x)}).sample(frac=1, random_state=1, ignore_index=True)
    dist = brute(x)
    np.fill_diagonal(dist, np.inf)
    seen, measured = [], nb.measured
    monkeypatch.setattr(nb, "measured", lambda x, y, i, j: (seen.append(len(i)), measured(x, y, i, j))[1])
    task = nb._Nearest(rows.copy(), rows.copy().assign(_reach=[np.sort(dist[int(i[1:])])[2] for i in rows["id"]]), 3)
    v = rows.assign(_code=pd.factorize(rows["id"], sort=True)[0])
    for b in nb._blocks(v, block):
        for a in nb._blocks(v, block):
            task.add(a, b)
    out = pd.concat(task.parts()).sort_values(["id", "distance", "neighbor"])
    assert task.far.shape == (len(x), 3) and len(out) == 3 * len(x)
    for i in range(len(x)):
        wanted = np.lexsort((np.arange(len(x)), dist[i]))[:3]
        assert out[out["id"] == f"p{i:03}"]["neighbor"].tolist() == [f"p{j:03}" for j in wanted]
    assert sum(seen) < len(x) ** 2 / 10


@pytest.mark.parametrize("metric, limit", [("euclidean", 0.9), ("cosine", 0.9)])
def test_only_points_apart_from_the_largest_part_look_around(spark, metric, limit, monkeypatch):
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(0, 1, (500, 3)), rng.normal([30, 0, 0], 0.3, (40, 3)), rng.uniform(-60, 60, (20, 3))])
    points = nb.distinct_vectors(table(spark, x), "id", "vec").select("id", "vec").cache()
    monkeypatch.setattr(nb, "FIRST_OF", 6)
    asked, meet = [], nb.meet
    monkeypatch.setattr(nb, "meet", lambda m, v, on, *rest, **more: (on == ["_group"] and asked.append(v.select("id").distinct().count()), meet(m, v, on, *rest, **more))[1])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    close = u @ u.T >= limit if metric == "cosine" else brute(x) <= limit
    label = chains(close)
    found = {r.id: r.component for r in components(nb.links(points, limit, metric, block=16)).collect()}
    assert all(found.get(i, i) == label[i] for i in range(len(x)))
    assert sum(asked) < len(x) / 2
    if metric == "euclidean":
        asked.clear()
        cores = {r.id for r in nb.core_points(points, limit, 2, block=16).collect()}
        assert cores == {i for i in range(len(x)) if close[i].sum() - 1 >= 2}
        assert sum(asked) < len(x) / 2


def test_longest_edges_of_clusters_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ql, "BLOCK", 16)
    monkeypatch.setattr(nb, "FIRST_OF", 6)
    rng = np.random.default_rng(13)
    # One cluster hangs together, one has two parts and points far away, one is of a block.
    x = np.vstack([rng.normal(0, 1, (120, 3)), rng.normal([12, 0, 0], 0.5, (60, 3)), rng.normal([20, 3, 0], 0.5, (50, 3)), rng.uniform(-40, 40, (6, 3)), rng.normal([0, 9, 0], 1, (10, 3))])
    kinds = [0] * 120 + [1] * 116 + [2] * 10
    dist = brute(x)
    core = np.sort(dist, 1)[:, 2]
    w = np.maximum(np.maximum(dist, core[:, None]), core[None, :])

    def longest(some):
        tree, rest, most = [some[0]], list(some[1:]), 0.0
        while rest:
            step = w[np.ix_(tree, rest)].min(0)
            most = max(most, step.min())
            tree.append(rest.pop(int(step.argmin())))
        return most

    rows = [(i, [float(f) for f in x[i]], kinds[i], float(core[i])) for i in range(len(x))]
    points = spark.createDataFrame(rows, "id long, vec array<double>, cluster int, core double").cache()
    asked, meet = [], ql.meet
    monkeypatch.setattr(ql, "meet", lambda m, v, on, *rest: (on == ["cluster", "_group"] and asked.append(v.filter("cluster = 0").count()), meet(m, v, on, *rest))[1])
    sizes = points.groupBy("cluster").agg(F.count("*").alias("members"))
    found = {r["cluster"]: r["loose"] for r in ql._longest_edges(points, sizes, "a long, b long, w double, cluster int").collect()}
    expected = {k: longest([i for i in range(len(x)) if kinds[i] == k]) for k in range(3)}
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-9 for k in found)
    # Of a cluster that hangs together few points look beyond their cells.
    assert sum(asked) < 60
