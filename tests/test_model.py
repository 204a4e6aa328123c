"""The stored density model: assignment and exemplar membership against brute force, versions, odd rows."""

import numpy as np
import pytest
from shortlens.operators import neighbors as nb
from shortlens.plans import hierarchy as hi
from shortlens.plans import model as dm

from test_hierarchy import blobs, frame


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    x = blobs(4)
    path = str(tmp_path_factory.mktemp("models") / "density")
    dm.fit_model(frame(spark, x), "id", "vec", path, epsilon=0.5, block=16)
    return x, path


def new_points(x):
    rng = np.random.default_rng(1)
    return np.concatenate([x[::4] + rng.normal(0, 0.3, x[::4].shape), rng.uniform(-14, 14, (30, x.shape[1])), x[:5]])


def stored(spark, path):
    rows = {r["id"]: r for r in dm.load_model(spark, path).points.collect()}
    return [rows[i] for i in range(len(rows))]


def test_assignment_equals_brute_force(spark, fitted):
    x, path = fitted
    model, rows, y = dm.load_model(spark, path), stored(spark, path), new_points(x)
    assert len(model.pivots) > 2 and model.min_samples == 2
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, 2]
    assert np.allclose(core, [r["core"] for r in rows])
    got = {r["id"]: r for r in dm.assign(model, frame(spark, y), "id", "vec", block=16).collect()}
    labels = set()
    for i, q in enumerate(y):
        dist = np.sqrt(((x - q) ** 2).sum(1))
        reach = np.maximum(np.maximum(dist, core), np.sort(dist)[1])
        p = int(reach.argmin())
        at = rows[p]["w"] and max(reach[p], rows[p]["w"])
        if dist.min() == 0:
            p = int(dist.argmin())
            at = rows[p]["w"]
        cluster, probability = -1, 0.0
        if rows[p]["cluster"] is not None and at < rows[p]["top"]:
            cluster, probability = rows[p]["cluster"], rows[p]["formed"] / max(at, rows[p]["formed"])
        assert got[i]["cluster"] == cluster and abs(got[i]["probability"] - probability) < 1e-9
        labels.add(cluster)
    assert len(got) == len(y) and len(labels) >= 4 and -1 in labels


def test_membership_equals_brute_force(spark, fitted):
    x, path = fitted
    model, rows, y = dm.load_model(spark, path), stored(spark, path), new_points(x)
    got = {r["id"]: r for r in dm.exemplar_membership(model, frame(spark, y), "id", "vec", block=16).collect()}
    marks = [r for r in rows if r["exemplar"]]
    names = sorted({r["cluster"] for r in marks})
    assert len(names) >= 3 and len(marks) < len(x) / 2
    for i, q in enumerate(y):
        dist = np.sqrt(((x - q) ** 2).sum(1))
        core = rows[int(dist.argmin())]["core"] if dist.min() == 0 else np.sort(dist)[1]
        pull, strength = [], []
        for name in names:
            near = [(np.sqrt(((np.array(r["vec"]) - q) ** 2).sum()), r["core"], r["formed"]) for r in marks if r["cluster"] == name]
            pull.append(1 / max(min(n[0] for n in near), dm.LEAST_DISTANCE))
            strength.append(near[0][2] / max(min(max(a, b, core) for a, b, _ in near), near[0][2]))
        merged = np.array(pull) * strength
        assert got[i]["soft_cluster"] == names[int(merged.argmax())]
        assert abs(got[i]["soft_probability"] - merged.max() / merged.sum() * max(strength)) < 1e-9
    assert len(got) == len(y)


def test_known_vectors_keep_their_answer_and_versions_stay(spark, fitted, tmp_path):
    x, _ = fitted
    path = str(tmp_path / "m")
    with pytest.raises(ValueError):
        dm.load_model(spark, path)
    assert dm.fit_model(frame(spark, x), "id", "vec", path, epsilon=0.5) == 1
    first = sorted(map(tuple, dm.assign(dm.load_model(spark, path), frame(spark, x), "id", "vec").collect()))
    assert first == sorted(map(tuple, hi.tree_clusters(frame(spark, x), "id", "vec", epsilon=0.5).collect()))
    assert dm.fit_model(frame(spark, x[:60]), "id", "vec", path, epsilon=0.5) == 2
    assert dm.load_model(spark, path).version == 2 and dm.load_model(spark, path).points.count() == 60
    assert sorted(map(tuple, dm.assign(dm.load_model(spark, path, 1), frame(spark, x), "id", "vec").collect())) == first


def test_odd_rows(spark, fitted, tmp_path):
    x, path = fitted
    model = dm.load_model(spark, path)
    odd = spark.createDataFrame([("a", None), ("b", x[0].tolist()), ("c", x[0].tolist())], "id string, vec array<double>")
    rows = {r["id"]: r for r in dm.assign(model, odd, "id", "vec").collect()}
    assert rows["a"]["cluster"] == -1 and rows["b"][1:] == rows["c"][1:] and len(rows) == 3
    soft = {r["id"]: r for r in dm.exemplar_membership(model, odd, "id", "vec").collect()}
    assert soft["a"][1:] == (-1, 0.0) and soft["b"][1:] == soft["c"][1:] and soft["b"]["soft_cluster"] >= 0
    assert dm.assign(model, odd.limit(0), "id", "vec").count() == 0
    for n in (0, 3):
        small = str(tmp_path / f"small{n}")
        dm.fit_model(frame(spark, np.eye(3)[:n]), "id", "vec", small)
        got = dm.load_model(spark, small)
        ask = frame(spark, np.eye(3))
        assert [r["cluster"] for r in dm.assign(got, ask, "id", "vec").collect()] == [-1] * 3
        assert [r["soft_cluster"] for r in dm.exemplar_membership(got, ask, "id", "vec").collect()] == [-1] * 3


def test_fitting_searches_neighbours_once(spark, tmp_path, monkeypatch):
    searches, search = [], nb.nearest

    def counted(*args, **named):
        searches.append(args[1])
        return search(*args, **named)

    for module in (hi, dm):
        monkeypatch.setattr(module, "nearest", counted, raising=False)
    x = blobs(4)[:60]
    path = str(tmp_path / "once")
    dm.fit_model(frame(spark, x), "id", "vec", path, min_samples=3, epsilon=0.5, block=16)
    assert searches == [hi.NEIGHBORS]
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 1)[:, 3]
    assert np.allclose(d, [r["core"] for r in stored(spark, path)])
