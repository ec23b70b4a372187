"""The index against brute force, with a third of the rows as copies, and what it gives at the edges."""

import numpy as np
import pytest

from figloom.operators import vector_index as V


def rows(rng, n=600):
    v = rng.normal(size=(n, 8)) + 4 * rng.integers(0, 3, size=(n, 1))
    v[::3] = v[0]
    return v


def brute(v, queries, k):
    out = set()
    for q in queries:
        far = ((v - v[q]) ** 2).sum(1)
        out |= {(int(q), int(i), place) for place, i in enumerate(np.lexsort((np.arange(len(v)), far))[:k], 1)}
    return out


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, x.tolist(), i) for i, x in enumerate(v)], "id long, v array<double>, cell int").repartition(5)


@pytest.mark.parametrize("part", [50_000, 40])
def test_exact_search_equals_brute_force(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(V, "PART_ROWS", part)
    monkeypatch.setattr(V, "PART_QUERIES", part // 4)
    v = rows(np.random.default_rng(1))
    df = frame(spark, v)
    V.build_index(df, "id", "v", str(tmp_path), cells=20)
    index = V.load_index(spark, str(tmp_path))
    assert V.load_index(spark, str(tmp_path)) is index and index.rows.count() == len(v)
    assert (index.parts.max() > 1) == (part < 200)
    queries = df.filter("id % 10 = 0")
    want = brute(v, range(0, len(v), 10), 5)
    for probes in (1, None):
        found = V.search_index(index, queries, "id", "v", 5, probes, exact=True)
        assert {(r.query, r.key, r.place) for r in found.collect()} == want
    near = V.search_index(index, queries, "id", "v", 5)
    truth = spark.createDataFrame([(q, key) for q, key, _ in want], "query long, key long")
    r = V.recall(near, truth).first()
    assert r.queries == 60 and r.recall >= 0.9
    few = V.search_index(index, queries, "id", "v", 300, 1, exact=True)
    assert few.count() == 60 * 300


def test_edges(spark, tmp_path):
    none = frame(spark, np.zeros((0, 3)))
    V.build_index(none, "id", "v", str(tmp_path / "none"))
    index = V.load_index(spark, str(tmp_path / "none"))
    assert V.search_index(index, frame(spark, np.ones((2, 3))), "id", "v", 3, exact=True).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)] + [(None, [1.0, 1.0]), (99, None)], "id long, v array<double>")
    V.build_index(same, "id", "v", str(tmp_path / "same"))
    index = V.load_index(spark, str(tmp_path / "same"))
    assert len(index.centres) == 1
    got = V.search_index(index, spark.createDataFrame([(7, [1.0, 2.0]), (8, None)], "id long, v array<double>"), "id", "v", 4, exact=True).collect()
    assert [(r.query, r.key, r.distance) for r in sorted(got, key=lambda r: r.place)] == [(7, k, 0.0) for k in range(4)]
    # Built again, the folder gives the new index.
    V.build_index(same.filter("id < 3"), "id", "v", str(tmp_path / "same"))
    assert V.load_index(spark, str(tmp_path / "same")).rows.count() == 3


def test_centres(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=(50, 2)), rng.normal(size=(50, 2)) + 50])
    c = V.fit_centres(v, 2)
    assert sorted(np.round(c[:, 0] / 50).tolist()) == [0, 1]
    at, far = V.nearest_centres(v, c, 2)
    assert (np.take_along_axis(((v[:, None] - c[None]) ** 2).sum(-1), at, 1) - far < 1e-6).all() and (far[:, 0] <= far[:, 1]).all()
    assert len(V.fit_centres(np.ones((5, 2)), 3)) == 1
