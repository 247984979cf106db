"""Forms for many rows, held against the exact ones."""

import numpy as np
import pytest

from accessmine.operators import clustering, metrics, neighbours, refine, similarity


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>").repartition(3)


def labelled(spark, labels):
    return spark.createDataFrame([(i, int(k)) for i, k in enumerate(labels)], "id long, label long")


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(2)
    return r.normal(size=(40, 16))[r.integers(0, 40, 3000)] * 3 + r.normal(size=(3000, 16))


# ---- silhouettes from sums ----


@pytest.mark.parametrize("far", [0.0, 1e5])
def test_silhouette_squared(spark, far):
    r = np.random.default_rng(1)
    x = r.normal(size=(90, 5)) + np.repeat(np.arange(3), 30)[:, None] + far
    k = np.repeat([4, 7, -1], 30)
    k[0], k[1] = 9, -1  # one point alone, one noise
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = {}
    for i in range(90):
        if k[i] != -1:
            a = d[i, (k == k[i]) & (np.arange(90) != i)]
            b = min(d[i, k == c].mean() for c in (4, 7, 9) if c != k[i])
            want[i] = (b - a.mean()) / max(a.mean(), b) if len(a) else 0.0
    got = {r.id: r.silhouette for r in metrics.silhouette_squared_points(points(spark, x), labelled(spark, k)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_silhouette_squared_of_little(spark):
    x = points(spark, [[0.0], [0.0], [1.0]])
    assert metrics.silhouette_squared(x, labelled(spark, [1, 1, 1])).first()[0] == 0
    assert metrics.silhouette_squared(x, labelled(spark, [-1, -1, -1])).first()[0] == 0
    assert metrics.silhouette_squared(x, labelled(spark, [1, 1, 2])).first()[0] == pytest.approx(2 / 3)


def test_no_pairs_are_made(spark):
    """One stage reads the points for the sums and one for the scores: rows never multiply."""
    plan = metrics.silhouette_squared(points(spark, [[0.0], [1.0]]), labelled(spark, [1, 2]))._jdf.queryExecution().toString()
    assert "Cogroup" not in plan and "Generate" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_quality_squared(spark):
    r = np.random.default_rng(3)
    x, k = r.normal(size=(60, 4)), np.repeat([1, 2, -1], 20)
    k[0] = 3
    got = {q.label: q.quality for q in refine.cluster_quality_squared(points(spark, x), labelled(spark, k)).collect()}
    for c in (1, 2):
        own = x[k == c]
        d = ((own[:, None] - own[None]) ** 2).sum(-1)
        assert got[c] == pytest.approx(1 / (1 + np.sqrt(d.sum() / (len(own) * (len(own) - 1)))))
    assert got[3] == 0 and set(got) == {1, 2, 3}
    exact = {q.label: q.quality for q in refine.cluster_quality(points(spark, x), labelled(spark, k)).collect()}
    assert all(got[c] <= exact[c] + 1e-12 for c in got)


def test_sweeps_say_which_silhouette(spark):
    x = points(spark, np.random.default_rng(4).normal(size=(60, 3)))
    assert [tuple(r)[::3] for r in clustering.sweep_k(x, [2, 3], 1).collect()] == [(2, False), (3, False)]
    assert [tuple(r)[::3] for r in clustering.sweep_k(x, [2, 3], 1, pair_rows=59).collect()] == [(2, True), (3, True)]
    assert {r.squared for r in refine.tune_embedding_k(x, 7, 1, pair_rows=59).collect()} == {True}


# ---- neighbours ----


def test_likely_neighbours(spark, clustered):
    p = points(spark, clustered).cache()
    found = neighbours.nearest_likely(p, 10, block=256).cache()
    exact = clustering.nearest(p, 10)
    both = exact.join(found.select("a", "b"), ["a", "b"]).count()
    assert both >= 0.9 * 30_000
    assert found.groupBy("a").count().where("count = 10").count() == 3000
    d = {(r.a, r.b): r.d2 for r in found.limit(500).collect()}
    assert all(abs(v - ((clustered[a] - clustered[b]) ** 2).sum()) < 1e-6 for (a, b), v in d.items())
    assert abs(neighbours.recall(p, found, 10) - both / 30_000) < 0.05


def test_each_table_copies_a_point_once(spark, clustered):
    """Pairs grow with the points, not with their square: two stretches for each point and table."""
    p = points(spark, clustered)
    assert neighbours.met(p, 5, range(3), block=128).count() <= 2 * 3 * 5 * 3000


def test_neighbours_of_equal_points_and_few(spark):
    same = neighbours.nearest_likely(points(spark, np.ones((700, 4))), 3, block=64)
    assert same.groupBy("a").count().where("count = 3").count() == 700
    assert neighbours.nearest_likely(points(spark, [[1.0]]), 3).count() == 0
    assert sorted(tuple(r) for r in neighbours.nearest_likely(points(spark, [[1.0], [2.0], [4.0]]), 5).collect()) == [(0, 1, 1.0), (0, 2, 9.0), (1, 0, 1.0), (1, 2, 4.0), (2, 0, 9.0), (2, 1, 4.0)]


def test_exact_way_when_tables_do_not_do(spark):
    x = np.random.default_rng(5).normal(size=(600, 30))
    p = points(spark, x)
    found = neighbours.nearest_likely(p, 5, least=0.999, tables=1, most_tables=1, block=32)
    assert sorted(map(tuple, found.select("a", "b").collect())) == sorted(map(tuple, clustering.nearest(p, 5).select("a", "b").collect()))


def test_spectral_over_likely_neighbours(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(60, 3)), r.normal(size=(60, 3)) + 20])
    labels = {r.id: r.label for r in clustering.spectral(points(spark, x), 2, pair_rows=10).collect()}
    assert len({labels[i] for i in range(60)}) == 1 and len({labels[i] for i in range(60, 120)}) == 1 and labels[0] != labels[60]


# ---- MinHash join, crowded keys ----


def sets(spark, rows):
    return spark.createDataFrame([(u, p) for u, s in enumerate(rows) for p in s], "user_id long, permission_id long")


@pytest.fixture(scope="module")
def alike():
    """Groups of sets that differ from their base in a few permissions."""
    r = np.random.default_rng(9)
    out = []
    for _ in range(60):
        base = r.choice(900, 30, replace=False)
        for _ in range(8):
            own = set(base.tolist())
            own -= set(r.choice(base, r.integers(0, 4), replace=False).tolist())
            own |= set(r.choice(900, r.integers(0, 4)).tolist())
            out.append(own)
    return out


@pytest.mark.parametrize(("metric", "t"), [("jaccard", 0.7), ("cosine", 0.85)])
def test_minhash_join(spark, alike, metric, t):
    up = sets(spark, alike)
    exact = {(r.a, r.b): r.value for r in similarity.similarity_join(up, metric, t).collect()}
    found = {(r.a, r.b): r.value for r in similarity.similarity_join(up, metric, t, mode="minhash").collect()}
    assert len(exact) > 500 and all(abs(exact[k] - v) < 1e-9 for k, v in found.items())  # nothing but true pairs
    assert len(found) >= 0.97 * len(exact)
    value = (lambda a, b: len(a & b) / len(a | b)) if metric == "jaccard" else (lambda a, b: len(a & b) / np.sqrt(len(a) * len(b)))
    assert exact.keys() == {(a, b) for a in range(len(alike)) for b in range(a + 1, len(alike)) if value(alike[a], alike[b]) >= t - 1e-9}


def test_banding_keeps_its_promise():
    for t in (0.3, 0.5, 0.7, 0.85, 0.99):
        rows, bands = similarity.banding(t)
        assert rows * bands <= 128 and (1 - (1 - t**rows) ** bands >= 0.99 or rows == 1)
    assert similarity.banding(0.9)[0] > similarity.banding(0.5)[0]


def test_minhash_refuses_distances(spark):
    with pytest.raises(ValueError):
        similarity.similarity_join(sets(spark, [{1}]), "euclidean", 1.0, mode="minhash")
    with pytest.raises(ValueError):
        similarity.similarity_join(sets(spark, [{1}]), mode="guess")


def test_crowded_keys_are_split(spark, alike, monkeypatch):
    """One permission that everyone holds: the same pairs, whatever the size of its parts."""
    up = sets(spark, [{1000} | s for s in alike[:200]])
    whole = sorted(map(tuple, similarity.similarity_join(up, "jaccard", 0.3).collect()))
    monkeypatch.setattr(similarity, "CROWD", 16)
    assert sorted(map(tuple, similarity.similarity_join(up, "jaccard", 0.3).collect())) == whole
    links = {r.user_id: r.links for r in similarity.similarity_links(up, "jaccard", 0.3).collect()}
    assert sum(links.values()) == 2 * len(whole)
