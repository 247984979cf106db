"""Points against all points, the sent side in several parts, against brute force; no block of points is shuffled to every other."""

import numpy as np
import pytest

from accessmine.operators import clustering, factor, metrics, refine, sweep


@pytest.fixture
def in_parts(monkeypatch):
    for module, names in ((sweep, {"SENT": 600}), (metrics, {"BLOCK": 7, "STRIP": 4, "TILE": 3})):
        for name, value in names.items():
            monkeypatch.setattr(module, name, value)


def made(spark):
    r = np.random.default_rng(8)
    x = r.integers(0, 3, (70, 3)).astype(float)  # many equal points
    labels = np.where(np.arange(70) == 5, 9, r.integers(-1, 4, 70))
    points = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, embedding array<double>").repartition(3)
    return x, labels, points, spark.createDataFrame([(i, int(k)) for i, k in enumerate(labels)], "id long, label long")


def test_silhouettes_and_quality_in_parts(spark, in_parts):
    x, k, points, labels = made(spark)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {}
    for i in np.flatnonzero(k != -1):
        own = (k == k[i]) & (np.arange(70) != i)
        a, b = (d[i, own].mean() if own.any() else 0.0), min(d[i, k == c].mean() for c in set(k) - {-1, k[i]})
        want[i] = (b - a) / max(a, b) if own.any() else 0.0
    found = metrics.silhouette_points(points, labels)
    assert {r.id: r.silhouette for r in found.collect()} == pytest.approx(want)
    assert metrics.silhouette(points, labels).first()[0] == pytest.approx(np.mean(list(want.values())))
    quality = {c: 1 / (1 + d[np.ix_(k == c, k == c)].sum() / max(1, (k == c).sum() * ((k == c).sum() - 1))) if (k == c).sum() > 1 else 0.0 for c in set(k) - {-1}}
    assert {r.label: r.quality for r in refine.cluster_quality(points, labels).collect()} == pytest.approx(quality)
    assert "CoGroup" not in found._jdf.queryExecution().toString()


def test_nearest_in_parts(spark, in_parts):
    x, _, points, _ = made(spark)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    found = clustering.nearest(points, 5, block=9)
    got = {}
    for r in found.collect():
        got.setdefault(r.a, {})[r.b] = r.d2
    for i in range(70):
        order = sorted((d[i, j], j) for j in range(70) if j != i)[:5]
        assert got[i] == {j: e for e, j in order}
    assert "CoGroup" not in found._jdf.queryExecution().toString()


def test_components_are_tuned_on_rights_read_once(spark):
    made_ = spark.sparkContext.accumulator(0)

    def run(batches):
        for part in batches:
            made_.add(len(part))
            yield part

    up = spark.createDataFrame([(u, p) for u in range(30) for p in range(u % 3 * 3, u % 3 * 3 + 3)], "user_id long, permission_id long")
    rows, k = factor.tune_components(up.mapInPandas(run, up.schema), most=3, max_iter=3)
    assert made_.value == 90 and rows.count() == 2 and k in (2, 3)
