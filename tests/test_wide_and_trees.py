"""Wide matrices with their report, trees of many clusters, models of many permissions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from accessmine.operators import catalog, clustering, predict
from accessmine.sources import io


def test_report_of_a_wide_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,a,b,c\nu1,1,0,0.6\nu2,0,0,0.5\nu3,,1,2\n")
    long, report = io.read_wide_observed(spark, str(tmp_path / "m.csv"))
    assert sorted(map(tuple, long.collect())) == [("u1", "a"), ("u1", "c"), ("u3", "b"), ("u3", "c")]
    row = io.wide_report(report)
    assert (row.users, row.permissions, row.ones) == (3, 3, 4) and row.sparsity_pct == pytest.approx(100 * 5 / 9)
    assert sorted(map(tuple, io.read_wide_matrix(spark, str(tmp_path / "m.csv")).collect())) == sorted(map(tuple, long.collect()))


@pytest.mark.parametrize("columns", [["id"], ["id", "a"]])
def test_report_of_empty_matrices(spark, columns):
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    long, report = io.from_wide_observed(empty if len(columns) > 1 else empty.withColumn("z", F.lit("0")))
    assert long.collect() == []
    assert io.wide_report(report).sparsity_pct == 100


@pytest.mark.parametrize("linkage", ["ward", "average", "complete", "single"])
def test_chains_make_the_same_tree(linkage):
    r = np.random.default_rng(3)
    for n in (2, 30, 120):
        x, size = r.normal(size=(n, 3)), r.integers(1, 9, n).astype(float)
        for k in {1, 2, 7, n}:
            if k <= n:
                a, b = clustering.agglomerate(x, size, k, linkage), clustering.chained(x, size, k, linkage)
                assert len(set(b.tolist())) == k
                assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == k  # one to one


@pytest.mark.parametrize(("n", "k"), [(1800, 500), (2500, 500), (40, 3)])
def test_exactly_as_many_clusters(spark, n, k):
    x = np.random.default_rng(4).normal(size=(n, 4))
    points = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>")
    labels = clustering.hierarchical(points, k)
    assert labels.count() == n and sorted(r.label for r in labels.select("label").distinct().collect()) == list(range(k))


def test_fewer_points_than_clusters(spark):
    points = spark.createDataFrame([(1, [0.0]), (2, [5.0])], "id long, embedding array<double>")
    assert sorted(map(tuple, clustering.hierarchical(points, 9).collect())) == [(1, 0), (2, 1)]
    assert clustering.hierarchical(points.limit(0), 9).collect() == []


def test_permission_models_are_those_of_single_fits(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(u, f"d{u % 3}", f"l{u % 4}") for u in range(240)]
    users = spark.createDataFrame(rows, "user_id long, department string, location string")
    held = [(u, 1, p) for u, d, _ in rows for p in range(9) if r.random() < (0.8 if int(d[1]) == p % 3 else 0.1)]
    lists = catalog.permission_lists(spark.createDataFrame(held, "user_id long, application_id long, permission_id long"), users)
    columns = ("department", "location")
    monkeypatch.setattr(predict, "PERMISSIONS_A_TASK", 2)
    models = predict.train_permission_predictor(users, lists, columns)
    got = {m.permission_id: m.weights for m in models.collect()}
    names = sorted({f"department={d}" for _, d, _ in rows} | {f"location={x}" for _, _, x in rows})
    x = np.array([[float(n in (f"department={d}", f"location={c}")) for n in names] + [1.0] for _, d, c in rows])
    assert sorted(got) == list(range(9))
    for p in range(9):
        y, w = np.array([float((u, 1, p) in set(held)) for u, _, _ in rows]), np.zeros(len(names) + 1)
        for _ in range(40):  # user by user, no profiles
            q = 1 / (1 + np.exp(-(x @ w)))
            w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - q) - w)
        assert np.allclose([got[p][n] for n in [*names, ""]], w, atol=1e-6)
    out = predict.predict_permissions(models, users, columns)
    assert out.count() == 240 * 9
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Cross")[1]  # permissions meet distinct profiles, not users


def test_nearest_centroids_either_way(spark):
    """One matrix in every task, or a join: the same; users that share nothing with any centroid as well."""
    r = np.random.default_rng(6)
    up = spark.createDataFrame([(u, int(p)) for u in range(80) for p in r.choice(30, r.integers(1, 6), replace=False)] + [(500, 999)], "user_id long, permission_id long")
    c = spark.createDataFrame([(k, int(p), float(r.random())) for k in (3, 5, 9) for p in r.choice(30, 12, replace=False)] + [(11, 2, 0.0)], "label long, permission_id long, value double")
    rows = lambda df: sorted((x.user_id, x.label, round(x.d2, 7)) for x in df.collect())
    whole = rows(clustering.assign_sparse(up, c))
    assert len(whole) == 81 and whole == rows(clustering.assign_sparse(up, c, cells=1))
    assert clustering.assign_sparse(up, c.limit(0)).collect() == []
