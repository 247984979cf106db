"""Singular vectors of sparse rows, factors that start from them, walks past hubs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from accessmine.operators import factor, graph, spectrum


def held(spark, x):
    return spark.createDataFrame([(int(u), int(p)) for u, p in np.argwhere(x)], "user_id long, permission_id long").repartition(4)


def planted(seed, groups=6, users=180, perms=60, noise=0.03):
    """Groups of unequal sizes with permissions in common; a few cells are wrong."""
    r = np.random.default_rng(seed)
    base = r.random((groups, perms)) < 0.25
    share = np.arange(1, groups + 1) / (groups * (groups + 1) / 2)
    return base[r.choice(groups, users, p=share)] ^ (r.random((users, perms)) < noise)


def test_leading_vectors_are_those_of_numpy(spark):
    r = np.random.default_rng(1)
    x = planted(1) * r.random((180, 60))
    rows = spark.createDataFrame([([int(j) for j in np.flatnonzero(row)], [float(v) for v in row[row != 0]]) for row in x], "cols array<int>, weights array<double>").repartition(3)
    values, basis = spectrum.leading(rows, 60, 5)
    _, s, vt = np.linalg.svd(x)
    assert np.allclose(values, s[:5] ** 2, rtol=1e-5)
    assert np.allclose(np.abs((basis * vt[:5].T).sum(0)), 1, atol=1e-3)


def test_leading_vectors_of_nothing_and_of_low_rank(spark):
    rows = spark.createDataFrame([([], []), ([], [])], "cols array<int>, weights array<double>")
    assert spectrum.leading(rows, 7, 3)[0].tolist() == [0, 0, 0]
    rows = spark.createDataFrame([([0, 2], [1.0, 1.0])] * 4 + [([], [])], "cols array<int>, weights array<double>")
    values, basis = spectrum.leading(rows, 3, 2)
    assert values.round(6).tolist() == [8, 0] and np.allclose(basis[:, 0], [0.5**0.5, 0, 0.5**0.5])
    with pytest.raises(ValueError):
        spectrum.leading(rows, 50_000_000, 2)


def test_embeddings_the_same_either_way(spark, monkeypatch):
    up = held(spark, planted(2))
    users = spark.range(181).withColumnRenamed("id", "user_id")
    dense, share = graph.svd_embeddings(up, users, 6)
    monkeypatch.setattr(graph, "GRAM_COLUMNS", 10)
    thin, again = graph.svd_embeddings(up, users, 6)
    a, b = ({r.id: np.array(r.embedding) for r in d.collect()} for d in (dense, thin))
    assert a.keys() == b.keys() and abs(share - again) < 1e-4 and not b[180].any()
    x, y = (np.array([d[i] for i in range(181)]) for d in (a, b))
    assert np.abs(x @ x.T - y @ y.T).max() < 0.02  # the same up to turns within equal values


def test_twenty_thousand_permissions(spark):
    users = spark.range(600).withColumnRenamed("id", "user_id")
    up = users.withColumn("permission_id", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("permission_id", (F.col("user_id") % 6) * 3000 + F.col("user_id") * 3 + F.pmod(F.xxhash64("user_id", "permission_id"), F.lit(200)))
    up = up.unionByName(spark.range(20_000).select((F.col("id") % 600).alias("user_id"), F.col("id").alias("permission_id"))).distinct()
    out, share = graph.svd_embeddings(up, users, 8)
    assert up.select("permission_id").distinct().count() >= 20_000 and 0 < share < 1
    norms = out.select(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)).alias("n"), F.size("embedding").alias("d")).agg(F.min("n"), F.max("n"), F.max("d")).first()
    assert 0.99 < norms[0] <= norms[1] < 1.01 and norms[2] == 8


# ---- factors ----


@pytest.mark.parametrize("options", [{}, {"loss": "kl"}, {"l1": 0.05, "l2": 0.05}])
def test_spectral_start_is_ahead_after_five_rounds(spark, options):
    up = held(spark, planted(3))
    errors = {}
    for start, seed in (("nndsvda", 1), ("random", 1), ("random", 2), ("random", 3)):
        w, h, e = factor.nmf(up, 6, max_iter=5, tol=0, seed=seed, start=start, **options)
        errors[start, seed] = e[-1]
        if start == "nndsvda":
            assert w.where("weight < 0").isEmpty() and h.where("weight < 0").isEmpty() and (h.count(), len(e)) == (360, 5)
    assert errors["nndsvda", 1] < min(v for k, v in errors.items() if k[0] == "random")


def test_more_roles_than_permissions_and_no_such_start(spark):
    up = held(spark, np.eye(3, dtype=bool)[[0, 1, 2, 0, 1]])
    assert factor.nmf(up, 5, max_iter=3, start="nndsvda")[2][-1] < 1
    with pytest.raises(ValueError):
        factor.nmf(up, 2, start="best")


def test_reconstruction_is_that_of_all_cells(spark):
    r = np.random.default_rng(4)
    w, h = r.random((40, 3)), r.random((3, 25)) * (r.random((3, 25)) < 0.6)
    x = planted(5, users=40, perms=30)
    long = lambda m, a, b: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in np.ndindex(*m.shape)], f"{a} long, {b} long, weight double")
    got = factor.reconstruction_quality(held(spark, x), long(w, "user_id", "role_id").withColumn("role_id", F.col("role_id") + 2), long(h, "role_id", "permission_id").withColumn("role_id", F.col("role_id") + 2)).first()
    y = w @ h  # permissions beyond those of h don't count
    assert got.mse == pytest.approx(((x[:, :25] - y) ** 2).mean()) and got.accuracy == pytest.approx(((y > 0.5) == x[:, :25]).mean())


# ---- walks ----


def test_walks_follow_the_weights(spark):
    """A hub of 3,000 users and a user with uneven edges: draws by weight, whatever the chunks."""
    edges = [(u, 1, 1.0) for u in range(3000)] + [(0, p, float(p)) for p in range(2, 40)]
    edges = spark.createDataFrame(edges, "user_id long, permission_id long, weight double")
    walks = graph.random_walks(edges.where("user_id = 0"), 4000, 2, chunk=8)
    first = Counter(r.path[1] for r in walks.collect())
    total = sum(range(2, 40)) + 1
    assert sum(first.values()) == 4000
    for p in range(1, 40):
        want = 4000 * p / total
        assert abs(first[f"p{p}"] - want) < 5 * np.sqrt(want) + 3
    ends = Counter(r.path[2] for r in graph.random_walks(edges, 3, 3, chunk=64).collect() if r.path[1] == "p1")
    assert max(ends.values()) < 14 and len(ends) > 2500  # near even over the hub's users
    paths = [tuple(r) for r in graph.random_walks(edges, 1, 5, chunk=64).where("user_id < 50").collect()]
    known = {(f"u{u}", f"p{p}") for u, p, _ in edges.collect()}
    assert all(len(path) == 5 and all((a, b) in known or (b, a) in known for a, b in zip(path, path[1:], strict=False)) for _, _, path in paths)
    again = [tuple(r) for r in graph.random_walks(edges.repartition(7), 1, 5, chunk=64).where("user_id < 50").collect()]
    assert sorted(paths) == sorted(again)


def test_no_row_holds_a_hub(spark):
    edges = spark.range(5000).select(F.col("id").alias("user_id"), F.lit(1).cast("long").alias("permission_id"), F.lit(1.0).alias("weight"))
    near, cells = graph._neighbours(edges, 100)
    assert near.agg(F.max(F.size("next"))).first()[0] < 200 and near.where("node = 'p1'").count() >= 45
    assert cells.agg(F.max(F.size("chunks"))).first()[0] <= 4
