"""Eight users, six permissions: answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from accessmine.operators import catalog, clustering, factor, graph, metrics, quality, roles, similarity, stats
from tests import fixtures as fx


@pytest.fixture(scope="module")
def up(spark):
    return fx.up(spark).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return fx.labels(spark)


def near(a, b):
    return abs(a - b) < 1e-5


def test_statistics(spark, up):
    r = stats.perms_per_user_stats(up).first()
    for k, x in {"mean": 2.714286, "median": 3, "std": 0.755929, "q1": 2, "q3": 3, "skewness": 0.459279, "kurtosis": -0.895833, "cv": 27.850014}.items():
        assert near(r[k], x), k
    assert near(quality.permission_entropy(up).first()[0], 1.004242)
    perms = spark.range(1, 7).toDF("permission_id")
    r = stats.users_per_perm_stats(up, perms).first()
    assert (r.q1, r.q3, r.rare, r.common) == (3, 3.75, 1, 2)
    r = stats.entropy_metrics(up).first()
    assert near(r.entropy, 2.549787) and near(r.max_entropy, 2.584963)
    assert near(stats.gini(up.groupBy("permission_id").agg(F.count(F.lit(1)).alias("n"))).first().gini_coefficient, -0.114035)


def test_edges(spark, up):
    w = {r.permission_id: r.weight for r in graph.bipartite_edges(up, fx.users(spark)).collect()}
    assert near(w[4], 1.980829) and near(w[1], 1.693147) and near(w[2], 1.470004)


def test_k_distance(spark, up):
    d = {r.user_id: r.distance for r in similarity.k_distance(up, 3).collect()}
    want = [0.25, 0.25, 0.25, 1 / 3, 1 / 3, 1 / 3, 2 / 3]
    assert all(near(d[u], x) for u, x in enumerate(want, 1))


@pytest.mark.parametrize("parts", [1, 5])
def test_dbscan(spark, up, parts):
    run = lambda eps: [r.label for r in clustering.dbscan(up.repartition(parts), eps, 3, "jaccard", fx.users(spark)).orderBy("user_id").collect()]
    assert run(0.30) == [0, 0, 0, -1, -1, -1, -1, -1]
    assert run(0.35) == [0, 0, 0, 1, 1, 1, -1, -1]


def test_roles(up, labels):
    r = {x.role: x for x in roles.extract_roles(up, labels, 3, 0.8).collect()}
    assert r["Role_0"].cohesion == 1 and r["Role_0"].coverage == 0.75 and r["Role_1"].cohesion == 1 and near(r["Role_1"].coverage, 2 / 3)
    assert roles.extract_roles(up, labels, 4, 0.8).count() == 0
    perms = roles.role_permissions(up, labels, roles.extract_roles(up, labels, 3, 0.8), 0.8)
    assert metrics.role_overlap(perms).first()[0] == 0
    assert near(metrics.permission_compression(roles.extract_roles(up, labels, 3, 0.8), perms, up.select(F.lit(6).alias("n")).limit(1)).first().compression, 1 / 6)
    near_ = {x.user_id: x for x in roles.assign_noise_nearest(up, labels.where("label = -1"), perms).collect()}
    assert set(near_) == {7} and near_[7].role == "Role_1" and near(near_[7].similarity, 1 / 3)
    gap = {x.user_id: (x.over, x.under) for x in metrics.provisioning_gap(up, roles.role_users(labels, roles.extract_roles(up, labels, 3, 0.8)), perms).collect()}
    assert gap[3] == (0, 0.25) and near(gap[6][1], 1 / 3) and gap[1] == (0, 0)


def test_scores(spark, up, labels):
    points = clustering.vectors(up)
    own = labels.where("label >= 0").select(F.col("user_id").alias("id"), "label")
    assert near(metrics.silhouette(points, own).first()[0], 0.715372)
    assert near(metrics.davies_bouldin(points, own).first()[0], 0.397523)
    assert near(metrics.calinski_harabasz(points, own).first()[0], 22.5)
    one = own.withColumn("label", F.lit(0))
    assert metrics.silhouette(points, one).first()[0] == 0 and metrics.davies_bouldin(points, one).first()[0] == float("inf") and metrics.calinski_harabasz(points, one).first()[0] == 0


def test_dirty_rights(spark, up):
    dirty = up.unionByName(spark.createDataFrame([(1, 1), (99, 1), (1, 99), (None, 2)], "user_id long, permission_id long"))
    perms = spark.range(1, 7).toDF("permission_id")
    clean = catalog.clean_rights(dirty, fx.users(spark), perms)
    assert sorted(map(tuple, clean.collect())) == sorted(map(tuple, up.collect()))
    bad = {r.key: r.bad_rows for r in quality.foreign_key_errors(dirty, {"user_id": fx.users(spark), "permission_id": perms}).collect()}
    assert bad == {"user_id": 2, "permission_id": 1}


def test_nmf(up):
    w, h, errors = factor.nmf(up, 2, max_iter=20, tol=0)
    assert all(b <= a + 1e-6 for a, b in zip(errors, errors[1:], strict=False)) and errors[-1] < 2.5
    assert w.where("weight < 0").count() == 0 and h.where("weight < 0").count() == 0
    d = {r.user_id: r.role_id for r in factor.dominant_role(w).collect()}
    assert d[1] == d[2] == d[3] != d[4] == d[5] == d[6]
