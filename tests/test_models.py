import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from accessmine.operators import catalog, clustering, factor, generate, graph, metrics, predict, refine
from accessmine.sources import io
from tests import fixtures as fx


def blobs(spark):
    r = np.random.default_rng(0)
    rows = [(i, (r.normal(0, 0.1, 4) + [3 * (i % 3), 0, 0, 0]).tolist()) for i in range(60)]
    return spark.createDataFrame(rows, "id long, embedding array<double>")


@pytest.mark.parametrize("how", ["kmeans", "ward", "average", "spectral"])
def test_planted_clusters(spark, how):
    points = blobs(spark)
    run = {"kmeans": lambda: clustering.kmeans(points, 3, n_init=2)[0], "ward": lambda: clustering.hierarchical(points, 3, micro=12), "average": lambda: clustering.hierarchical(points, 3, "average", micro=12), "spectral": lambda: clustering.spectral(points, 3, 5)}[how]
    got = {r.id: r.label for r in run().collect()}
    if how == "spectral":
        assert set(got) == set(range(60))
    else:
        assert all(got[i] == got[i % 3] for i in range(60)) and len(set(got.values())) == 3


def test_refine(spark):
    points = blobs(spark)
    labels = points.select("id", F.when(F.col("id") < 3, F.lit(9)).otherwise(F.col("id") % 3).cast("long").alias("label"))
    out = refine.reassign_low_quality(points, labels, refine.cluster_quality(points, labels), 0.5)
    assert {r.label for r in out.collect()} == {0, 1, 2}


def test_generator_is_reproducible_and_planted(spark):
    users = generate.generate_users(spark, 400)
    apps = generate.generate_applications(spark).cache()
    perms = generate.generate_permissions(apps).cache()
    rules = generate.draw_group_rules(spark, perms, apps)
    a = generate.provision_rights(users, rules, perms, apps)
    b = generate.provision_rights(users.repartition(7), rules, perms, apps)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    badge = generate.badge_rights(users, perms, apps)
    assert badge.count() == 400 and badge.join(a, badge.columns, "left_anti").count() == 0
    assert apps.count() == 46 and users.select("position").distinct().count() == 28 and users.select("department").distinct().count() == 9
    each = {r.application_id: set(r.names) for r in perms.groupBy("application_id").agg(F.collect_list("perm_name").alias("names")).collect()}
    sizes = [len(x) for x in each.values()]
    assert len(each) == 46 and min(sizes) >= 5 and 7 <= sum(sizes) / 46 <= 11 and perms.count() == sum(sizes)
    assert all("access_building" in each[r.application_id] for r in apps.where("category = 'FACILITIES'").collect())
    # each group holds as many permissions of its pools as it should, and of no other category
    kind = {r.application_id: r.category for r in apps.collect()}
    drawn = rules.collect()
    for group, (_, pools) in generate.GROUPS.items():
        own = [kind[r.application_id] for r in drawn if r.group == group]
        assert all(sum(c in generate.POOLS[p] for c in own) == k for p, k in pools) and len(own) == sum(k for _, k in pools)


def test_sweep_scores(spark):
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(30, 3)), 3)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    labels = {k: np.arange(30) % k for k in (2, 4)}
    frames = {k: spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "id long, label long") for k, y in labels.items()}
    got = {row.k: row for row in metrics.sweep_scores(points, frames).collect()}
    assert sorted(got) == [2, 4]
    for k, y in labels.items():
        c = np.array([x[y == j].mean(0) for j in range(k)])
        d2 = ((x[:, None] - x[None]) ** 2).sum(2)
        a = np.array([d2[i, y == y[i]].sum() / ((y == y[i]).sum() - 1) for i in range(30)])
        b = np.array([min(d2[i, y == j].mean() for j in range(k) if j != y[i]) for i in range(30)])
        s = [np.sqrt(((x[y == j] - c[j]) ** 2).sum(1)).mean() for j in range(k)]
        db = np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(k) if j != i) for i in range(k)])
        assert abs(got[k].inertia - ((x - c[y]) ** 2).sum()) < 1e-9
        assert abs(got[k].silhouette - ((b - a) / np.maximum(a, b)).mean()) < 1e-9 and abs(got[k].davies_bouldin - db) < 1e-9


def test_wide_round_trip(spark, tmp_path):
    up = fx.up(spark)
    wide = io.to_wide(up, fx.users(spark), [1, 2, 3, 4, 5, 6])
    assert wide.count() == 8 and wide.where("user_id = 8").first()[1:] == (0,) * 6
    io.write_csv(wide.coalesce(1), str(tmp_path / "w"))
    back = io.read_wide_matrix(spark, str(tmp_path / "w"))
    assert back.count() == up.count()


def test_exports(spark, tmp_path):
    from accessmine.operators import roles

    up, labels = fx.up(spark), fx.labels(spark)
    r = roles.extract_roles(up, labels)
    perms = roles.role_permissions(up, labels, r, all_=True)
    io.export_roles(r, roles.role_users(labels, r), perms, metrics.role_metrics(r), str(tmp_path))
    assert spark.read.json(str(tmp_path / "roles.json")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "role_details.csv")).columns == ["Role", "Permission", "Frequency", "Meets_Impact_Threshold"]
    io.write_matrix(catalog.user_permission_matrix(up, catalog.dense_index(fx.users(spark), "user_id", "matrix_user_idx"), catalog.dense_index(up.select("permission_id").distinct(), "permission_id", "matrix_perm_idx")), str(tmp_path / "m"))
    assert io.read_matrix(spark, str(tmp_path / "m")).count() == up.count()
    io.write_record(metrics.role_metrics(r).select(F.lit(2).alias("roles"), F.lit(None).cast("long").alias("missing")), str(tmp_path / "summary.json"))
    assert [json.loads(x.value) for x in spark.read.text(str(tmp_path / "summary.json")).distinct().collect()] == [{"roles": 2}]
    results = spark.createDataFrame([("volumes", True, 8), ("badge", False, 1)], "test string, passed boolean, n long")
    io.write_validation(results, str(tmp_path / "validation.json"))
    tests = json.loads(spark.read.text(str(tmp_path / "validation.json")).first().value)["tests"]
    assert sorted((t["test"], t["passed"], t["n"]) for t in tests) == [("badge", False, 1), ("volumes", True, 8)]
    comparison = spark.createDataFrame([("dbscan", 0.7), ("nmf", 0.4)], "method string, score double")
    io.export_comparison(comparison, comparison.orderBy(F.desc("score")).limit(1), str(tmp_path / "cmp"))
    back = spark.read.option("header", True).csv(str(tmp_path / "cmp" / "comparison.csv"))
    assert sorted(map(tuple, back.collect())) == [("dbscan", "0.7"), ("nmf", "0.4")]
    assert json.loads(spark.read.text(str(tmp_path / "cmp" / "recommendation.json")).first().value) == {"method": "dbscan", "score": 0.7}


def test_a_saved_model_predicts_the_same(spark, tmp_path):
    kinds = ("IT", "HR")
    users = spark.createDataFrame([(i, kinds[i % 2], kinds[i % 2], "Paris", "CDI", "Lead") for i in range(40)], "user_id long, position string, department string, location string, contract_type string, seniority string")
    model, *_ = predict.train_role_classifier(users, users.select("user_id", (F.col("user_id") % 2).cast("int").alias("role_id")), trees=3)
    io.save_model(model, str(tmp_path / "model"))
    again = io.load_model(str(tmp_path / "model"))
    rows = [sorted((r.user_id, r.prediction) for r in m.transform(users).select("user_id", "prediction").collect()) for m in (model, again)]
    assert rows[0] == rows[1] and {p for _, p in rows[0]} == {0.0, 1.0}


def test_walks_and_embeddings(spark):
    edges = graph.bipartite_edges(fx.up(spark), fx.users(spark))
    walks = graph.random_walks(edges, 2, 5)
    again = graph.random_walks(edges.repartition(5), 2, 5)
    assert sorted(map(str, walks.collect())) == sorted(map(str, again.collect()))
    held = {(f"u{r.user_id}", f"p{r.permission_id}") for r in edges.collect()}
    for r in walks.collect():
        assert all((a, b) in held or (b, a) in held for a, b in zip(r.path, r.path[1:], strict=False))
    out, share = graph.svd_embeddings(fx.up(spark), fx.users(spark), 3)
    norms = [float(np.linalg.norm(r.embedding)) for r in out.collect()]
    assert sorted(round(x, 6) for x in norms) == [0.0] + [1.0] * 7 and 0 < share <= 1


def test_permission_predictor(spark):
    users = spark.createDataFrame([(i, "it" if i % 2 else "hr") for i in range(40)], "user_id long, department string")
    lists = users.select("user_id", F.when(F.col("department") == "it", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(3))).cast("array<bigint>").alias("permissions"))
    models = predict.train_permission_predictor(users, lists, ("department",))
    got = predict.predict_permissions(models, users, ("department",)).where("granted").groupBy("user_id").agg(F.sort_array(F.collect_list("permission_id")).alias("p"))
    assert all(r.p == ([1, 2] if r.user_id % 2 else [3]) for r in got.collect())


def test_multi_role(spark):
    users = spark.createDataFrame([(i, "a" if i % 2 else "b", "x") for i in range(60)], "user_id long, department string, position string")
    y = users.where("department = 'a'").select("user_id", F.lit(0).alias("role_id"))
    p = predict.role_probabilities(predict.train_multi_role(users, y, [0], trees=3), users)
    assert p.where("(p > 0.5) <> (user_id % 2 = 1)").count() == 0
    w = factor.multi_role_labels(spark.createDataFrame([(1, 0, 0.15), (1, 1, 0.85), (2, 0, 0.0), (2, 1, 0.0)], "user_id long, role_id int, weight double"))
    assert [tuple(r)[:2] for r in w.collect()] == [(1, 1)]


def test_predictor_queries_cover_all_roles(spark):
    from accessmine.plans import models, registry  # noqa: F401
    from accessmine.plans.iam_view import Iam

    small = "/root/testdata/sf0.001"
    view = Iam(spark, small)
    p = registry.QUERIES["j2_multi_role"](spark, small)
    assert {r.role_id for r in p.select("role_id").distinct().collect()} == set(range(6))
    assert p.count() == 6 * view.users.count()


def test_mlp_query_trains_on_all_cohorts(spark, monkeypatch):
    from accessmine.plans import models, registry
    from accessmine.plans.iam_view import Iam

    seen, train = {}, models.predict.train_mlp

    def spy(users, labels, *args, **kwargs):
        seen["labels"] = {r.role_id for r in labels.select("role_id").distinct().collect()}
        model, accuracy = train(users, labels, *args, **kwargs)
        seen["layers"] = model.stages[-1].getLayers()
        return model, accuracy

    small = "/root/testdata/sf0.001"
    monkeypatch.setattr(models.predict, "train_mlp", spy)
    assert registry.QUERIES["j3_mlp"](spark, small).count() == Iam(spark, small).users.count()
    assert seen["labels"] == {r.label for r in Iam(spark, small).labels.where("label <> -1").select("label").distinct().collect()}
    assert seen["layers"][1:] == [64, 32, 24]


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (90, 5)).astype(float)
    points = spark.createDataFrame([(i * 7, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    got = {}
    for r in clustering.nearest(points, 4, block=20).collect():
        got.setdefault(r.a, set()).add(r.b)
    for i in range(90):
        order = sorted((((x[i] - x[j]) ** 2).sum(), j * 7) for j in range(90) if j != i)
        assert got[i * 7] == {j for _, j in order[:4]}


def test_no_permission_in_use(spark):
    none, users = spark.createDataFrame([], "user_id long, permission_id long"), spark.createDataFrame([(1,), (2,)], "user_id long")
    assert [r.embedding for r in clustering.vectors(none, users).collect()] == [[], []]
    assert [r.embedding for r in graph.svd_embeddings(none, users)[0].collect()] == [[], []]


def test_reduced_against_numpy(spark):
    x = np.random.default_rng(6).random((50, 6))
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>").repartition(5)
    out, share = graph.reduced(points, 3)
    got = np.array([r.embedding for r in out.orderBy("id").collect()])
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(np.sort(np.linalg.norm(got, axis=0))[::-1], s[:3]) and abs(share - (s[:3] ** 2).sum() / (s**2).sum()) < 1e-9


def test_tune_embedding_k(spark):
    rng = np.random.default_rng(2)
    centers = np.array([[0, 0], [20, 0], [0, 20], [20, 20]])
    x = np.concatenate([c + rng.normal(0, 0.3, (8, 2)) for c in centers])
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    got = refine.tune_embedding_k(points, 8, n_init=1)
    assert got.count() == 0  # 32 users in groups of 8 allow up to 4, but k starts at 8
    rows = refine.tune_embedding_k(points, 4, n_init=2).collect()
    assert [r.k for r in rows] == list(range(4, 9))
    assert [r.k for r in rows if r.best] == [4]


def test_merge_similar_clusters(spark):
    points = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [0.0, 1.0])], "id long, embedding array<double>")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 2)], "id long, label int")
    assert {r.id: r.label for r in refine.merge_similar_clusters(points, labels, 0.85).collect()} == {0: 0, 1: 0, 2: 0, 3: 2}


def test_refit_with_feedback(spark):
    users = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(90)], "user_id long, department string")
    train = users.select("user_id", (F.col("user_id") % 3).cast("int").alias("role_id"))
    options = {"layers": (6,), "max_iter": 80}
    before, _ = predict.train_mlp(users, train, columns=("department",), **options)
    feedback = users.where("department = 'a'").select("user_id", F.lit(2).alias("corrected_role"))
    for previous in (before, None):
        _, accuracy, scores = predict.refit_with_feedback(users, train, feedback, previous, columns=("department",), **options)
        assert accuracy == 1.0 and scores.count() == 90
        assert all(r.role_id == (2 if r.user_id % 3 == 0 else r.user_id % 3) for r in scores.collect())


def test_sample_by_hash(spark):
    from accessmine.operators import stats

    up = spark.createDataFrame([(u, p) for u in range(30) for p in range(u // 10 * 3, u // 10 * 3 + 3)], "user_id long, permission_id long")
    assert stats.sampled_similarity(up, sample=10).first()["mean"] == 1.0  # the lowest ids are one department
    assert stats.sampled_similarity(up, sample=10, seed=42).first()["mean"] < 1.0
    assert stats.sampled_similarity(up, sample=30, seed=42).first()["pairs"] == stats.sampled_similarity(up, sample=30).first()["pairs"]


def test_scores_with_single_and_equal_clusters(spark):
    from accessmine.operators import metrics

    points = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [9.0])], "id long, embedding array<double>")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "id long, label int")
    assert {r.id: round(r.silhouette, 6) for r in metrics.silhouette_points(points, labels).collect()} == {0: round(8 / 9, 6), 1: round(7 / 8, 6), 2: 0.0}
    same = spark.createDataFrame([(0, [1.0]), (1, [3.0]), (2, [2.0])], "id long, embedding array<double>")
    assert metrics.davies_bouldin(same, labels).first()[0] == 0.0
