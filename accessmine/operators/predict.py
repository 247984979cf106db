"""Predicting roles and permissions for a new profile."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessmine.functions.common import small
from accessmine.operators.features import ATTRIBUTES, encoder, train_test_split

#: Permission models up to which they are sent to every task; each is a map of attribute values.
MODELS_SENT = 20_000
#: Attribute profiles that go to every task at most, and permissions that one task fits.
PROFILES, PERMISSIONS_A_TASK = 20_000, 64


def train_role_classifier(users: DataFrame, labels: DataFrame, trees: int = 100, columns: tuple[str, ...] = ATTRIBUTES, seed: int = 42) -> tuple[PipelineModel, float, DataFrame]:
    """(model, accuracy, predictions of the test users) of a forest on encoded attributes; labels (user_id, role_id)."""
    rows = users.join(labels, "user_id").withColumn("label", F.col("role_id").cast("double"))
    train, test = train_test_split(rows, "user_id", seed=seed)
    model = Pipeline(stages=[encoder(columns), RandomForestClassifier(numTrees=trees, maxDepth=10, seed=seed)]).fit(train)
    out = model.transform(test)
    return model, MulticlassClassificationEvaluator(metricName="accuracy").evaluate(out), out


def class_report(predictions: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of (label, prediction)."""
    from accessmine.operators.metrics import multilabel_counts, per_label_scores

    rows = predictions.withColumn("id", F.monotonically_increasing_id()).select("id", "label", "prediction").cache()
    return per_label_scores(multilabel_counts(rows.select("id", "label"), rows.select("id", F.col("prediction").alias("label"))))


def balance_weights(labels: DataFrame) -> DataFrame:
    """(role_id, y, weight): n / (2 n_class), over (user_id, role_id, y)."""
    n = labels.groupBy("role_id", "y").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("role_id").agg(F.sum("n").alias("t"))
    return n.join(total, "role_id").select("role_id", "y", (F.col("t") / (2 * F.col("n"))).alias("weight"))


def train_multi_role(users: DataFrame, y: DataFrame, roles: list[int], columns: tuple[str, ...] = ("department", "position"), trees: int = 20, seed: int = 42) -> dict[int, PipelineModel]:
    """A balanced forest for each role; y: (user_id, role_id) of the roles that users have."""
    features = encoder(columns).fit(users)
    rows = features.transform(users).select("user_id", "features").cache()
    out = {}
    for role in roles:
        own = rows.join(y.where(F.col("role_id") == role).select("user_id", F.lit(1.0).alias("label")), "user_id", "left").na.fill(0.0, ["label"])
        w = {r["y"]: r["weight"] for r in balance_weights(own.select("user_id", F.lit(role).alias("role_id"), F.col("label").alias("y"))).collect()}
        weighted = own.withColumn("w", F.when(F.col("label") == 1, w.get(1.0, 1.0)).otherwise(w.get(0.0, 1.0)))
        model = RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed, weightCol="w").fit(weighted)
        out[role] = PipelineModel(stages=[*features.stages, model])
    rows.unpersist()
    return out


def role_probabilities(models: dict[int, PipelineModel], profiles: DataFrame) -> DataFrame:
    """(user_id, role_id, p) for every role."""
    each = [m.transform(profiles).select("user_id", F.lit(role).alias("role_id"), vector_to_array("probability")[1].alias("p")) for role, m in models.items()]
    return reduce(DataFrame.unionByName, each)


def train_mlp(users: DataFrame, labels: DataFrame, layers: tuple[int, ...] = (64, 32), columns: tuple[str, ...] = ATTRIBUTES, seed: int = 42, max_iter: int = 60, initial=None) -> tuple[PipelineModel, float]:
    """(model, accuracy on test users) of a multilayer perceptron; ``initial``: weights to start from."""
    rows = users.join(labels, "user_id").withColumn("label", F.col("role_id").cast("double"))
    train, test = train_test_split(rows, "user_id", seed=seed)
    features = encoder(columns).fit(users)
    width = features.transform(users.limit(1)).first()["features"].size
    classes = int(labels.agg(F.max("role_id")).first()[0]) + 1
    mlp = MultilayerPerceptronClassifier(layers=[width, *layers, max(2, classes)], seed=seed, maxIter=max_iter)
    if initial is not None:
        mlp.setInitialWeights(initial)
    model = mlp.fit(features.transform(train))
    whole = PipelineModel(stages=[*features.stages, model])
    return whole, MulticlassClassificationEvaluator(metricName="accuracy").evaluate(whole.transform(test))


def train_permission_predictor(users: DataFrame, lists: DataFrame, columns: tuple[str, ...] = ATTRIBUTES, ridge: float = 1.0) -> DataFrame:
    """(permission_id, weights): a logistic model for each permission on attribute values.

    Users with equal attributes are one row with two counts, so a permission's model is
    fitted on as many rows as there are profiles, not users. weights maps "column=value"
    (and "" for the constant) to a number. A task fits a block of permissions over one
    design matrix of all profiles (PROFILES at most, which go to every task).
    """
    profile = F.array(*[F.concat(F.lit(f"{c}="), F.col(c)) for c in columns])
    rows = users.withColumn("profile", profile).join(lists, "user_id")
    totals = rows.groupBy("profile").agg(F.count(F.lit(1)).alias("n"))
    held = rows.select("profile", F.explode("permissions").alias("permission_id")).groupBy("profile", "permission_id").agg(F.count(F.lit(1)).alias("m"))
    totals = totals.withColumn("pid", F.xxhash64("profile")).limit(PROFILES + 1).collect()
    if len(totals) > PROFILES:
        raise ValueError(f"more than {PROFILES} attribute profiles")
    names = sorted({v for r in totals for v in r["profile"]})
    at = {v: i for i, v in enumerate(names)}
    order = np.argsort(np.array([r["pid"] for r in totals], np.int64))
    ids = np.array([totals[i]["pid"] for i in order], np.int64)
    marks = np.array([[at[v] for v in totals[i]["profile"]] for i in order], np.int32).reshape(len(ids), len(columns))
    n = np.array([totals[i]["n"] for i in order], float)

    def design() -> np.ndarray:
        x = np.zeros((len(ids), len(names) + 1))
        x[:, -1] = 1
        x[np.arange(len(ids))[:, None], marks] = 1
        return x

    def one(x: np.ndarray, m: np.ndarray) -> np.ndarray:
        w = np.zeros(len(names) + 1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (m - n * p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        return w

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, out = design(), []
        for permission, own in pdf.groupby("permission_id"):
            m = np.zeros(len(ids))
            m[np.searchsorted(ids, own["pid"].to_numpy())] = own["m"].to_numpy()
            out.append((permission, dict(zip([*names, ""], one(x, m).tolist(), strict=True))))
        return pd.DataFrame(out, columns=["permission_id", "weights"])

    perms = held.select("permission_id").distinct().count()
    block = F.pmod(F.xxhash64("permission_id"), F.lit(max(1, -(-perms // PERMISSIONS_A_TASK))))
    cells = held.select(block.alias("block"), "permission_id", F.xxhash64("profile").alias("pid"), "m")
    return cells.groupBy("block").applyInPandas(fit, "permission_id long, weights map<string,double>")


def predict_permissions(models: DataFrame, users: DataFrame, columns: tuple[str, ...] = ATTRIBUTES, grant: float = 0.5) -> DataFrame:
    """(user_id, permission_id, p, granted).

    A permission's chance is worked out once for each attribute profile; users come in last,
    by their profile.
    """
    users = users.select("user_id", F.array(*[F.concat(F.lit(f"{c}="), F.col(c)) for c in columns]).alias("profile"))
    rows = users.select("profile").distinct()
    score = F.aggregate("profile", F.element_at("weights", F.lit("")), lambda s, v: s + F.coalesce(F.element_at("weights", v), F.lit(0.0)))
    chances = rows.crossJoin(small(models, MODELS_SENT)).select("profile", "permission_id", (1 / (1 + F.exp(-score))).alias("p"))
    return users.join(chances, "profile").select("user_id", "permission_id", "p", (F.col("p") > grant).alias("granted"))


def recommend_roles(probabilities: DataFrame, names: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(user_id, role_id, p, title) of roles with p at least the threshold."""
    out = probabilities.where(F.col("p") >= threshold).join(small(names), "role_id", "left")
    title = F.concat(F.lit("["), F.col("role_id").cast("string"), F.lit("] "), F.coalesce("name", F.lit("not named")))
    return out.select("user_id", "role_id", "p", title.alias("title"))


def location_badge_rule(users: DataFrame, apps: DataFrame, perms: DataFrame) -> DataFrame:
    """(user_id, application_id, permission_id): the badge right of each user's location."""
    named = users.select("user_id", F.concat(F.lit("Access Badge System - "), "location").alias("app_name"))
    badge = perms.where("perm_name = 'access_building'").join(apps, "application_id").select("app_name", "application_id", "permission_id")
    return named.join(small(badge), "app_name").select("user_id", "application_id", "permission_id")


def route_by_confidence(pred: DataFrame, threshold: float = 0.8) -> DataFrame:
    return pred.withColumn("route", F.when(F.col("confidence") > threshold, "auto").otherwise("review"))


def apply_feedback(train: DataFrame, feedback: DataFrame, key: str = "user_id", repeats: int = 5) -> DataFrame:
    """train (key, role_id) with corrected rows in place of old ones, and a weight for each row."""
    fixed = feedback.select(key, F.col("corrected_role").alias("role_id"), F.lit(repeats).cast("long").alias("weight"))
    kept = train.join(feedback.select(key), key, "left_anti").select(key, "role_id", F.lit(1).cast("long").alias("weight"))
    return kept.unionByName(fixed)


def refit_with_feedback(users: DataFrame, train: DataFrame, feedback: DataFrame, previous: PipelineModel | None = None, repeats: int = 5, columns: tuple[str, ...] = ATTRIBUTES, **options) -> tuple[PipelineModel, float, DataFrame]:
    """(model, accuracy on test users, scores): the perceptron fitted again with the corrections.

    A row of weight w counts as w rows. With ``previous`` of the same shape (attribute
    values, layers, classes) training starts from its weights, else anew. scores has
    (user_id, role_id, confidence) for every user, role_id the likeliest role.
    """
    labels = apply_feedback(train, feedback, repeats=repeats)
    labels = labels.select("user_id", "role_id", F.explode(F.array_repeat(F.lit(1), F.col("weight").cast("int")))).drop("col")
    initial = None
    if previous is not None:
        width = encoder(columns).fit(users).transform(users.limit(1)).first()["features"].size
        classes = max(2, int(labels.agg(F.max("role_id")).first()[0]) + 1)
        net = previous.stages[-1]
        if list(net.getLayers()) == [width, *options.get("layers", (64, 32)), classes]:
            initial = net.weights
    model, accuracy = train_mlp(users, labels, columns=columns, initial=initial, **options)
    scores = model.transform(users).select("user_id", F.col("prediction").cast("long").alias("role_id"), F.array_max(vector_to_array("probability")).alias("confidence"))
    return model, accuracy, scores
