"""Refinement of clusters of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessmine.functions.common import cut, distance, dot, small, squared
from accessmine.operators.clustering import kmeans
from accessmine.operators.metrics import PAIR_ROWS, centroids, davies_bouldin, distance_sums, moments, silhouette, silhouette_squared


def cluster_quality(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, quality): 1 / (1 + mean distance of pairs); 0 for single points."""
    own = distance_sums(points, labels, same=True).groupBy("label").agg(F.sum("total").alias("t"), F.max("n").alias("n"))
    return own.select("label", F.when(F.col("n") > 1, 1 / (1 + F.col("t") / (F.col("n") * (F.col("n") - 1)))).otherwise(0.0).alias("quality"))


def cluster_quality_squared(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, quality): 1 / (1 + root mean squared distance of pairs), never above cluster_quality; 0 for single points.

    From one sum for each cluster: the squared distances of all ordered pairs add up to
    2 n q - 2 |t|^2 for n points with sum t and squared lengths q.
    """
    m = moments(points, labels)
    pairs = F.greatest(F.lit(0.0), 2 * F.col("n") * F.col("squares") - 2 * squared(F.col("total")))
    mean = pairs / (F.col("n") * (F.col("n") - 1))
    return m.select("label", F.when(F.col("n") > 1, 1 / (1 + F.sqrt(mean))).otherwise(0.0).alias("quality"))


def reassign_low_quality(points: DataFrame, labels: DataFrame, quality: DataFrame, least: float = 0.6) -> DataFrame:
    """(id, label): points of poor clusters go to the nearest centroid of the good ones, as they were before.

    Without any good cluster nothing changes.
    """
    good = quality.where(F.col("quality") >= least).select("label")
    c = centroids(points, labels.join(good, "label", "left_semi")).select(F.col("label").alias("to"), "centroid")
    poor = labels.where("label <> -1").join(good, "label", "left_anti")
    moved = points.join(poor, "id").crossJoin(small(c)).withColumn("d", F.round(distance(F.col("embedding").cast("array<double>"), F.col("centroid")), 9))
    moved = moved.groupBy("id").agg(F.min(F.struct("d", "to")).alias("b")).select("id", F.col("b.to").alias("_new"))
    return labels.join(moved, "id", "left").select("id", F.coalesce("_new", "label").alias("label"))


def similar_clusters(points: DataFrame, labels: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b, similarity), a < b: pairs of centroids with a large product."""
    c = centroids(points, labels)
    a, b = c.select(F.col("label").alias("a"), F.col("centroid").alias("ca")), c.select(F.col("label").alias("b"), F.col("centroid").alias("cb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", dot(F.col("ca"), F.col("cb")).alias("similarity")).where(F.col("similarity") > threshold)


def merge_similar_clusters(points: DataFrame, labels: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Larger labels become smaller ones, most similar pairs first; later pairs may overwrite."""
    pairs = similar_clusters(points, labels, threshold).orderBy(F.desc("similarity"), "a", "b").collect()
    target: dict[int, int] = {}
    for r in pairs:
        for k, v in target.items():
            if v == r["b"]:
                target[k] = r["a"]
        target[r["b"]] = r["a"]
    if not target:
        return labels
    table = points.sparkSession.createDataFrame(list(target.items()), "label long, _to long")
    return labels.join(F.broadcast(table), "label", "left").select("id", F.coalesce("_to", F.col("label").cast("long")).alias("label"))


def refine(points: DataFrame, labels: DataFrame, iterations: int = 3, least: float = 0.6, threshold: float = 0.85, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Quality, reassignment and merging, again and again; stops early when nothing changes.

    Over more than ``pair_rows`` points quality goes by cluster_quality_squared.
    """
    labels = cut(labels)
    quality = cluster_quality_squared if points.count() > pair_rows else cluster_quality
    for _ in range(iterations):
        new = cut(merge_similar_clusters(points, reassign_low_quality(points, labels, quality(points, labels), least), threshold))
        if new.join(labels.withColumnRenamed("label", "_o"), "id").where("label <> _o").isEmpty():
            return new
        labels = new
    return labels


def tuning_ks(n: int, grouping: int) -> range:
    low, high = max(2, grouping), min(30, n // grouping, 100)
    return range(low, high + 1, 2 if high - low > 20 else 1)


def combined_score(sweep: DataFrame) -> DataFrame:
    """(k, silhouette, davies_bouldin, score, best): 100 silhouette - 10 DB, the first maximum is best."""
    db = F.when(F.col("davies_bouldin") == float("inf"), 0.0).otherwise(F.col("davies_bouldin"))
    s = sweep.withColumn("score", 100 * F.col("silhouette") - 10 * db)
    top = s.agg(F.max(F.struct("score", (-F.col("k")).alias("m"))).alias("t"))
    return s.crossJoin(top).withColumn("best", -F.col("t.m") == F.col("k")).drop("t")


def tune_embedding_k(points: DataFrame, grouping: int, n_init: int = 10, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """combined_score of K-means for every k of tuning_ks; no row if the users allow no k.

    Over more than ``pair_rows`` points the silhouette is by squared distances, as ``squared`` says.
    """
    rows, n = [], points.count()
    score = silhouette_squared if n > pair_rows else silhouette
    for k in tuning_ks(n, grouping):
        labels = kmeans(points, k, n_init=n_init)[0]
        rows.append((k, float(score(points, labels).first()[0]), float(davies_bouldin(points, labels).first()[0]), n > pair_rows))
    return combined_score(points.sparkSession.createDataFrame(rows, "k long, silhouette double, davies_bouldin double, squared boolean"))
