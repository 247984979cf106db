"""Scores of clusterings, roles, predictions and grants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessmine.functions.arrays import matrix
from accessmine.functions.common import cut, distance, jaccard, ratio, small, squared, vector_sum
from accessmine.operators import sweep

#: Points of a block; rows and columns of one matrix product.
BLOCK, STRIP, TILE = 1024, 256, 2048
#: Points up to which sums over all pairs are the default; beyond them, sums by cluster.
PAIR_ROWS = 20_000
#: Numbers (clusters x dimensions) that go to every task at most.
MOMENT_CELLS = 20_000_000


def centroids(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, centroid, size) of points (id, embedding), labels (id, label), noise left out."""
    long = points.join(labels.where("label <> -1"), "id").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = long.groupBy("label", "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("size"))
    return mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"), F.max("size").alias("size"))


def _with_centroid(points: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    c = centroids(points, labels)
    rows = points.join(labels.where("label <> -1"), "id").join(small(c), "label")
    return rows.withColumn("d", distance(F.col("embedding").cast("array<double>"), F.col("centroid"))), c


def _distinct(points: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bx, id, embedding, own, weight), equal points of a cluster as one named by the least id, in blocks by label; (id, first), who stands for whom.

    Rows of one block have neighbouring labels, so that a part of the blocks has few.
    """
    rows = points.join(labels.where("label <> -1"), "id").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("own"))
    named = rows.groupBy("own", "embedding").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    named = cut(named)
    blocks = max(1, -(-named.count() // BLOCK))
    dealt = named.repartitionByRange(blocks, "own", "id").sortWithinPartitions("own", "id").withColumn("bx", F.spark_partition_id())
    first = rows.join(named.select(F.col("id").alias("first"), "own", "embedding"), ["own", "embedding"]).select("id", "first")
    return cut(dealt), first


def _packed(table: pa.Table) -> dict[str, np.ndarray]:
    table = table.sort_by([("own", "ascending"), ("id", "ascending")])
    x = matrix(table["embedding"])
    own = table["own"].to_numpy()
    head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return {"x": x, "q": (x * x).sum(1), "own": own, "id": table["id"].to_numpy(), "weight": table["weight"].to_numpy().astype(float), "head": head}


def _point_cells() -> Column:
    return F.lit(40) + 8 * F.size("embedding")


def _distance_totals(rows: DataFrame, same: bool) -> DataFrame:
    """(id, own, label, total, n): weighted sums of distances from each row of _distinct to each cluster, to its own alone with ``same``."""
    kinds = {"id": pa.int64(), "own": pa.int64(), "label": pa.int64(), "total": pa.float64(), "n": pa.int64()}

    def task(sent: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(sent["own"]):
            return
        names, head = sent["own"][sent["head"]], sent["head"]
        tail = np.append(head[1:], len(sent["own"]))
        n = np.add.reduceat(sent["weight"], head).astype(np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, own, x = batch.column("id").to_numpy(), batch.column("own").to_numpy(), matrix(batch.column("embedding"))
            for i in range(0, len(x), STRIP):
                k = min(i + STRIP, len(x))
                q = (x[i:k] * x[i:k]).sum(1)
                mine = np.isin(names, own[i:k]) if same else np.ones(len(names), bool)
                for c in np.flatnonzero(mine):
                    total = np.zeros(k - i)
                    for j in range(head[c], tail[c], TILE):
                        e = min(j + TILE, tail[c])
                        d = q[:, None] + sent["q"][j:e] - 2 * x[i:k] @ sent["x"][j:e].T
                        d = np.sqrt(np.maximum(d, 0, out=d), out=d)
                        if np.isin(names[c], own[i:k]):
                            d[ids[i:k, None] == sent["id"][j:e]] = 0
                        total += d @ sent["weight"][j:e]
                    at = own[i:k] == names[c] if same else np.ones(k - i, bool)
                    yield from sweep.batched(kinds, [ids[i:k][at], own[i:k][at], np.full(at.sum(), names[c]), total[at], np.full(at.sum(), n[c])])

    found = sweep.against(rows, rows.select("bx", "id", "embedding", "own", "weight"), _point_cells(), _packed, task, "id long, own long, label long, total double, n long")
    return found.groupBy("id", "own", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def distance_sums(points: DataFrame, labels: DataFrame, same: bool = False) -> DataFrame:
    """(id, own, label, total, n): sums of distances from each point to each cluster, to its own alone with ``same``.

    Equal points of a cluster are compared once. One side of the comparison goes to the tasks
    in parts of bounded size, the other stays where it is, and nothing but sums leaves a task.
    """
    rows, first = _distinct(points, labels)
    sums = _distance_totals(rows, same).withColumnRenamed("id", "first")
    return first.join(sums, "first").select("id", "own", "label", "total", "n")


def _silhouettes(sums: DataFrame) -> DataFrame:
    same = F.col("label") == F.col("own")
    per = sums.groupBy("id").agg(
        F.max(F.when(same, F.col("n"))).alias("size"),
        F.max(F.when(same & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"),
    )
    s = F.when((F.col("size") > 1) & F.col("b").isNotNull(), ratio(F.col("b") - F.col("a"), F.greatest("a", "b"))).otherwise(0.0)
    return per.select("id", s.alias("silhouette"))


def silhouette_points(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, silhouette), unsquared Euclidean; members of one-point clusters have 0."""
    return _silhouettes(distance_sums(points, labels))


def silhouette(points: DataFrame, labels: DataFrame) -> DataFrame:
    """One row; 0 with fewer than two clusters."""
    n = labels.where("label <> -1").agg(F.countDistinct("label").alias("k"))
    rows, _ = _distinct(points, labels)
    scored = _silhouettes(_distance_totals(rows, False)).join(rows.select("id", "weight"), "id")
    mean = scored.agg((F.sum(F.col("silhouette") * F.col("weight")) / F.sum("weight")).alias("s"))
    return mean.crossJoin(n).select(F.when(F.col("k") > 1, F.col("s")).otherwise(0.0).alias("silhouette"))


def moments(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n, total, squares): each cluster's points, their sum and the sum of their squared lengths; noise left out."""
    e = F.col("embedding").cast("array<double>")
    rows = points.join(labels.where("label <> -1"), "id").select("label", e.alias("embedding"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), vector_to_array(vector_sum("embedding")).alias("total"), F.sum(squared(F.col("embedding"))).alias("squares"))


def silhouette_squared_points(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, silhouette) by squared Euclidean distances, in time linear in the points.

    The mean squared distance of a point x to a cluster of n points with sum t and squared
    lengths q is |x|^2 - 2 x.t/n + q/n, so two passes do: one for the clusters' sums, which
    go to every task (MOMENT_CELLS numbers at most, else an error), one for the points.
    Points that lie alone in their cluster have 0, and so has everything with one cluster.
    """
    found = moments(points, labels)
    size = found.agg(F.count(F.lit(1)).alias("k"), F.max(F.size("total")).alias("d")).first()
    if size.k * (size.d or 0) > MOMENT_CELLS:
        raise ValueError(f"{size.k} clusters of {size.d} dimensions are over {MOMENT_CELLS} numbers")
    found = sorted(found.collect(), key=lambda r: r.label)
    names, n = np.array([r.label for r in found], np.int64), np.array([r.n for r in found], float)
    total = np.array([r.total for r in found]).reshape(len(found), size.d or 0)
    # around the mean, as far from it differences of large numbers lose digits
    middle = total.sum(0) / max(1.0, n.sum())
    squares = np.array([r.squares for r in found]) - 2 * total @ middle + n * (middle @ middle)
    total = total - n[:, None] * middle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("embedding")) - middle
            own = np.searchsorted(names, batch.column("label").to_numpy())
            d = np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ (total / n[:, None]).T + squares / n)
            rows = np.arange(len(x))
            a = d[rows, own] * n[own] / np.maximum(1, n[own] - 1)
            d[rows, own] = np.inf
            b = d.min(axis=1)
            top = np.maximum(a, b)
            some = (n[own] > 1) & np.isfinite(b) & (top > 0)
            s = np.where(some, (b - a) / np.where(some, top, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s)], names=["id", "silhouette"])

    rows = points.join(labels.where("label <> -1"), "id")
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "id long, silhouette double")


def silhouette_squared(points: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, as silhouette by squared distances; 0 with fewer than two clusters or no points."""
    return silhouette_squared_points(points, labels).agg(F.coalesce(F.avg("silhouette"), F.lit(0.0)).alias("silhouette_squared"))


def sweep_scores(points: DataFrame, labelled: dict[int, DataFrame]) -> DataFrame:
    """(k, inertia, silhouette, davies_bouldin) of several labelings (id, label) of the same points, by k.

    Inertia is the sum of squared distances to centroids; the silhouette is by squared
    distances, so every labeling takes passes over the points but no pairs of them.
    """
    out = None
    for k, labels in labelled.items():
        spread = _with_centroid(points, labels)[0].agg(F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0)).alias("inertia"))
        row = spread.crossJoin(silhouette_squared(points, labels)).crossJoin(davies_bouldin(points, labels))
        row = row.select(F.lit(k).cast("long").alias("k"), "inertia", F.col("silhouette_squared").alias("silhouette"), "davies_bouldin")
        out = row if out is None else out.unionByName(row)
    return out


def davies_bouldin(points: DataFrame, labels: DataFrame) -> DataFrame:
    """One row; infinite with fewer than two clusters."""
    rows, c = _with_centroid(points, labels)
    s = rows.groupBy("label").agg(F.avg("d").alias("s")).join(c, "label")
    x, y = s.select(F.col("label").alias("i"), F.col("s").alias("si"), F.col("centroid").alias("ci")), s.select(F.col("label").alias("j"), F.col("s").alias("sj"), F.col("centroid").alias("cj"))
    r = x.join(y, F.col("i") != F.col("j")).withColumn("r", ratio(F.col("si") + F.col("sj"), distance(F.col("ci"), F.col("cj"))))
    out = r.groupBy("i").agg(F.max("r").alias("r")).agg(F.avg("r").alias("x"))
    return out.select(F.coalesce("x", F.lit(float("inf"))).alias("davies_bouldin"))


def calinski_harabasz(points: DataFrame, labels: DataFrame) -> DataFrame:
    """One row; 0 with fewer than two clusters."""
    rows, c = _with_centroid(points, labels)
    within = rows.agg(F.sum(F.col("d") * F.col("d")).alias("w"), F.count(F.lit(1)).alias("n"))
    long = c.select("size", F.posexplode("centroid").alias("i", "x"))
    mean = long.groupBy("i").agg((F.sum(F.col("x") * F.col("size")) / F.sum("size")).alias("m"))
    between = long.join(F.broadcast(mean), "i").agg(F.sum(F.col("size") * (F.col("x") - F.col("m")) ** 2).alias("b"))
    out = between.crossJoin(within).crossJoin(c.agg(F.count(F.lit(1)).alias("k")))
    return out.select(F.when((F.col("k") > 1) & (F.col("w") > 0), (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).otherwise(0.0).alias("calinski_harabasz"))


def coverage_metrics(labels: DataFrame, roles: DataFrame) -> DataFrame:
    """num_roles, num_noise, noise_pct, user_coverage_pct for (user_id, effective_label)."""
    noise = labels.agg(F.count_if(F.col("effective_label") == -1).alias("num_noise"), F.count(F.lit(1)).alias("n"))
    out = roles.agg(F.count(F.lit(1)).alias("num_roles")).crossJoin(noise)
    pct = 100 * ratio(F.col("num_noise"), F.col("n"))
    return out.select("num_roles", "num_noise", pct.alias("noise_pct"), (100 - pct).alias("user_coverage_pct"))


def role_metrics(roles: DataFrame) -> DataFrame:
    a = [F.avg("size").alias("avg_size"), F.stddev_pop("size").alias("std_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size")]
    b = [f(c).alias(f"{n}_{c}") for c in ("permission_count", "cohesion", "coverage") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return roles.agg(*a, *b)


def role_overlap(role_perms: DataFrame) -> DataFrame:
    """Mean Jaccard over all pairs of roles that have permissions; 0 with fewer than two."""
    sizes = role_perms.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    x, y = role_perms.select(F.col("role").alias("a"), "permission_id"), role_perms.select(F.col("role").alias("b"), "permission_id")
    both = x.join(y, "permission_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    sim = both.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").agg(F.sum(jaccard(F.col("both"), F.col("na"), F.col("nb"))).alias("s"))
    k = sizes.agg(F.count(F.lit(1)).alias("k"))
    return sim.crossJoin(k).select(ratio(F.coalesce("s", F.lit(0.0)), F.col("k") * (F.col("k") - 1) / 2).alias("role_overlap"))


def permission_compression(roles: DataFrame, role_perms: DataFrame, n_permissions: DataFrame) -> DataFrame:
    """system_coverage, unique_role_permissions, compression; n_permissions: one row (n)."""
    a = roles.agg(ratio(F.sum("permission_count"), F.sum("original_permissions")).alias("system_coverage"))
    b = role_perms.agg(F.countDistinct("permission_id").alias("unique_role_permissions"))
    return a.crossJoin(b).crossJoin(n_permissions).select("system_coverage", "unique_role_permissions", (1 - F.col("unique_role_permissions") / F.col("n")).alias("compression"))


def multilabel_counts(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(label, tp, fp, fn) of long tables (id, label)."""
    a, b = truth.select("id", "label", F.lit(1).alias("t")), predicted.select("id", "label", F.lit(1).alias("p"))
    both = a.join(b, ["id", "label"], "full").na.fill(0, ["t", "p"])
    t, p = F.col("t"), F.col("p")
    return both.groupBy("label").agg(F.sum(t * p).alias("tp"), F.sum((1 - t) * p).alias("fp"), F.sum(t * (1 - p)).alias("fn"))


def per_label_scores(counts: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def multilabel_metrics(truth: DataFrame, predicted: DataFrame, ids: DataFrame, n_labels: int) -> DataFrame:
    """subset accuracy, Hamming loss, macro F1, micro precision, recall and F1 over all ids."""
    counts = multilabel_counts(truth, predicted)
    total = counts.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    macro = per_label_scores(counts).agg((F.sum("f1") / n_labels).alias("f1_macro"))
    wrong = truth.select("id", "label").exceptAll(predicted.select("id", "label")).unionByName(predicted.select("id", "label").exceptAll(truth.select("id", "label"))).select("id").distinct().agg(F.count(F.lit(1)).alias("w"))
    out = total.crossJoin(macro).crossJoin(wrong).crossJoin(ids.agg(F.count(F.lit(1)).alias("n")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select((1 - F.col("w") / F.col("n")).alias("subset_accuracy"), ((fp + fn) / (F.col("n") * n_labels)).alias("hamming_loss"), "f1_macro", ratio(tp, tp + fp).alias("precision_micro"), ratio(tp, tp + fn).alias("recall_micro"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1_micro"))


def provisioning_rates(pred: DataFrame, threshold: float = 0.45) -> DataFrame:
    """(y, p) rows: confusion counts at p >= threshold, over- and under-provisioning rates."""
    y, g = F.col("y") == 1, F.col("p") >= threshold
    c = pred.agg(F.count_if(~y & ~g).alias("tn"), F.count_if(~y & g).alias("fp"), F.count_if(y & ~g).alias("fn"), F.count_if(y & g).alias("tp"))
    return c.withColumn("over_rate", ratio(F.col("fp"), F.col("fp") + F.col("tn"))).withColumn("under_rate", ratio(F.col("fn"), F.col("fn") + F.col("tp")))


def provisioning_gap(up: DataFrame, granted_role: DataFrame, role_perms: DataFrame) -> DataFrame:
    """(user_id, over, under) of users (user_id, role) granted their role's permissions."""
    real = up.join(granted_role.select("user_id"), "user_id", "left_semi").select("user_id", "permission_id", F.lit(1).alias("r"))
    given = granted_role.join(small(role_perms.select("role", "permission_id")), "role").select("user_id", "permission_id", F.lit(1).alias("g")).distinct()
    both = real.join(given, ["user_id", "permission_id"], "full").na.fill(0, ["r", "g"])
    r, g = F.col("r"), F.col("g")
    per = both.groupBy("user_id").agg(ratio(F.sum(g * (1 - r)), F.sum(g)).alias("over"), ratio(F.sum(r * (1 - g)), F.sum(r)).alias("under"))
    return granted_role.select("user_id").join(per, "user_id", "left").na.fill(0.0, ["over", "under"])
