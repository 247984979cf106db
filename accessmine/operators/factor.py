"""Non-negative factorisation of the user x permission matrix, and roles read off its factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accessmine.functions.arrays import lists
from accessmine.functions.common import cut, ratio, small, vector_sum
from accessmine.operators import spectrum
from accessmine.operators.catalog import dense_index


def spectral_start(rows: DataFrame, p: int, k: int, seed: int = 42) -> np.ndarray:
    """A k x p factor to begin with, from the leading singular vectors of 0/1 rows (user_id, cols).

    Of each pair of vectors, the positive or the negative halves are taken, whichever weigh
    more together, and places that would be zero get the mean of all cells, as
    multiplications could not move them. One pass more than the vectors themselves take
    sums the squares of either half over all users. Directions that the matrix lacks are random.
    """
    ones = rows.select(F.col("cols").cast("array<int>").alias("cols"), F.transform("cols", lambda _: F.lit(1.0)).alias("weights"))
    values, basis = spectrum.leading(ones, p, k, seed)
    found = basis.shape[1]

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, 2 * found + 2))
        for batch in batches:
            cols, weights, start = spectrum.sparse(batch)
            y = spectrum.times(cols, weights, start, basis)
            total += np.concatenate([(np.maximum(y, 0) ** 2).sum(0), (np.minimum(y, 0) ** 2).sum(0), [len(cols), len(y)]])
        yield pa.RecordBatch.from_arrays([lists(total)], names=["s"])

    summed = ones.mapInArrow(halves, "s array<double>").agg(vector_sum("s").alias("s")).first().s
    total = np.zeros(2 * found + 2) if summed is None else summed.toArray()
    mean = total[-2] / max(1.0, total[-1] * p)
    h = np.zeros((k, p))
    for r in range(found):
        plus, minus = np.maximum(basis[:, r], 0), np.maximum(-basis[:, r], 0)
        # the users' vector is what the rows make of this one, shortened by the singular value
        a, b = np.sqrt(total[r]) * np.linalg.norm(plus), np.sqrt(total[found + r]) * np.linalg.norm(minus)
        side, weight = (plus, a) if a >= b else (minus, b)
        if values[r] > 1e-12:
            h[r] = np.sqrt(weight) * side / max(np.linalg.norm(side), 1e-12)
    empty = h.sum(1) == 0
    h[empty] = np.random.default_rng(seed).random((int(empty.sum()), p))
    return np.where(h > 0, h, max(mean, 1e-6))


def nmf(up: DataFrame, k: int, max_iter: int = 60, tol: float = 1e-4, seed: int = 42, loss: str = "frobenius", l1: float = 0.0, l2: float = 0.0, start: str = "random") -> tuple[DataFrame, DataFrame, list[float]]:
    """(W: user_id, role_id, weight), (H: role_id, permission_id, weight), errors by round.

    W stays with the users: each round a task solves its users' rows against the k x P
    factor and gives back only its share of two small sums, which update the factor by
    multiplication. Starting values depend on the seed and ids alone, with start "nndsvda" on
    the matrix (spectral_start).
    """
    if start not in ("random", "nndsvda"):
        raise ValueError(f"no start {start}")
    perms = dense_index(up.select("permission_id").distinct(), "permission_id", "j")
    ids = [r["permission_id"] for r in perms.orderBy("j").collect()]
    p = len(ids)
    if p * k > 50_000_000:
        raise ValueError("the permission side of the factor is too large for one machine")
    rows = up.join(small(perms), "permission_id").groupBy("user_id").agg(F.array_sort(F.collect_set("j")).alias("cols"))
    rows = cut(rows)
    h = np.random.default_rng(seed).random((k, p)) + 0.1 if start == "random" or not p else spectral_start(rows, p, k, seed)
    errors: list[float] = []
    eps = 1e-12

    def solve(cols: list, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(cols), p))
        for i, c in enumerate(cols):
            x[i, np.asarray(c, np.int64)] = 1
        w = np.maximum(x @ h.T, 1e-3) / np.maximum((h * h).sum(1), eps)
        for _ in range(8):
            if loss == "kl":
                w = w * ((x / np.maximum(w @ h, eps)) @ h.T) / np.maximum(h.sum(1) + l1, eps)
            else:
                w = w * (x @ h.T) / np.maximum(w @ (h @ h.T) + l1 + l2 * w, eps)
        return x, w

    for _ in range(max_iter):
        shared = up.sparkSession.sparkContext.broadcast(h)

        def partial(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            h = shared.value
            top, bottom, err = np.zeros((k, p)), np.zeros((k, k)) if loss != "kl" else np.zeros((k, 1)), 0.0
            for pdf in batches:
                for i in range(0, len(pdf), 2000):
                    x, w = solve(pdf["cols"].tolist()[i : i + 2000], h)
                    wh = w @ h
                    err += float(((x - wh) ** 2).sum())
                    if loss == "kl":
                        top += w.T @ (x / np.maximum(wh, eps))
                        bottom += w.sum(0)[:, None]
                    else:
                        top += w.T @ x
                        bottom += w.T @ w
            yield pd.DataFrame({"r": np.arange(k), "top": list(top), "bottom": list(bottom), "err": err})

        sums = rows.mapInPandas(partial, "r int, top array<double>, bottom array<double>, err double")
        # added up on executors: one row for each role comes back, whatever the number of partitions
        summed = sums.groupBy("r").agg(*[vector_sum(c).alias(c) for c in ("top", "bottom")], F.sum("err").alias("err"))
        got = {r["r"]: r for r in summed.collect()}
        if not got:
            break
        top = np.array([got[r]["top"].toArray() for r in range(k)])
        bottom = np.array([got[r]["bottom"].toArray() for r in range(k)])
        errors.append(float(np.sqrt(got[0]["err"])))
        h = h * top / np.maximum(bottom + l1 + l2 * h if loss == "kl" else bottom @ h + l1 + l2 * h, eps)
        shared.unpersist()
        if len(errors) > 1 and errors[-2] - errors[-1] < tol * errors[0]:
            break
    final = up.sparkSession.sparkContext.broadcast(h)

    def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 2000):
                part = pdf.iloc[i : i + 2000]
                w = solve(part["cols"].tolist(), final.value)[1]
                yield pd.DataFrame({"user_id": np.repeat(part["user_id"].to_numpy(), k), "role_id": np.tile(np.arange(k), len(part)), "weight": w.ravel()})

    w = rows.mapInPandas(weights, "user_id long, role_id int, weight double")
    named = np.array(ids, np.int64)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(p, r, np.int32)), pa.array(named), pa.array(final.value[r])], names=["role_id", "permission_id", "weight"])

    factor = up.sparkSession.range(0, k, 1, min(k, 16)).mapInArrow(cells, "role_id int, permission_id long, weight double")
    return w, factor, errors


def dominant_role(w: DataFrame) -> DataFrame:
    """(user_id, role_id) of the largest weight; the lowest role wins ties."""
    best = F.max(F.struct("weight", (-F.col("role_id")).alias("r")))
    return w.groupBy("user_id").agg(best.alias("b")).select("user_id", (-F.col("b.r")).alias("role_id"))


def role_definitions(h: DataFrame, top: int = 10) -> DataFrame:
    """(role_id, permissions, total_weight): positive weights, the largest first."""
    rank = F.row_number().over(Window.partitionBy("role_id").orderBy(F.desc("weight"), "permission_id"))
    best = h.where("weight > 0").withColumn("r", rank).where(F.col("r") <= top)
    return best.groupBy("role_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "permission_id"))), lambda s: s["permission_id"]).alias("permissions"), F.sum("weight").alias("total_weight"))


def role_top_permissions(h: DataFrame, perms: DataFrame, apps: DataFrame, n: int = 10) -> DataFrame:
    """(role_id, rank, permission_id, perm_name, app_name, weight) of the n largest weights."""
    rank = F.row_number().over(Window.partitionBy("role_id").orderBy(F.desc("weight"), "permission_id"))
    best = h.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)
    out = best.join(small(perms), "permission_id", "left").join(small(apps), "application_id", "left")
    return out.select("role_id", "rank", "permission_id", "perm_name", "app_name", "weight")


def dominant_apps(top: DataFrame, n: int = 4) -> DataFrame:
    """(role_id, apps): the first distinct application names in order of rank."""
    first = top.where("app_name is not null").groupBy("role_id", "app_name").agg(F.min("rank").alias("rank"))
    r = F.row_number().over(Window.partitionBy("role_id").orderBy("rank"))
    first = first.withColumn("r", r).where(F.col("r") <= n)
    return first.groupBy("role_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "app_name"))), lambda s: s["app_name"]), ", ").alias("apps"))


def user_roles(w: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(user_id, roles): roles over the threshold by weight; empty without a dominant one."""
    over = F.filter(F.reverse(F.array_sort(F.collect_list(F.struct("weight", (-F.col("role_id")).alias("r"))))), lambda s: s["weight"] > threshold)
    return w.groupBy("user_id").agg(F.transform(over, lambda s: -s["r"]).alias("roles"))


def multi_role_labels(w: DataFrame, threshold: float = 0.15) -> DataFrame:
    """(user_id, role_id, share) of roles with more than the threshold of a user's weight."""
    total = F.sum("weight").over(Window.partitionBy("user_id"))
    return w.withColumn("share", ratio(F.col("weight"), total)).where(F.col("share") > threshold).select("user_id", "role_id", "share")


def role_distribution(labels: DataFrame, users: DataFrame, rare: float = 1.0) -> DataFrame:
    """(role_id, n, pct, too_rare); pct of all users."""
    n = users.agg(F.count(F.lit(1)).alias("_n"))
    out = labels.groupBy("role_id").agg(F.countDistinct("user_id").alias("n")).crossJoin(F.broadcast(n)).withColumn("pct", 100 * F.col("n") / F.col("_n"))
    return out.select("role_id", "n", "pct", (F.col("pct") < rare).alias("too_rare"))


def active_permissions(h: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(role_id, permissions, n) with a weight over the threshold."""
    return h.where(F.col("weight") > threshold).groupBy("role_id").agg(F.array_sort(F.collect_set("permission_id")).alias("permissions")).withColumn("n", F.size("permissions").cast("long"))


def reconstruction_quality(up: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """mse and accuracy (at 0.5) over all cells of users in w and permissions in h.

    The squared error is |X|^2 - 2 <X, WH> + <W'W, HH'>: the last from two sums of k x k
    numbers, the others in the pass over the users' rows that counts the right cells. That
    pass makes a block of users' rows of WH at a time, so no cell is ever a row.
    """
    spark = up.sparkSession
    roles = {r[0]: x for x, r in enumerate(h.select("role_id").union(w.select("role_id")).distinct().orderBy("role_id").collect())}
    perms = cut(dense_index(h.select("permission_id").distinct(), "permission_id", "j"))
    k, p = len(roles), perms.count()
    if k * p > spectrum.BASIS_CELLS:
        raise ValueError(f"{k} roles of {p} permissions are over {spectrum.BASIS_CELLS} numbers")
    side = np.zeros((k, p))
    got = h.join(small(perms), "permission_id").groupBy("role_id", "j").agg(F.sum("weight").alias("weight")).toArrow()
    side[[roles[r] for r in got["role_id"].to_pylist()], got["j"].to_numpy()] = got["weight"].to_numpy()
    shared = spark.sparkContext.broadcast(side)
    users = w.groupBy("user_id").agg(F.collect_list(F.struct(F.col("role_id").cast("int").alias("r"), "weight")).alias("w"))
    held = up.join(small(perms), "permission_id").groupBy("user_id").agg(F.collect_set(F.col("j").cast("int")).alias("cols"))
    rows = users.join(held, "user_id", "left").select(F.col("w.r").alias("r"), F.col("w.weight").alias("weight"), F.coalesce("cols", F.array().cast("array<int>")).alias("cols"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, total = shared.value, np.zeros(3)
        inner = h @ h.T
        place = np.full(max(roles, default=0) + 1, -1)
        place[list(roles)] = list(roles.values())
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                own = np.zeros((part.num_rows, k))
                lengths = part.column("r").value_lengths().to_numpy(zero_copy_only=False)
                np.add.at(own, (np.repeat(np.arange(len(own)), lengths), place[part.column("r").flatten().to_numpy(zero_copy_only=False)]), part.column("weight").flatten().to_numpy(zero_copy_only=False))
                at = np.repeat(np.arange(len(own)), part.column("cols").value_lengths().to_numpy(zero_copy_only=False))
                cols = part.column("cols").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                y = own @ h
                over = y > 0.5
                hits = over[at, cols]
                # cells below 0.5 are right where nothing is held, those above where something is
                total += [len(cols) - 2 * y[at, cols].sum() + ((own @ inner) * own).sum(), (~over).sum() - (~hits).sum() + hits.sum(), len(own) * p]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.tolist()], names=["e", "right", "n"])

    out = rows.mapInArrow(sums, "e double, right double, n double").agg(F.sum("e").alias("e"), F.sum("right").alias("right"), F.sum("n").alias("n"))
    return out.select(F.try_divide("e", "n").alias("mse"), F.try_divide("right", "n").alias("accuracy"))


def tune_components(up: DataFrame, most: int = 15, default: int = 8, max_iter: int = 15) -> tuple[DataFrame, int]:
    """(k, error, silhouette) for k from 2, and the k with the best positive silhouette (else the default)."""
    from accessmine.operators.clustering import vectors
    from accessmine.operators.metrics import silhouette

    up = cut(up.select("user_id", "permission_id").distinct())
    points = cut(vectors(up))
    n, p = points.count(), up.select("permission_id").distinct().count()
    rows = []
    for k in range(2, min(most, n - 1, p - 1) + 1):
        w, _, errors = nmf(up, k, max_iter)
        labels = cut(dominant_role(w).select(F.col("user_id").alias("id"), F.col("role_id").alias("label")))
        rows.append((k, errors[-1], silhouette(points, labels).first()[0]))
    best = max(rows, key=lambda r: (r[2], -r[0]), default=(default, 0, 0))
    return up.sparkSession.createDataFrame(rows, "k int, error double, silhouette double"), best[0] if best[2] > 0 else default
