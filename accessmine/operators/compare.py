"""Models side by side, and which to take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_models(results: dict[str, DataFrame]) -> DataFrame:
    """One row for each model from its one-row metrics; columns that a model lacks are null."""
    rows = [df.withColumn("model", F.lit(name)).withColumn("ord", F.lit(i).cast("long")) for i, (name, df) in enumerate(results.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def recommend_model(metrics: DataFrame) -> DataFrame:
    """(best_silhouette, most_balanced, balance) of (model, ord, num_roles, noise_pct, silhouette); the first wins ties."""
    balance = 100 * F.col("silhouette") + (100 - F.col("noise_pct")) + F.greatest(F.lit(0), 20 - F.abs(F.col("num_roles") - 10))
    m = metrics.withColumn("balance", balance)
    first = lambda c: F.max(F.struct(c, (-F.col("ord")).alias("o"), "model"))
    return m.agg(first("silhouette").alias("s"), first("balance").alias("b")).select(F.col("s.model").alias("best_silhouette"), F.col("b.model").alias("most_balanced"), F.col("b.balance").alias("balance"))
