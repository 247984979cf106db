"""Profile of a rights table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessmine.functions.common import jaccard, ratio

ATTRIBUTES = ("position", "department", "location", "contract_type", "seniority")


def _beside(*rows: DataFrame) -> DataFrame:
    """One-row frames as one row."""
    return reduce(lambda a, b: a.crossJoin(b), rows)


def basic_stats(users: DataFrame, apps: DataFrame, perms: DataFrame, rights: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return _beside(n(users, "n_users"), n(apps, "n_applications"), n(perms, "n_permissions"), n(rights, "n_rights"))


def matrix_metrics(basic: DataFrame) -> DataFrame:
    most = F.col("n_users") * F.col("n_permissions")
    density = 100 * ratio(F.col("n_rights"), most)
    return basic.select(most.alias("max_possible"), density.alias("density"), (100 - density).alias("sparsity"), ratio(most, F.col("n_rights")).alias("compression_ratio"))


def _spread(x: str) -> list[Column]:
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [F.avg(x).alias("mean"), q[1].alias("median"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), q[0].alias("q1"), q[2].alias("q3")]


def perms_per_user_stats(rights: DataFrame) -> DataFrame:
    """Of users who hold any right."""
    counts = rights.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(*_spread("n"), (100 * F.stddev_samp("n") / F.avg("n")).alias("cv"), F.skewness("n").alias("skewness"), F.kurtosis("n").alias("kurtosis"), F.count(F.lit(1)).alias("users"))


def normality(per_user: DataFrame) -> DataFrame:
    """Jarque-Bera on the shape of :func:`perms_per_user_stats`."""
    jb = F.col("users") / 6 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4)
    return per_user.select(F.exp(-jb / 2).alias("p_value")).withColumn("is_normal", F.col("p_value") >= 0.05)


def users_per_perm_stats(rights: DataFrame, perms: DataFrame) -> DataFrame:
    """Holders of each permission in use; rare and common as shares of all permissions."""
    counts = rights.groupBy("permission_id").agg(F.count(F.lit(1)).alias("n"))
    spread = counts.agg(*_spread("n"))
    both = counts.crossJoin(F.broadcast(spread.select("q1", "q3"))).agg(F.count_if(F.col("n") < F.col("q1")).alias("rare"), F.count_if(F.col("n") > F.col("q3")).alias("common"))
    n = perms.agg(F.count(F.lit(1)).alias("_n"))
    return _beside(spread, both, n).withColumn("rare_pct", 100 * F.col("rare") / F.col("_n")).withColumn("common_pct", 100 * F.col("common") / F.col("_n")).drop("_n")


def attribute_distributions(users: DataFrame, columns: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """(attribute, value, n, pct, rank): rank by count, then value."""
    long = users.select("user_id", *columns).unpivot("user_id", list(columns), "attribute", "value")
    counts = long.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("attribute")
    counts = counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(own))
    return counts.withColumn("rank", F.row_number().over(own.orderBy(F.desc("n"), "value")).cast("long"))


def sampled_similarity(up: DataFrame, sample: int = 1000, first: int = 500, pairs_per_user: int = 20, seed: int | None = None) -> DataFrame:
    """Jaccard of the first users with the next ones in the sample's order.

    With a seed the sample and its order go by a hash of the id, so that ids which follow
    hiring dates or departments don't matter; without one, by the id itself. Sets are built
    for the users drawn alone.
    """
    order = [] if seed is None else [F.md5(F.concat(F.lit(f"{seed}-"), F.col("user_id").cast("string")))]
    drawn = up.select("user_id").distinct().orderBy(*order, "user_id").limit(sample)
    drawn = drawn.withColumn("i", F.row_number().over(Window.orderBy(*order, "user_id")).cast("long"))
    top = up.join(F.broadcast(drawn), "user_id").groupBy("user_id", "i").agg(F.collect_set("permission_id").alias("p"))
    a, b = top.select(F.col("i").alias("ia"), F.col("p").alias("pa")), top.select(F.col("i").alias("ib"), F.col("p").alias("pb"))
    near = a.where(F.col("ia") <= first).withColumn("ib", F.explode(F.sequence(F.col("ia") + 1, F.col("ia") + pairs_per_user - 1))).join(b, "ib")
    both = F.size(F.array_intersect("pa", "pb"))
    s = near.select(jaccard(both, F.size("pa"), F.size("pb")).alias("s"))
    q = F.percentile("s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return s.agg(F.avg("s").alias("mean"), q[1].alias("median"), F.stddev_pop("s").alias("std"), F.min("s").alias("min"), F.max("s").alias("max"), q[0].alias("q1"), q[2].alias("q3"), F.count("s").alias("pairs"))


def entropy_metrics(rights: DataFrame) -> DataFrame:
    counts = rights.groupBy("permission_id").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    p = F.col("n") / F.col("t")
    e = counts.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.log2(p + 1e-10))).alias("entropy"), F.log2(F.max("k")).alias("max_entropy"))
    return e.withColumn("normalized_entropy", ratio(F.col("entropy"), F.col("max_entropy")))


def gini(counts: DataFrame, column: str = "n") -> DataFrame:
    """The published coefficient (with its reversed sign) and the usual one.

    Ranks come from the histogram of values: a value held m times after r others
    contributes value * (m * (n - r) - m * (m - 1) / 2).
    """
    hist = counts.groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("m"))
    hist = hist.withColumn("r", F.sum("m").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"))
    total = hist.agg(F.sum("m").alias("n"), F.sum(F.col("x") * F.col("m")).alias("s"))
    part = F.col("x") * (F.col("m") * (F.col("n") - F.col("r")) - F.col("m") * (F.col("m") - 1) / 2)
    g = hist.crossJoin(F.broadcast(total)).agg((2 * F.sum(part) / F.max(F.col("n") * F.col("s")) - F.max((F.col("n") + 1) / F.col("n"))).alias("g"))
    return g.select(F.col("g").alias("gini_coefficient"), (-F.col("g")).alias("gini"))


def application_stats(rights: DataFrame, perms: DataFrame, apps: DataFrame) -> DataFrame:
    per = rights.groupBy("application_id").agg(F.countDistinct("user_id").alias("n"))
    all_ = apps.agg(F.count(F.lit(1)).alias("total_apps"))
    used = per.agg(F.count(F.lit(1)).alias("used_apps"), F.avg("n").alias("mean_users"), F.percentile("n", F.lit(0.5)).alias("median_users"), F.stddev_samp("n").alias("std_users"), F.min("n").alias("min_users"), F.max("n").alias("max_users"))
    per_app = perms.groupBy("application_id").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("mean_perms"))
    return _beside(used, all_, per_app).withColumn("unused_apps", F.col("total_apps") - F.col("used_apps"))


def statistical_summary(users: DataFrame, apps: DataFrame, perms: DataFrame, rights: DataFrame) -> DataFrame:
    """All figures in one row, with prefixes."""
    named = lambda df, prefix: df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])
    basic = basic_stats(users, apps, perms, rights)
    up = rights.select("user_id", "permission_id").distinct()
    counts = rights.groupBy("permission_id").agg(F.count(F.lit(1)).alias("n"))
    return _beside(
        basic,
        named(matrix_metrics(basic), "matrix_"),
        named(perms_per_user_stats(rights), "perms_per_user_"),
        named(users_per_perm_stats(rights, perms), "users_per_perm_"),
        named(sampled_similarity(up, seed=42), "similarity_"),
        entropy_metrics(rights),
        gini(counts),
        named(application_stats(rights, perms, apps), "app_"),
    )
