"""Checks of an access-rights data set, each a row (suite, name, passed, value, threshold)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessmine.functions.common import ratio
from accessmine.operators.stats import ATTRIBUTES

#: Shares of the suites in the overall score: they sum to 0.85, and as published are not normalised.
WEIGHTS = {"completeness": 0.25, "business_rules": 0.20, "ai_readiness": 0.25, "patterns": 0.15}
LIMITS = {"min_users": 5000, "min_rights": 10000, "consistency": 0.7, "richness": 20, "balance": 0.01, "entropy": 1.0, "cv_low": 0.3, "cv_high": 1.0, "sparsity": 0.99, "ready": 70}


def missing_values(df: DataFrame) -> DataFrame:
    """Null cells of the whole table, as one row."""
    cells = [F.count_if(F.col(c).isNull()) for c in df.columns]
    return df.agg(reduce(lambda a, b: a + b, cells).alias("missing"))


def foreign_key_errors(rights: DataFrame, keys: dict[str, DataFrame]) -> DataFrame:
    """(key, bad_rows): rows whose id is null or unknown; keys that rights lacks are skipped."""
    rows = [rights.join(known.select(k).distinct(), k, "left_anti").agg(F.count(F.lit(1)).alias("bad_rows")).select(F.lit(k).alias("key"), "bad_rows") for k, known in keys.items() if k in rights.columns]
    return reduce(DataFrame.unionByName, rows)


def users_without_badge(users: DataFrame, apps: DataFrame, perms: DataFrame, rights: DataFrame) -> DataFrame:
    """Users who don't hold access_building of the badge system of their own location."""
    badge = apps.join(perms.where("perm_name = 'access_building'"), "application_id").groupBy("app_name").agg(F.min(F.struct("application_id", "permission_id")).alias("k"))
    need = users.withColumn("app_name", F.concat(F.lit("Access Badge System - "), "location")).join(badge, "app_name", "left")
    need = need.select("user_id", "location", F.col("k.application_id").alias("application_id"), F.col("k.permission_id").alias("permission_id"))
    return need.join(rights, ["user_id", "application_id", "permission_id"], "left_anti").select("user_id", "location")


def department_consistency(users: DataFrame, rights: DataFrame, least: int = 3) -> DataFrame:
    """(department, users, consistency): rows of the commonest right over users, in departments with enough users."""
    size = users.groupBy("department").agg(F.count(F.lit(1)).alias("users")).where(F.col("users") >= least)
    held = rights.join(users.select("user_id", "department"), "user_id").groupBy("department", "application_id", "permission_id").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy("department").agg(F.max("n").alias("n")).join(size, "department").select("department", "users", (F.col("n") / F.col("users")).alias("consistency"))


def feature_richness(users: DataFrame) -> DataFrame:
    """Distinct values of all attributes together; null counts as a value."""
    each = [F.countDistinct(c) + F.max(F.col(c).isNull().cast("int")) for c in ATTRIBUTES]
    return users.agg(reduce(lambda a, b: a + b, each).alias("richness"))


def class_balance(users: DataFrame) -> DataFrame:
    return users.groupBy("position").agg(F.count(F.lit(1)).alias("n")).agg((F.min("n") / F.max("n")).alias("balance"))


def permission_entropy(rights: DataFrame) -> DataFrame:
    """Entropy (natural) of the distribution of rights per user; 0 without rights."""
    hist = rights.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    total = hist.agg(F.sum("m").alias("t"))
    p = F.col("m") / F.col("t")
    return hist.crossJoin(F.broadcast(total)).agg(F.coalesce(-F.sum(p * F.log(p)), F.lit(0.0)).alias("entropy"))


def variation(rights: DataFrame) -> DataFrame:
    return rights.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg((F.stddev_samp("n") / F.avg("n")).alias("cv"))


def seniority_rates(users: DataFrame, rights: DataFrame) -> DataFrame:
    """(seniority, rate): rights rows for each user who has any."""
    held = rights.join(users.select("user_id", "seniority"), "user_id")
    return held.groupBy("seniority").agg((F.count(F.lit(1)) / F.countDistinct("user_id")).alias("rate"))


def sparsity(users: DataFrame, perms: DataFrame, rights: DataFrame) -> DataFrame:
    n = lambda df, x: df.agg(F.count(F.lit(1)).alias(x))
    return n(users, "u").crossJoin(n(perms, "p")).crossJoin(n(rights, "r")).select((1 - ratio(F.col("r"), F.col("u") * F.col("p"))).alias("sparsity"))


def checks(users: DataFrame, apps: DataFrame, perms: DataFrame, rights: DataFrame, limits: dict | None = None) -> DataFrame:
    """(suite, ord, name, passed, value) of all checks."""
    lim = LIMITS | (limits or {})
    out: list[DataFrame] = []

    def add(suite: str, name: str, df: DataFrame, value: Column, passed: Column) -> None:
        out.append(df.select(F.lit(suite).alias("suite"), F.lit(len(out)).cast("long").alias("ord"), F.lit(name).alias("name"), passed.alias("passed"), value.cast("double").alias("value")))

    for label, df in (("users", users), ("applications", apps), ("permissions", perms), ("rights", rights)):
        add("completeness", f"missing_{label}", missing_values(df), F.col("missing"), F.col("missing") == 0)
    for key, df in (("user_id", users), ("application_id", apps), ("permission_id", perms)):
        add("completeness", f"fk_{key}", foreign_key_errors(rights, {key: df}), F.col("bad_rows"), F.col("bad_rows") == 0)
    for label, df in (("users", users), ("rights", rights)):
        add("completeness", f"volume_{label}", df.agg(F.count(F.lit(1)).alias("n")), F.col("n"), F.col("n") >= lim[f"min_{label}"])
    add("business_rules", "badge_by_location", users_without_badge(users, apps, perms, rights).agg(F.count(F.lit(1)).alias("n")), F.col("n"), F.col("n") == 0)
    add("business_rules", "department_consistency", department_consistency(users, rights).agg(F.avg("consistency").alias("x")), F.col("x"), F.coalesce(F.col("x") >= lim["consistency"], F.lit(False)))
    add("ai_readiness", "feature_richness", feature_richness(users), F.col("richness"), F.col("richness") >= lim["richness"])
    add("ai_readiness", "class_balance", class_balance(users), F.col("balance"), F.col("balance") >= lim["balance"])
    add("ai_readiness", "permission_entropy", permission_entropy(rights), F.col("entropy"), F.col("entropy") >= lim["entropy"])
    add("ai_readiness", "variation", variation(rights), F.col("cv"), F.col("cv").between(lim["cv_low"], lim["cv_high"]))
    by = seniority_rates(users, rights).agg(F.max(F.when(F.col("seniority") == "Executive", F.col("rate"))).alias("e"), F.max(F.when(F.col("seniority") == "Junior", F.col("rate"))).alias("j"))
    add("patterns", "seniority", by.where("e is not null and j is not null"), F.col("e") - F.col("j"), F.col("e") > F.col("j"))
    add("patterns", "sparsity", sparsity(users, perms, rights), F.col("sparsity"), F.col("sparsity") >= lim["sparsity"])
    return reduce(DataFrame.unionByName, out)


def suite_scores(results: DataFrame) -> DataFrame:
    """(suite, passed, total, score, weight, failed): failed names the first two failed checks."""
    first = F.row_number().over(Window.partitionBy("suite", "passed").orderBy("ord"))
    rows = results.withColumn("_r", first)
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    failed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("passed") & (F.col("_r") <= 2), F.struct("ord", "name")))), lambda x: x["name"]), ",")
    out = rows.groupBy("suite").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"), failed.alias("failed"))
    return out.withColumn("score", 100 * F.col("passed") / F.col("total")).withColumn("weight", weight[F.col("suite")])


def report(scores: DataFrame) -> DataFrame:
    """One row: overall score as published, over the weights' sum, readiness and verdict."""
    s = F.sum(F.col("score") * F.col("weight"))
    out = scores.agg(s.alias("overall"), (s / F.sum("weight")).alias("normalised_score"))
    verdict = F.when(F.col("overall") >= 90, "excellent").when(F.col("overall") >= 75, "good").when(F.col("overall") >= 60, "fair").otherwise("poor")
    return out.withColumn("ready", F.col("overall") >= LIMITS["ready"]).withColumn("verdict", verdict)
