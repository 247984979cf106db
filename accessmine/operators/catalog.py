"""Catalogs, clean rights and user x permission matrices as long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INDEX_ROWS = 500_000


def require_columns(df: DataFrame, columns: list[str], table: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    return df


def normalise_names(df: DataFrame, to: str) -> DataFrame:
    """``name`` becomes ``to``; without either, a permission is named by its id."""
    if "name" in df.columns and to not in df.columns:
        return df.withColumnRenamed("name", to)
    if to == "perm_name":
        known = F.col("perm_name") if "perm_name" in df.columns else F.lit(None).cast("string")
        return df.withColumn("perm_name", F.coalesce(known, F.col("permission_id").cast("string")))
    return df


def catalogs(users: DataFrame, apps: DataFrame, perms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct users (with department, position, location), permissions and applications."""
    return (
        users.select("user_id", "department", "position", "location").dropDuplicates(["user_id"]),
        perms.select("permission_id", "application_id", "perm_name").dropDuplicates(["permission_id"]),
        apps.select("application_id", "app_name", "category").dropDuplicates(["application_id"]),
    )


def exclude_category(perms: DataFrame, apps: DataFrame, category: str) -> DataFrame:
    """Permissions of applications outside a category."""
    return perms.join(apps.where(F.col("category") == category), "application_id", "left_anti")


def clean_rights(rights: DataFrame, users: DataFrame, perms: DataFrame) -> DataFrame:
    """Distinct (user_id, permission_id) of known users and permissions."""
    pairs = rights.select("user_id", "permission_id").join(perms.select("permission_id"), "permission_id", "left_semi")
    return pairs.join(users.select("user_id"), "user_id", "left_semi").select("user_id", "permission_id").dropDuplicates()


def dense_index(df: DataFrame, key: str, out: str) -> DataFrame:
    """Numbers from 0 in the order of a distinct numeric key, without sorting all rows in one task.

    Approximate quantiles cut the key into ranges; a row's number is its place in its range
    plus the rows of the ranges before.
    """
    ranges = max(1, -(-df.count() // INDEX_ROWS))
    if ranges == 1:
        return df.withColumn(out, F.row_number().over(Window.orderBy(key)).cast("long") - 1)
    cuts = df.approxQuantile(key, [k / ranges for k in range(1, ranges)], 0.1 / ranges)
    part = sum(((F.col(key) > c).cast("int") for c in cuts), F.lit(0))
    rows = df.withColumn("_range", part)
    ahead = rows.groupBy("_range").count().withColumn("_ahead", F.sum("count").over(Window.orderBy("_range")) - F.col("count")).drop("count")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return rows.join(F.broadcast(ahead), "_range").withColumn(out, (place + F.col("_ahead") - 1).cast("long")).drop("_range", "_ahead")


def user_permission_matrix(rights: DataFrame, users: DataFrame, perms: DataFrame, value: str = "binary") -> DataFrame:
    """(row, col, value) over indexed users (matrix_user_idx) and permissions (matrix_perm_idx).

    ``binary``: 1 for each pair; ``count``: how many rights say so.
    """
    pairs = rights.join(perms.select("permission_id", "matrix_perm_idx"), "permission_id").join(users.select("user_id", "matrix_user_idx"), "user_id")
    size = F.lit(1).cast("long") if value == "binary" else F.count(F.lit(1))
    return pairs.groupBy(F.col("matrix_user_idx").alias("row"), F.col("matrix_perm_idx").alias("col")).agg(size.alias("value"))


def user_application_matrix(up: DataFrame, perms: DataFrame, apps: DataFrame) -> DataFrame:
    """(user_id, application_id) where the user holds a permission of a known application."""
    held = up.join(perms.select("permission_id", "application_id"), "permission_id")
    return held.select("user_id", "application_id").distinct().join(apps.select("application_id"), "application_id", "left_semi").select("user_id", "application_id")


def aligned_matrix(rights: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, permission_id, value) counts; a user without rights has one row with value 0."""
    counts = rights.groupBy("user_id", "permission_id").agg(F.count(F.lit(1)).alias("value"))
    return users.select("user_id").join(counts, "user_id", "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))


def permission_lists(rights: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, permissions), sorted and distinct; empty for users without rights."""
    lists = rights.groupBy("user_id").agg(F.array_sort(F.collect_set("permission_id")).alias("permissions"))
    return users.select("user_id").join(lists, "user_id", "left").withColumn("permissions", F.coalesce("permissions", F.array().cast("array<bigint>")))


def frequency_filter(up: DataFrame, n_users: int, lower: float = 0.0, upper: float = 0.7) -> DataFrame:
    """(permission_id, holders, frequency, kept): kept if the share of users is within the limits."""
    freq = up.groupBy("permission_id").agg(F.countDistinct("user_id").alias("holders")).withColumn("frequency", F.col("holders") / n_users)
    return freq.withColumn("kept", F.col("frequency").between(lower, upper))
