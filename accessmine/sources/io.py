"""Tables in and out: CSV, JSON, Parquet; wide matrices; roles and reports."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_long, _text = T.LongType(), T.StringType()
SCHEMAS = {
    "users": T.StructType([T.StructField("user_id", _long)] + [T.StructField(c, _text) for c in ("first_name", "last_name", "position", "department", "location", "contract_type", "seniority")]),
    "applications": T.StructType([T.StructField("application_id", _long), T.StructField("name", _text), T.StructField("category", _text)]),
    "permissions": T.StructType([T.StructField("application_id", _long), T.StructField("permission_id", _long), T.StructField("name", _text)]),
    "rights": T.StructType([T.StructField(c, _long) for c in ("user_id", "application_id", "permission_id")]),
}
WIDE_MOST = 10_000


def read_table(spark: SparkSession, path: str, table: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(SCHEMAS[table])
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def read_iam(spark: SparkSession, folder: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """The four tables of a folder."""
    return {t: read_table(spark, f"{folder}/{t}.{fmt}", t, fmt) for t in SCHEMAS}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_matrix(triples: DataFrame, path: str) -> None:
    triples.repartition("row").sortWithinPartitions("row", "col").write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row long, col long, value long").parquet(path)


def to_wide(up: DataFrame, users: DataFrame, columns: list[int], key: str = "permission_id") -> DataFrame:
    """A 0/1 column for each given permission, in order; users without any are all zeros."""
    if len(columns) > WIDE_MOST:
        raise ValueError(f"more than {WIDE_MOST} columns")
    wide = up.groupBy("user_id").pivot(key, columns).agg(F.max(F.lit(1)))
    names = [str(c) for c in columns]
    out = users.select("user_id").join(wide, "user_id", "left").na.fill(0, names)
    return out.select("user_id", *[F.col(f"`{c}`").cast("long").alias(f"p_{c}") for c in names])


def from_wide(wide: DataFrame) -> DataFrame:
    """(user, permission) of a wide matrix whose first column is the id.

    Values other than 0 and 1 count as 1 from over 0.5; ids that aren't text become
    ``User_<id>``.
    """
    key, *columns = wide.columns
    ids = F.col(key) if wide.schema[key].dataType == T.StringType() else F.concat(F.lit("User_"), F.col(key).cast("string"))
    long = wide.select(ids.alias("user"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot("user", columns, "permission", "value")
    return long.where(F.col("value") > 0.5).select("user", "permission")


def from_wide_observed(wide: DataFrame) -> tuple[DataFrame, Observation]:
    """from_wide, and figures of the matrix that its first action gathers on the way (see wide_report).

    Nothing is read twice: the cells that count are added up row by row before they are
    turned into rows of their own.
    """
    report = Observation()
    columns = wide.columns[1:]
    held = F.aggregate(F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns]), F.lit(0).cast("long"), lambda n, x: n + F.when(x > 0.5, 1).otherwise(0)) if columns else F.lit(0).cast("long")
    seen = wide.observe(report, F.count(F.lit(1)).alias("users"), F.lit(len(columns)).cast("long").alias("permissions"), F.coalesce(F.sum(held), F.lit(0)).alias("ones"))
    return from_wide(seen), report


def wide_report(report: Observation) -> Row:
    """users, permissions, ones and sparsity_pct (100 for a matrix without cells), once an action has run."""
    got = report.get
    cells = got["users"] * got["permissions"]
    return Row(users=got["users"], permissions=got["permissions"], ones=got["ones"], sparsity_pct=100.0 * (1 - got["ones"] / cells) if cells else 100.0)


def _wide(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.json(path)


def read_wide_matrix(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return from_wide(_wide(spark, path, fmt))


def read_wide_observed(spark: SparkSession, path: str, fmt: str = "csv") -> tuple[DataFrame, Observation]:
    """read_wide_matrix with its report."""
    return from_wide_observed(_wide(spark, path, fmt))


def nested_roles(roles: DataFrame, members: DataFrame, perms: DataFrame) -> DataFrame:
    """A record for each role, with users, permissions and their frequencies."""
    u = members.groupBy("role").agg(F.array_sort(F.collect_list("user_id")).alias("users"))
    p = perms.groupBy("role").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("permission_id").cast("string").alias("k"), "frequency")))).alias("permission_frequencies"))
    return roles.join(u, "role", "left").join(p, "role", "left").withColumn("permissions", F.map_keys("permission_frequencies"))


def export_roles(roles: DataFrame, members: DataFrame, perms: DataFrame, metrics: DataFrame, folder: str) -> None:
    """roles and metrics as JSON, assignments and role details as CSV; infinities in JSON are null."""
    nested_roles(roles, members, perms).write.mode("overwrite").json(f"{folder}/roles.json")
    finite = [F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes]
    metrics.select(*finite).coalesce(1).write.mode("overwrite").json(f"{folder}/metrics.json")
    write_csv(members.select(F.col("user_id").alias("User"), F.col("role").alias("Role")), f"{folder}/assignments.csv")
    write_csv(role_details(perms), f"{folder}/role_details.csv")


def role_details(perms: DataFrame) -> DataFrame:
    return perms.select(F.col("role").alias("Role"), F.col("permission_id").alias("Permission"), F.col("frequency").alias("Frequency"), F.col("meets_impact").alias("Meets_Impact_Threshold"))


def write_record(df: DataFrame, path: str) -> None:
    """A one-row frame as one JSON object."""
    df.select(F.to_json(F.struct("*"))).coalesce(1).write.mode("overwrite").text(path)


def write_validation(results: DataFrame, path: str) -> None:
    write_record(results.agg(F.collect_list(F.struct(*results.columns)).alias("tests")), path)


def export_comparison(comparison: DataFrame, recommendation: DataFrame, folder: str) -> None:
    write_csv(comparison, f"{folder}/comparison.csv")
    write_record(recommendation, f"{folder}/recommendation.json")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
