"""The test tables seen as access rights: the same view for Spark and for SQL.

Brands are applications, brand and type a permission, customers users, and who ordered a
part of a brand and type holds that permission, as often as they ordered it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the mapping.
CATEGORIES = ("FACILITIES", "COLLAB", "DEVOPS", "FINANCE", "CRM")
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


class Iam:
    """Lazily built frames over a folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def _parts(self) -> DataFrame:
        code = F.array_position(F.array(*map(F.lit, TYPES)), F.col("p_type")) - 1
        app = F.substring("p_brand", 7, 10).cast("long")
        return self.table("part").select("p_partkey", app.alias("application_id"), (app * 10 + code).cast("long").alias("permission_id"), "p_type")

    @cached_property
    def applications(self) -> DataFrame:
        apps = self._parts.select("application_id").distinct()
        region = self.table("region").select(((F.col("r_regionkey") + 1) * 5).cast("long").alias("application_id"), "r_name")
        category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("application_id") % 5 + 1).cast("int"))
        name = F.when(F.col("r_name").isNotNull(), F.concat(F.lit("Access Badge System - "), "r_name")).otherwise(F.concat(F.lit("Brand#"), F.col("application_id").cast("string")))
        return apps.join(F.broadcast(region), "application_id", "left").select("application_id", name.alias("app_name"), category.alias("category"))

    @cached_property
    def permissions(self) -> DataFrame:
        p = self._parts.select("application_id", "permission_id", "p_type").distinct()
        badge = (F.col("application_id") % 5 == 0) & (F.col("permission_id") % 10 == 0)
        return p.select("application_id", "permission_id", F.when(badge, "access_building").otherwise(F.lower("p_type")).alias("perm_name"))

    @cached_property
    def users(self) -> DataFrame:
        c, n, r = self.table("customer"), self.table("nation"), self.table("region")
        rows = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
        m = F.col("c_custkey") % 7
        s = F.col("c_acctbal")
        return rows.select(
            F.col("c_custkey").alias("user_id"),
            F.concat("c_mktsegment", F.lit("-"), (F.col("c_custkey") % 5).cast("string")).alias("position"),
            F.col("c_mktsegment").alias("department"),
            F.col("r_name").alias("location"),
            F.when(m <= 2, "CDI").when(m <= 4, "CDD").when(m == 5, "Stage").otherwise("Interim").alias("contract_type"),
            F.when(s < 2500, "Junior").when(s < 5000, "Medium").when(s < 7500, "Senior").when(s < 9500, "Lead").otherwise("Executive").alias("seniority"),
        )

    @cached_property
    def rights(self) -> DataFrame:
        o, li = self.table("orders").select("o_orderkey", "o_custkey"), self.table("lineitem").select("l_orderkey", "l_partkey")
        rows = li.join(o, li.l_orderkey == o.o_orderkey).join(self._parts.drop("p_type"), F.col("l_partkey") == F.col("p_partkey"))
        return rows.select(F.col("o_custkey").alias("user_id"), "application_id", "permission_id")

    @cached_property
    def up(self) -> DataFrame:
        return self.rights.select("user_id", "permission_id").distinct()

    @cached_property
    def app_rights(self) -> DataFrame:
        """User and application, in the columns of up."""
        return self.rights.select("user_id", F.col("application_id").alias("permission_id")).distinct()

    @cached_property
    def labels(self) -> DataFrame:
        """Cohorts by nation, one of them noise."""
        k = F.col("c_nationkey").cast("long")
        return self.table("customer").select(F.col("c_custkey").alias("user_id"), F.when(k == 24, -1).otherwise(k).alias("label"))

    @cached_property
    def points(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))

    @cached_property
    def point_labels(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))

    @cached_property
    def weights(self) -> DataFrame:
        """A stand-in for a factor: role r of user u weighs (u * (r + 3)) % 11 / 10."""
        w = self.users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("role_id"))
        return w.withColumn("weight", (F.col("user_id") * (F.col("role_id") + 3)) % 11 / 10)

    @cached_property
    def factor(self) -> DataFrame:
        """A stand-in for the other: permission p of role r weighs (p * (2 r + 1)) % 13 / 10."""
        h = self.permissions.select("permission_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("role_id"))
        return h.withColumn("weight", (F.col("permission_id") * (2 * F.col("role_id") + 1)) % 13 / 10)


_TYPE_CASE = "CASE p_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES)) + " END"
_CAT_CASE = "CASE a.application_id % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES)) + " END"
VIEW = f"""
parts AS (SELECT p_partkey, CAST(substr(p_brand, 7) AS BIGINT) AS application_id, CAST(substr(p_brand, 7) AS BIGINT) * 10 + {_TYPE_CASE} AS permission_id, p_type FROM part),
applications AS (SELECT a.application_id, CASE WHEN r_name IS NOT NULL THEN 'Access Badge System - ' || r_name ELSE 'Brand#' || a.application_id END AS app_name, {_CAT_CASE} AS category
  FROM (SELECT DISTINCT application_id FROM parts) a LEFT JOIN region ON (r_regionkey + 1) * 5 = a.application_id),
permissions AS (SELECT DISTINCT application_id, permission_id, CASE WHEN application_id % 5 = 0 AND permission_id % 10 = 0 THEN 'access_building' ELSE lower(p_type) END AS perm_name FROM parts),
users AS (SELECT c_custkey AS user_id, c_mktsegment || '-' || (c_custkey % 5) AS position, c_mktsegment AS department, r_name AS location,
  CASE WHEN c_custkey % 7 <= 2 THEN 'CDI' WHEN c_custkey % 7 <= 4 THEN 'CDD' WHEN c_custkey % 7 = 5 THEN 'Stage' ELSE 'Interim' END AS contract_type,
  CASE WHEN c_acctbal < 2500 THEN 'Junior' WHEN c_acctbal < 5000 THEN 'Medium' WHEN c_acctbal < 7500 THEN 'Senior' WHEN c_acctbal < 9500 THEN 'Lead' ELSE 'Executive' END AS seniority
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
rights AS (SELECT o_custkey AS user_id, application_id, permission_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN parts ON l_partkey = p_partkey),
up AS (SELECT DISTINCT user_id, permission_id FROM rights),
ap AS (SELECT DISTINCT user_id, application_id AS permission_id FROM rights),
labels AS (SELECT c_custkey AS user_id, CASE WHEN c_nationkey = 24 THEN -1 ELSE CAST(c_nationkey AS BIGINT) END AS label FROM customer),
points AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
w AS (SELECT user_id, role_id, (user_id * (role_id + 3)) % 11 / 10.0::DOUBLE AS weight FROM users, (SELECT unnest(range(0, 6)) AS role_id)),
h AS (SELECT permission_id, role_id, (permission_id * (2 * role_id + 1)) % 13 / 10.0::DOUBLE AS weight FROM permissions, (SELECT unnest(range(0, 6)) AS role_id)),
sizes AS (SELECT label, count(*) AS size FROM labels WHERE label <> -1 GROUP BY label),
freq AS (SELECT l.label, permission_id, count(*) AS holders, any_value(size) AS size, count(*) / any_value(size)::DOUBLE AS frequency FROM labels l JOIN up USING (user_id) JOIN sizes s ON s.label = l.label GROUP BY l.label, permission_id),
roles AS (SELECT 'Role_' || s.label AS role, s.label, s.size, count(*) FILTER (frequency >= 0.3 - 1e-12) AS permission_count, count(permission_id) AS original_permissions,
  coalesce(avg(frequency) FILTER (frequency >= 0.3 - 1e-12), 0.0) AS cohesion, count(*) FILTER (frequency >= 0.3 - 1e-12) / count(permission_id)::DOUBLE AS coverage
  FROM sizes s JOIN freq f ON s.label = f.label WHERE s.size >= 60 GROUP BY s.label, s.size),
role_perms AS (SELECT role, permission_id, frequency FROM freq JOIN roles USING (label) WHERE frequency >= 0.3 - 1e-12),
effective AS (SELECT user_id, l.label, CASE WHEN r.label IS NULL THEN -1 ELSE l.label END AS effective_label FROM labels l LEFT JOIN roles r ON l.label = r.label),
noise AS (SELECT user_id FROM effective WHERE effective_label = -1)
"""


def with_view(sql: str) -> str:
    """SQL that sees the view; it may begin with more common tables, as ", name AS (...)"."""
    sql = sql.strip()
    start = "WITH RECURSIVE" if "UNION SELECT" in sql else "WITH"
    return f"{start} {VIEW}{sql}" if sql.startswith(",") else f"{start} {VIEW} {sql}"
