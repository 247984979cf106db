"""Sources, catalogs, matrices, statistics and quality checks over the test view."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessmine.functions.common import shared_dir, small
from accessmine.operators import catalog, features, quality, stats
from accessmine.plans.iam_view import Iam, with_view
from accessmine.plans.registry import ORACLE, query
from accessmine.sources import io

BAD = ", bad AS (SELECT * FROM rights UNION ALL SELECT -1, 1, 10 UNION ALL SELECT NULL, 1, 10 UNION ALL SELECT 1, 1, -5 UNION ALL SELECT 1, NULL, 10)"


def _bad(v: Iam) -> DataFrame:
    """Rights with injected errors."""
    return v.rights.unionByName(v.spark.createDataFrame([(-1, 1, 10), (None, 1, 10), (1, 1, -5), (1, None, 10)], "user_id long, application_id long, permission_id long"))


def _read(v: Iam) -> dict[str, DataFrame]:
    """The four tables, written as CSV to the shared folder and read again."""
    folder = f"{shared_dir(v.spark)}/accessmine/tables-{uuid.uuid4().hex}"
    none = F.lit(None).cast("string")
    tables = {
        "users": v.users.withColumn("first_name", none).withColumn("last_name", none),
        "applications": v.applications.withColumnRenamed("app_name", "name"),
        "permissions": v.permissions.withColumnRenamed("perm_name", "name"),
        "rights": v.rights,
    }
    for name, table in tables.items():
        io.write_csv(table.select(*io.SCHEMAS[name].fieldNames()), f"{folder}/{name}.csv")
    return io.read_iam(v.spark, folder)


@query("SELECT application_id, count(*) AS n, min(perm_name) AS first_name FROM permissions GROUP BY application_id")
def a1_read_tables(v: Iam) -> DataFrame:
    """Explicit schemas: what Spark wrote as CSV comes back as it was."""
    perms = _read(v)["permissions"]
    perms = catalog.normalise_names(perms, "perm_name")
    return perms.groupBy("application_id").agg(F.count(F.lit(1)).alias("n"), F.min("perm_name").alias("first_name"))


@query("SELECT 'users' AS name, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS ids, max(position || department || location || contract_type || seniority) AS last FROM users UNION ALL SELECT 'applications', count(*), CAST(sum(application_id) AS BIGINT), max(app_name || category) FROM applications UNION ALL SELECT 'permissions', count(*), CAST(sum(application_id + permission_id) AS BIGINT), max(perm_name) FROM permissions UNION ALL SELECT 'rights', count(*), CAST(sum(user_id + application_id + permission_id) AS BIGINT), '' FROM rights")
def a1_read_iam(v: Iam) -> DataFrame:
    """All four tables from files, each told by its rows, the sum of its ids and its last text."""
    t = _read(v)
    told = lambda name, ids, last: t[name].agg(F.count(F.lit(1)).alias("n"), F.sum(sum(map(F.col, ids), F.lit(0))).alias("ids"), F.max(last).alias("last")).select(F.lit(name).alias("name"), "n", "ids", "last")
    out = told("users", ["user_id"], F.concat("position", "department", "location", "contract_type", "seniority"))
    out = out.unionByName(told("applications", ["application_id"], F.concat("name", "category")))
    out = out.unionByName(told("permissions", ["application_id", "permission_id"], F.col("name")))
    return out.unionByName(told("rights", ["user_id", "application_id", "permission_id"], F.lit("")))


@query("SELECT permission_id, CAST(permission_id AS VARCHAR) AS perm_name FROM permissions")
def a2_normalise_names(v: Iam) -> DataFrame:
    return catalog.normalise_names(catalog.require_columns(v.permissions.select("permission_id"), ["permission_id"]), "perm_name").select("permission_id", "perm_name")


def _all_columns(v: Iam) -> list[int]:
    """Every permission in order; to_wide itself refuses more columns than a wide matrix may have."""
    return [r[0] for r in v.permissions.select("permission_id").distinct().orderBy("permission_id").limit(io.WIDE_MOST + 1).collect()]


@query("SELECT 'User_' || user_id AS \"user\", 'p_' || permission_id AS permission FROM up JOIN users USING (user_id) JOIN permissions USING (permission_id)")
def a3_from_wide(v: Iam) -> DataFrame:
    return io.from_wide(io.to_wide(v.up, v.users, _all_columns(v)))


@query("SELECT count(*) AS users, (SELECT count(*) FROM permissions) AS permissions, (SELECT count(*) FROM up JOIN users USING (user_id) JOIN permissions USING (permission_id)) AS ones, round(100 * (1 - (SELECT count(*) FROM up JOIN users USING (user_id) JOIN permissions USING (permission_id)) / (count(*) * (SELECT count(*) FROM permissions))::DOUBLE), 6) AS sparsity_pct FROM users")
def a3_wide_report(v: Iam) -> DataFrame:
    """Shape and sparsity of the wide matrix, gathered while its cells are counted by user."""
    long, report = io.from_wide_observed(io.to_wide(v.up, v.users, _all_columns(v)))
    long.groupBy("user").count().write.format("noop").mode("overwrite").save()
    return v.spark.createDataFrame([io.wide_report(report)])


@query("SELECT u.user_id, (SELECT count(*) FROM permissions) AS columns, count(p.permission_id) AS ones, coalesce(string_agg('p_' || p.permission_id, ',' ORDER BY p.permission_id), '') AS held FROM users u LEFT JOIN up ON u.user_id = up.user_id LEFT JOIN permissions p ON p.permission_id = up.permission_id GROUP BY u.user_id")
def a6_to_wide(v: Iam) -> DataFrame:
    """The wide matrix over all permissions, each row told by its columns that are 1."""
    wide = io.to_wide(v.up, v.users, _all_columns(v))
    names = wide.columns[1:]
    held = F.filter(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in names]), lambda c: c.isNotNull())
    return wide.select("user_id", F.lit(len(names)).cast("long").alias("columns"), F.size(held).cast("long").alias("ones"), F.array_join(held, ",").alias("held"))


@query("SELECT 'user' AS kind, user_id AS id, department || '/' || position || '/' || location AS what FROM users UNION ALL SELECT 'perm', permission_id, perm_name || '/' || application_id FROM permissions UNION ALL SELECT 'app', application_id, app_name || '/' || category FROM applications")
def b1_catalogs(v: Iam) -> DataFrame:
    u, p, a = catalog.catalogs(v.users, v.applications, v.permissions)
    row = lambda df, kind, key, *cols: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.concat_ws("/", *cols).alias("what"))
    return row(u, "user", "user_id", "department", "position", "location").unionByName(row(p, "perm", "permission_id", "perm_name", "application_id")).unionByName(row(a, "app", "application_id", "app_name", "category"))


@query("SELECT permission_id, count(*) AS n FROM rights WHERE permission_id IN (SELECT permission_id FROM permissions WHERE application_id NOT IN (SELECT application_id FROM applications WHERE category = 'FACILITIES')) GROUP BY permission_id")
def b2_exclude_category(v: Iam) -> DataFrame:
    keep = catalog.exclude_category(v.permissions, v.applications, "FACILITIES")
    return v.rights.join(small(keep.select("permission_id")), "permission_id", "left_semi").groupBy("permission_id").agg(F.count(F.lit(1)).alias("n"))


@query(BAD + " SELECT DISTINCT user_id, permission_id FROM bad WHERE user_id IN (SELECT user_id FROM users) AND permission_id IN (SELECT permission_id FROM permissions)")
def b3_clean_rights(v: Iam) -> DataFrame:
    return catalog.clean_rights(_bad(v), v.users, v.permissions)


@query("SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS matrix_user_idx FROM users")
def b4_dense_index(v: Iam) -> DataFrame:
    return catalog.dense_index(v.users.select("user_id"), "user_id", "matrix_user_idx")


def _indexed(v: Iam):
    return catalog.dense_index(v.users.select("user_id"), "user_id", "matrix_user_idx"), catalog.dense_index(v.permissions, "permission_id", "matrix_perm_idx")


_IDX = ", ui AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i FROM users), pi AS (SELECT permission_id, row_number() OVER (ORDER BY permission_id) - 1 AS j FROM permissions)"


@query(_IDX + ' SELECT i AS "row", j AS col, CAST(count(*) AS BIGINT) AS value FROM rights JOIN ui USING (user_id) JOIN pi USING (permission_id) GROUP BY i, j')
def b5_matrix_counts(v: Iam) -> DataFrame:
    return catalog.user_permission_matrix(v.rights, *_indexed(v), value="count")


@query(_IDX + ' SELECT i AS "row", j AS col, CAST(1 AS BIGINT) AS value FROM up JOIN ui USING (user_id) JOIN pi USING (permission_id)')
def b5_matrix_binary(v: Iam) -> DataFrame:
    return catalog.user_permission_matrix(v.rights, *_indexed(v))


@query("SELECT DISTINCT user_id, application_id FROM up JOIN permissions USING (permission_id)")
def b6_user_applications(v: Iam) -> DataFrame:
    return catalog.user_application_matrix(v.up, v.permissions, v.applications)


@query("SELECT u.user_id, permission_id, count(permission_id) AS value FROM users u LEFT JOIN rights r ON u.user_id = r.user_id GROUP BY u.user_id, permission_id")
def b7_aligned_matrix(v: Iam) -> DataFrame:
    return catalog.aligned_matrix(v.rights, v.users)


@query("SELECT u.user_id, coalesce(string_agg(CAST(permission_id AS VARCHAR), ',' ORDER BY permission_id), '') AS permissions FROM users u LEFT JOIN up r ON u.user_id = r.user_id GROUP BY u.user_id")
def b8_permission_lists(v: Iam) -> DataFrame:
    return catalog.permission_lists(v.rights, v.users).select("user_id", F.array_join("permissions", ",").alias("permissions"))


@query("SELECT u.user_id, count(permission_id) AS n FROM users u LEFT JOIN up ON u.user_id = up.user_id GROUP BY u.user_id")
def b9_multi_hot(v: Iam) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    _, hot = features.multi_hot(catalog.permission_lists(v.rights, v.users))
    return hot.select("user_id", F.aggregate(vector_to_array("labels"), F.lit(0.0), lambda a, x: a + x).cast("long").alias("n"))


@query("SELECT permission_id, count(*) AS holders, round(count(*) / (SELECT count(*) FROM users)::DOUBLE, 6) AS frequency, count(*) / (SELECT count(*) FROM users)::DOUBLE BETWEEN 0.1 AND 0.22 AS kept FROM up GROUP BY permission_id")
def b10_frequency_filter(v: Iam) -> DataFrame:
    return catalog.frequency_filter(v.up, v.users.count(), 0.1, 0.22)


@query("SELECT position AS value, dense_rank() OVER (ORDER BY position) - 1 AS code FROM (SELECT DISTINCT position FROM users)")
def b11_label_codes(v: Iam) -> DataFrame:
    return features.label_codes(v.users, "position")


@query()
def b12_split(v: Iam) -> DataFrame:
    train, test = features.train_test_split(v.users, "user_id")
    return train.select("user_id", F.lit("train").alias("part")).unionByName(test.select("user_id", F.lit("test").alias("part")))


@query("SELECT (SELECT count(*) FROM users) AS n_users, (SELECT count(*) FROM applications) AS n_applications, (SELECT count(*) FROM permissions) AS n_permissions, (SELECT count(*) FROM rights) AS n_rights")
def c1_basic_stats(v: Iam) -> DataFrame:
    return stats.basic_stats(v.users, v.applications, v.permissions, v.rights)


@query(", n AS (SELECT (SELECT count(*) FROM users) * (SELECT count(*) FROM permissions) AS m, (SELECT count(*) FROM rights) AS r) SELECT m AS max_possible, round(100.0 * r / m, 6) AS density, round(100 - 100.0 * r / m, 6) AS sparsity, round(m / r::DOUBLE, 6) AS compression_ratio FROM n")
def c2_matrix_metrics(v: Iam) -> DataFrame:
    return stats.matrix_metrics(stats.basic_stats(v.users, v.applications, v.permissions, v.rights))


_SPREAD = "round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(stddev_samp(n), 6) AS std, min(n) AS min, max(n) AS max, round(quantile_cont(n, 0.25), 6) AS q1, round(quantile_cont(n, 0.75), 6) AS q3"
_SHAPE = "(avg(n ** 3) - 3 * avg(n) * avg(n ** 2) + 2 * avg(n) ** 3) / stddev_pop(n) ** 3"
_PER_USER = ", c AS (SELECT user_id, count(*)::DOUBLE AS n FROM rights GROUP BY user_id)"


@query(_PER_USER + f" SELECT {_SPREAD.replace('min(n)', 'CAST(min(n) AS BIGINT)').replace('max(n)', 'CAST(max(n) AS BIGINT)')}, round(100 * stddev_samp(n) / avg(n), 6) AS cv, round({_SHAPE}, 6) AS skewness, round(kurtosis_pop(n), 6) AS kurtosis, count(*) AS users FROM c")
def c3_perms_per_user(v: Iam) -> DataFrame:
    return stats.perms_per_user_stats(v.rights)


@query(_PER_USER + f", s AS (SELECT {_SHAPE} AS sk, kurtosis_pop(n) AS ku, count(*) AS n FROM c) SELECT round(exp(-(n / 6.0 * (sk ** 2 + ku ** 2 / 4)) / 2), 6) AS p_value, exp(-(n / 6.0 * (sk ** 2 + ku ** 2 / 4)) / 2) >= 0.05 AS is_normal FROM s")
def c4_normality(v: Iam) -> DataFrame:
    return stats.normality(stats.perms_per_user_stats(v.rights))


@query(f", c AS (SELECT permission_id, count(*) AS n FROM rights GROUP BY permission_id), q AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.75) AS b FROM c), k AS (SELECT count(*) FILTER (n < a) AS rare, count(*) FILTER (n > b) AS common FROM c, q) SELECT {_SPREAD}, any_value(rare) AS rare, any_value(common) AS common, round(100.0 * any_value(rare) / (SELECT count(*) FROM permissions), 6) AS rare_pct, round(100.0 * any_value(common) / (SELECT count(*) FROM permissions), 6) AS common_pct FROM c, k")
def c5_users_per_perm(v: Iam) -> DataFrame:
    return stats.users_per_perm_stats(v.rights, v.permissions)


_ATTR = " UNION ALL ".join(f"SELECT '{a}' AS attribute, {a} AS value FROM users" for a in stats.ATTRIBUTES)


@query(f", u AS ({_ATTR}) SELECT attribute, value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY attribute), 6) AS pct, row_number() OVER (PARTITION BY attribute ORDER BY count(*) DESC, value) AS rank FROM u GROUP BY attribute, value")
def c6_attribute_distributions(v: Iam) -> DataFrame:
    return stats.attribute_distributions(v.users)


@query("""
, t AS (SELECT user_id, list(permission_id) AS p, row_number() OVER (ORDER BY md5('42-' || user_id), user_id) AS i FROM up GROUP BY user_id ORDER BY md5('42-' || user_id), user_id LIMIT 1000),
s AS (SELECT len(list_intersect(a.p, b.p)) / len(list_distinct(a.p || b.p))::DOUBLE AS n FROM t a JOIN t b ON b.i BETWEEN a.i + 1 AND a.i + 19 WHERE a.i <= 500)
SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(stddev_pop(n), 6) AS std, round(min(n), 6) AS min, round(max(n), 6) AS max, round(quantile_cont(n, 0.25), 6) AS q1, round(quantile_cont(n, 0.75), 6) AS q3, count(*) AS pairs FROM s""")
def c7_sampled_similarity(v: Iam) -> DataFrame:
    return stats.sampled_similarity(v.up, seed=42)


@query(", c AS (SELECT count(*) AS n FROM rights GROUP BY permission_id), t AS (SELECT sum(n) AS t, count(*) AS k FROM c), e AS (SELECT -sum(n / t::DOUBLE * log2(n / t::DOUBLE + 1e-10)) AS e, log2(any_value(k)) AS m FROM c, t) SELECT round(e, 6) AS entropy, round(m, 6) AS max_entropy, round(e / m, 6) AS normalized_entropy FROM e")
def c8_entropy(v: Iam) -> DataFrame:
    return stats.entropy_metrics(v.rights)


@query(", c AS (SELECT count(*) AS x FROM rights GROUP BY permission_id), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n, sum(x) OVER () AS s FROM c), g AS (SELECT 2 * sum((n - i + 1) * x) / any_value(n * s)::DOUBLE - any_value((n + 1) / n::DOUBLE) AS g FROM r) SELECT round(g, 6) AS gini_coefficient, round(-g, 6) AS gini FROM g")
def c9_gini(v: Iam) -> DataFrame:
    return stats.gini(v.rights.groupBy("permission_id").agg(F.count(F.lit(1)).alias("n")))


@query(", c AS (SELECT count(DISTINCT user_id) AS n FROM rights GROUP BY application_id), p AS (SELECT count(*) AS n FROM permissions GROUP BY application_id) SELECT count(*) AS used_apps, round(avg(n), 6) AS mean_users, round(quantile_cont(n, 0.5), 6) AS median_users, round(stddev_samp(n), 6) AS std_users, min(n) AS min_users, max(n) AS max_users, (SELECT count(*) FROM applications) AS total_apps, (SELECT round(avg(n), 6) FROM p) AS mean_perms, (SELECT count(*) FROM applications) - count(*) AS unused_apps FROM c")
def c10_application_stats(v: Iam) -> DataFrame:
    return stats.application_stats(v.rights, v.permissions, v.applications)


def _part(name: str, prefix: str = "") -> str:
    """A query's SQL as one row beside others, its columns with a prefix."""
    own = ORACLE[name].removeprefix(with_view("").rstrip()).strip()
    own = f"WITH {own[1:]}" if own.startswith(",") else own
    return f'(SELECT COLUMNS(*) AS "{prefix}\\0" FROM ({own}))'


_PARTS = {"c1_basic_stats": "", "c2_matrix_metrics": "matrix_", "c3_perms_per_user": "perms_per_user_", "c5_users_per_perm": "users_per_perm_", "c7_sampled_similarity": "similarity_", "c8_entropy": "", "c9_gini": "", "c10_application_stats": "app_"}


@query("SELECT * FROM " + ", ".join(_part(n, p) for n, p in _PARTS.items()))
def c11_statistical_summary(v: Iam) -> DataFrame:
    return stats.statistical_summary(v.users, v.applications, v.permissions, v.rights)


@query(BAD + " SELECT CAST(sum((user_id IS NULL)::INT + (application_id IS NULL)::INT + (permission_id IS NULL)::INT) AS BIGINT) AS missing FROM bad")
def d1_missing(v: Iam) -> DataFrame:
    return quality.missing_values(_bad(v))


@query(BAD + " SELECT 'user_id' AS key, count(*) AS bad_rows FROM bad WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM users) UNION ALL SELECT 'application_id', count(*) FROM bad WHERE application_id IS NULL OR application_id NOT IN (SELECT application_id FROM applications) UNION ALL SELECT 'permission_id', count(*) FROM bad WHERE permission_id IS NULL OR permission_id NOT IN (SELECT permission_id FROM permissions)")
def d2_foreign_keys(v: Iam) -> DataFrame:
    return quality.foreign_key_errors(_bad(v), {"user_id": v.users, "application_id": v.applications, "permission_id": v.permissions})


_BADGE = "SELECT user_id, location FROM users u WHERE NOT EXISTS (SELECT 1 FROM rights r JOIN applications a ON a.application_id = r.application_id JOIN permissions p ON p.permission_id = r.permission_id AND p.application_id = a.application_id WHERE r.user_id = u.user_id AND a.app_name = 'Access Badge System - ' || u.location AND p.perm_name = 'access_building')"


@query(_BADGE)
def d4_badge_by_location(v: Iam) -> DataFrame:
    return quality.users_without_badge(v.users, v.applications, v.permissions, v.rights)


_CONSISTENCY = "SELECT department, any_value(users) AS users, round(max(n) / any_value(users)::DOUBLE, 6) AS consistency FROM (SELECT department, count(*) AS n FROM rights JOIN users USING (user_id) GROUP BY department, application_id, permission_id) JOIN (SELECT department, count(*) AS users FROM users GROUP BY department HAVING count(*) >= 3) USING (department) GROUP BY department"


@query(_CONSISTENCY)
def d5_department_consistency(v: Iam) -> DataFrame:
    return quality.department_consistency(v.users, v.rights)


_RICH = " + ".join(f"count(DISTINCT {a})" for a in stats.ATTRIBUTES)


@query(f"SELECT {_RICH} AS richness FROM users")
def d6_feature_richness(v: Iam) -> DataFrame:
    return quality.feature_richness(v.users)


@query("SELECT round(min(n) / max(n)::DOUBLE, 6) AS balance FROM (SELECT count(*) AS n FROM users GROUP BY position)")
def d7_class_balance(v: Iam) -> DataFrame:
    return quality.class_balance(v.users)


_ENTROPY = ", c AS (SELECT n, count(*) AS m FROM (SELECT count(*) AS n FROM rights GROUP BY user_id) GROUP BY n)"


@query(_ENTROPY + " SELECT round(-sum(m / t::DOUBLE * ln(m / t::DOUBLE)), 6) AS entropy FROM c, (SELECT sum(m) AS t FROM c)")
def d8_permission_entropy(v: Iam) -> DataFrame:
    return quality.permission_entropy(v.rights)


@query("SELECT round(stddev_samp(n) / avg(n), 6) AS cv FROM (SELECT count(*) AS n FROM rights GROUP BY user_id)")
def d9_variation(v: Iam) -> DataFrame:
    return quality.variation(v.rights)


@query("SELECT seniority, round(count(*) / count(DISTINCT user_id)::DOUBLE, 6) AS rate FROM rights JOIN users USING (user_id) GROUP BY seniority")
def d10_seniority(v: Iam) -> DataFrame:
    return quality.seniority_rates(v.users, v.rights)


@query("SELECT round(1 - (SELECT count(*) FROM rights) / ((SELECT count(*) FROM users) * (SELECT count(*) FROM permissions))::DOUBLE, 6) AS sparsity")
def d11_sparsity(v: Iam) -> DataFrame:
    return quality.sparsity(v.users, v.permissions, v.rights)


_CHECKS = f"""
, sr AS (SELECT count(*) FILTER (seniority = 'Executive') / count(DISTINCT user_id) FILTER (seniority = 'Executive')::DOUBLE AS e, count(*) FILTER (seniority = 'Junior') / count(DISTINCT user_id) FILTER (seniority = 'Junior')::DOUBLE AS j FROM rights JOIN users USING (user_id))
{_ENTROPY}
, pos AS (SELECT count(*) AS n FROM users GROUP BY position), per AS (SELECT count(*) AS n FROM rights GROUP BY user_id)
, checks AS (
SELECT 'completeness' AS suite, 0 AS ord, 'missing_users' AS name, true AS passed UNION ALL SELECT 'completeness', 1, 'missing_applications', true UNION ALL SELECT 'completeness', 2, 'missing_permissions', true UNION ALL SELECT 'completeness', 3, 'missing_rights', true
UNION ALL SELECT 'completeness', 4, 'fk_user_id', true UNION ALL SELECT 'completeness', 5, 'fk_application_id', true UNION ALL SELECT 'completeness', 6, 'fk_permission_id', true
UNION ALL SELECT 'completeness', 7, 'volume_users', (SELECT count(*) FROM users) >= 5000 UNION ALL SELECT 'completeness', 8, 'volume_rights', (SELECT count(*) FROM rights) >= 10000
UNION ALL SELECT 'business_rules', 9, 'badge_by_location', (SELECT count(*) FROM ({_BADGE})) = 0
UNION ALL SELECT 'business_rules', 10, 'department_consistency', (SELECT avg(consistency) FROM ({_CONSISTENCY})) >= 0.7
UNION ALL SELECT 'ai_readiness', 11, 'feature_richness', (SELECT {_RICH} FROM users) >= 20
UNION ALL SELECT 'ai_readiness', 12, 'class_balance', (SELECT min(n) / max(n)::DOUBLE FROM pos) >= 0.01
UNION ALL SELECT 'ai_readiness', 13, 'permission_entropy', (SELECT -sum(m / t::DOUBLE * ln(m / t::DOUBLE)) FROM c, (SELECT sum(m) AS t FROM c)) >= 1.0
UNION ALL SELECT 'ai_readiness', 14, 'variation', (SELECT stddev_samp(n) / avg(n) FROM per) BETWEEN 0.3 AND 1.0
UNION ALL SELECT 'patterns', 15, 'seniority', (SELECT e > j FROM sr)
UNION ALL SELECT 'patterns', 16, 'sparsity', (SELECT 1 - (SELECT count(*) FROM rights) / ((SELECT count(*) FROM users) * (SELECT count(*) FROM permissions))::DOUBLE) >= 0.99)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY suite, passed ORDER BY ord) AS r FROM checks)
, scores AS (SELECT suite, count(*) FILTER (passed) AS passed, count(*) AS total, coalesce(string_agg(name, ',' ORDER BY ord) FILTER (NOT passed AND r <= 2), '') AS failed, 100.0 * count(*) FILTER (passed) / count(*) AS score,
  CASE suite WHEN 'completeness' THEN 0.25 WHEN 'business_rules' THEN 0.2 WHEN 'ai_readiness' THEN 0.25 ELSE 0.15 END AS weight FROM ranked GROUP BY suite)
"""


@query(_CHECKS + " SELECT suite, passed, total, failed, round(score, 6) AS score, CAST(weight AS DOUBLE) AS weight FROM scores")
def d12_suite_scores(v: Iam) -> DataFrame:
    return quality.suite_scores(quality.checks(v.users, v.applications, v.permissions, v.rights))


@query(_CHECKS + ", o AS (SELECT sum(score * weight) AS s, sum(weight) AS t FROM scores) SELECT round(s, 6)::DOUBLE AS overall, round(s / t, 6)::DOUBLE AS normalised_score, s >= 70 AS ready, CASE WHEN s >= 90 THEN 'excellent' WHEN s >= 75 THEN 'good' WHEN s >= 60 THEN 'fair' ELSE 'poor' END AS verdict FROM o")
def d12_report(v: Iam) -> DataFrame:
    return quality.report(quality.suite_scores(quality.checks(v.users, v.applications, v.permissions, v.rights)))


@query("SELECT (SELECT count(*) FROM users) >= 5000 AS enough_users, (SELECT count(*) FROM rights) >= 10000 AS enough_rights")
def d3_volumes(v: Iam) -> DataFrame:
    c = quality.checks(v.users, v.applications, v.permissions, v.rights).where("name like 'volume_%'")
    return c.agg(F.bool_or(F.col("passed") & (F.col("name") == "volume_users")).alias("enough_users"), F.bool_or(F.col("passed") & (F.col("name") == "volume_rights")).alias("enough_rights"))
