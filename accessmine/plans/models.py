"""Similarity, clustering, factors, roles, graphs, predictors and synthetic data over the test view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessmine.functions.common import cut
from accessmine.operators import catalog, clustering, compare, factor, features, generate, graph, metrics, neighbours, predict, refine, roles, similarity
from accessmine.plans.iam_view import Iam
from accessmine.plans.registry import GROUPING, IMPACT, query
from accessmine.sources import io

# ---- roles of the cohorts ----


def _roles(v: Iam) -> DataFrame:
    return roles.extract_roles(v.up, v.labels, GROUPING, IMPACT)


def _role_perms(v: Iam) -> DataFrame:
    return roles.role_permissions(v.up, v.labels, _roles(v), IMPACT)


def _noise(v: Iam) -> DataFrame:
    return roles.effective_labels(v.labels, _roles(v)).where("effective_label = -1").select("user_id")


_ROLE = "role, label, size, permission_count, original_permissions, round(cohesion, 6) AS cohesion, round(coverage, 6) AS coverage"


@query(f"SELECT {_ROLE} FROM roles")
def h1_extract_roles(v: Iam) -> DataFrame:
    return _roles(v)


@query("SELECT role, permission_id, round(frequency, 6) AS frequency, true AS meets_impact FROM role_perms")
def h1_role_permissions(v: Iam) -> DataFrame:
    return _role_perms(v)


@query("SELECT role, user_id FROM labels JOIN roles USING (label)")
def h1_role_users(v: Iam) -> DataFrame:
    return roles.role_users(v.labels, _roles(v))


@query("SELECT user_id, label, effective_label FROM effective")
def h1_effective_labels(v: Iam) -> DataFrame:
    return roles.effective_labels(v.labels, _roles(v))


@query(", s AS (SELECT s.label, s.size, count(*) FILTER (frequency >= 0.37 - 1e-12) AS pc, count(*) AS o, avg(frequency) FILTER (frequency >= 0.37 - 1e-12) AS c FROM sizes s JOIN freq f ON f.label = s.label WHERE s.size >= 60 GROUP BY s.label, s.size) SELECT 'Role_' || row_number() OVER (ORDER BY label) AS role, label, size, pc AS permission_count, o AS original_permissions, round(c, 6) AS cohesion, round(pc / o::DOUBLE, 6) AS coverage FROM s WHERE pc > 0")
def h2_strict_roles(v: Iam) -> DataFrame:
    return roles.extract_roles(v.up, v.labels, GROUPING, 0.37, strict=True)


@query("SELECT 'Role_' || s.label AS role, s.label, s.size, count(*) FILTER (frequency >= 0.35 - 1e-12) AS permission_count, count(*) AS original_permissions, round(coalesce(avg(frequency) FILTER (frequency >= 0.35 - 1e-12), 0), 6) AS cohesion, round(count(*) FILTER (frequency >= 0.35 - 1e-12) / count(*)::DOUBLE, 6) AS coverage FROM sizes s JOIN freq f ON f.label = s.label GROUP BY s.label, s.size")
def h3_simple_roles(v: Iam) -> DataFrame:
    return roles.extract_roles(v.up, v.labels, 1, 0.35)


@query("SELECT label, size, 'size ' || size || ' < 60' AS reason FROM sizes WHERE size < 60")
def h4_rejected_clusters(v: Iam) -> DataFrame:
    return roles.rejected_clusters(v.labels, GROUPING)


@query(", el AS (SELECT user_id, effective_label AS label FROM effective), sz AS (SELECT label, count(*) AS size FROM el WHERE label <> -1 GROUP BY label), fr AS (SELECT el.label, permission_id, count(*) / any_value(size)::DOUBLE AS frequency FROM el JOIN up USING (user_id) JOIN sz ON sz.label = el.label GROUP BY el.label, permission_id) SELECT 'Role_' || sz.label AS role, sz.label, sz.size, count(*) FILTER (frequency >= 0.25 - 1e-12) AS permission_count, count(*) AS original_permissions, round(coalesce(avg(frequency) FILTER (frequency >= 0.25 - 1e-12), 0), 6) AS cohesion, round(count(*) FILTER (frequency >= 0.25 - 1e-12) / count(*)::DOUBLE, 6) AS coverage FROM sz JOIN fr ON fr.label = sz.label WHERE sz.size >= 50 GROUP BY sz.label, sz.size")
def h5_adjust_thresholds(v: Iam) -> DataFrame:
    return roles.adjust_thresholds(v.up, roles.effective_labels(v.labels, _roles(v)), 50, 0.25, from_labels="effective")


_CENT = ", cent AS (SELECT label, list(m ORDER BY i) AS c, any_value(n) AS n FROM (SELECT label, i, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM points) GROUP BY label, i) GROUP BY label)"


@query(", d AS (SELECT a.id, a.label AS own, b.label, sum(list_distance(a.e, b.e)) AS t, count(*) AS n FROM points a, points b GROUP BY a.id, a.label, b.label), s AS (SELECT id, max(n) FILTER (own = label) AS size, max(t / (n - 1)) FILTER (own = label) AS a, min(t / n) FILTER (own <> label) AS b FROM d GROUP BY id) SELECT round(avg(CASE WHEN size > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM s")
def h6_silhouette(v: Iam) -> DataFrame:
    return metrics.silhouette(v.points, v.point_labels)


@query(", d AS (SELECT a.id, a.label AS own, b.label, sum(list_distance(a.e, b.e) ** 2) AS t, count(*) AS n FROM points a, points b GROUP BY a.id, a.label, b.label), s AS (SELECT id, max(n) FILTER (own = label) AS size, max(t / (n - 1)) FILTER (own = label) AS a, min(t / n) FILTER (own <> label) AS b FROM d GROUP BY id) SELECT round(avg(CASE WHEN size > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette_squared FROM s")
def h6_silhouette_squared(v: Iam) -> DataFrame:
    return metrics.silhouette_squared(v.points, v.point_labels)


@query(_CENT + ", s AS (SELECT p.label, avg(list_distance(e, c)) AS s, any_value(c) AS c FROM points p JOIN cent ON p.label = cent.label GROUP BY p.label), r AS (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM s a, s b WHERE a.label <> b.label GROUP BY a.label) SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def h7_davies_bouldin(v: Iam) -> DataFrame:
    return metrics.davies_bouldin(v.points, v.point_labels)


@query(_CENT + ", g AS (SELECT list(m ORDER BY i) AS g FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM points) GROUP BY i)), bt AS (SELECT sum(n * list_distance(c, g) ** 2) AS b, count(*) AS k FROM cent, g), wt AS (SELECT sum(list_distance(e, c) ** 2) AS w, count(*) AS n FROM points p JOIN cent ON p.label = cent.label) SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM bt, wt")
def h8_calinski_harabasz(v: Iam) -> DataFrame:
    return metrics.calinski_harabasz(v.points, v.point_labels)


@query("SELECT (SELECT count(*) FROM roles) AS num_roles, count(*) FILTER (effective_label = -1) AS num_noise, round(100.0 * count(*) FILTER (effective_label = -1) / count(*), 6) AS noise_pct, round(100 - 100.0 * count(*) FILTER (effective_label = -1) / count(*), 6) AS user_coverage_pct FROM effective")
def h9_coverage_metrics(v: Iam) -> DataFrame:
    r = _roles(v)
    return metrics.coverage_metrics(roles.effective_labels(v.labels, r), r)


@query("SELECT round(avg(size), 6) AS avg_size, round(stddev_pop(size), 6) AS std_size, min(size) AS min_size, max(size) AS max_size, round(avg(permission_count), 6) AS avg_permission_count, min(permission_count) AS min_permission_count, max(permission_count) AS max_permission_count, round(avg(cohesion), 6) AS avg_cohesion, round(min(cohesion), 6) AS min_cohesion, round(max(cohesion), 6) AS max_cohesion, round(avg(coverage), 6) AS avg_coverage, round(min(coverage), 6) AS min_coverage, round(max(coverage), 6) AS max_coverage FROM roles")
def h10_role_metrics(v: Iam) -> DataFrame:
    return metrics.role_metrics(_roles(v))


@query(", s AS (SELECT role, list(permission_id) AS p FROM role_perms GROUP BY role) SELECT round(coalesce(avg(len(list_intersect(a.p, b.p)) / len(list_distinct(a.p || b.p))::DOUBLE), 0), 6) AS role_overlap FROM s a JOIN s b ON a.role < b.role")
def h11_role_overlap(v: Iam) -> DataFrame:
    return metrics.role_overlap(_role_perms(v))


@query("SELECT round(coalesce((SELECT sum(permission_count) / sum(original_permissions)::DOUBLE FROM roles), 0), 6) AS system_coverage, (SELECT count(DISTINCT permission_id) FROM role_perms) AS unique_role_permissions, round(1 - (SELECT count(DISTINCT permission_id) FROM role_perms) / (SELECT count(*) FROM permissions)::DOUBLE, 6) AS compression")
def h12_permission_compression(v: Iam) -> DataFrame:
    return metrics.permission_compression(_roles(v), _role_perms(v), v.permissions.agg(F.count(F.lit(1)).alias("n")))


def _shown(col: str, table: str, out: str) -> str:
    return f"(SELECT role, string_agg(CAST({col} AS VARCHAR), ', ' ORDER BY {col}) FILTER (r <= 3) || CASE WHEN max(n) > 3 THEN ' (+' || (max(n) - 3) || ')' ELSE '' END AS {out} FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY {col}) AS r, count(*) OVER (PARTITION BY role) AS n FROM {table}) GROUP BY role)"


@query(f", ru AS (SELECT role, user_id FROM labels JOIN roles USING (label)) SELECT role, size, permission_count, round(100 * cohesion, 6) AS cohesion_pct, round(100 * coverage, 6) AS coverage_pct, users, coalesce(permissions, '') AS permissions FROM roles LEFT JOIN {_shown('user_id', 'ru', 'users')} USING (role) LEFT JOIN {_shown('permission_id', 'role_perms', 'permissions')} USING (role)")
def h13_roles_table(v: Iam) -> DataFrame:
    r = _roles(v)
    return roles.roles_table(r, roles.role_users(v.labels, r), _role_perms(v))


@query(", m AS (SELECT label, 'position' AS attribute, position AS value FROM labels JOIN users USING (user_id) UNION ALL SELECT label, 'department', department FROM labels JOIN users USING (user_id)) SELECT label, attribute, value, count(*) AS n, row_number() OVER (PARTITION BY label, attribute ORDER BY count(*) DESC, value) AS rank FROM m GROUP BY label, attribute, value")
def h14_members_profile(v: Iam) -> DataFrame:
    return roles.members_profile(v.labels, v.users)


def _at(v: Iam, grouping: int, impact: float) -> DataFrame:
    r = roles.extract_roles(v.up, v.labels, grouping, impact)
    return metrics.coverage_metrics(roles.effective_labels(v.labels, r), r).crossJoin(metrics.role_metrics(r).select("avg_size", "avg_permission_count"))


def _at_sql(model: str, ord_: int, grouping: int, impact: float) -> str:
    return f"SELECT '{model}' AS model, CAST({ord_} AS BIGINT) AS ord, count(*) AS num_roles, (SELECT count(*) FROM labels) - coalesce(sum(size), 0) AS num_noise, avg(size) AS avg_size, avg(pc) AS avg_permission_count FROM (SELECT s.label, s.size, count(*) FILTER (frequency >= {impact} - 1e-12) AS pc FROM sizes s JOIN freq f ON f.label = s.label WHERE s.size >= {grouping} GROUP BY s.label, s.size)"


_MODELS = f", m AS ({_at_sql('small', 0, 50, 0.3)} UNION ALL {_at_sql('large', 1, 60, 0.3)} UNION ALL {_at_sql('loose', 2, 40, 0.2)}), c AS (SELECT model, ord, num_roles, CAST(num_noise AS BIGINT) AS num_noise, 100.0 * num_noise / (SELECT count(*) FROM labels) AS noise_pct, avg_size, avg_permission_count FROM m)"


def _compared(v: Iam) -> DataFrame:
    return compare.compare_models({"small": _at(v, 50, 0.3), "large": _at(v, 60, 0.3), "loose": _at(v, 40, 0.2)})


@query(_MODELS + " SELECT model, ord, num_roles, num_noise, round(noise_pct, 6) AS noise_pct, round(100 - noise_pct, 6) AS user_coverage_pct, round(avg_size, 6) AS avg_size, round(avg_permission_count, 6) AS avg_permission_count FROM c")
def h15_compare_models(v: Iam) -> DataFrame:
    return _compared(v)


@query(_MODELS + ", s AS (SELECT model, ord, 0.1 + 0.05 * ord AS sil, 100 * (0.1 + 0.05 * ord) + (100 - noise_pct) + greatest(0, 20 - abs(num_roles - 10)) AS b FROM c) SELECT (SELECT model FROM s ORDER BY sil DESC, ord LIMIT 1) AS best_silhouette, model AS most_balanced, round(b, 6)::DOUBLE AS balance FROM s ORDER BY b DESC, ord LIMIT 1")
def h16_recommend_model(v: Iam) -> DataFrame:
    return compare.recommend_model(_compared(v).withColumn("silhouette", 0.1 + 0.05 * F.col("ord")))


def _by_category(v: Iam) -> DataFrame:
    """(id, embedding): which share of a user's applications each category has."""
    share = [F.avg((F.col("permission_id") % 5 == c).cast("double")) for c in range(5)]
    return v.app_rights.groupBy(F.col("user_id").alias("id")).agg(F.array(*share).alias("embedding"))


def _scored(v: Iam, points: DataFrame, model: str, ord_: int, grouping: int, impact: float) -> DataFrame:
    r = roles.extract_roles(v.up, v.labels, grouping, impact)
    own = roles.effective_labels(v.labels, r).select(F.col("user_id").alias("id"), F.col("effective_label").alias("label"))
    score = metrics.silhouette_squared(points, own).withColumnRenamed("silhouette_squared", "silhouette")
    return metrics.coverage_metrics(roles.effective_labels(v.labels, r), r).crossJoin(score).select(F.lit(model).alias("model"), F.lit(ord_).alias("ord"), "num_roles", "noise_pct", "silhouette")


_SHARES = ", ".join(f"avg(CASE WHEN permission_id % 5 = {c} THEN 1.0::DOUBLE ELSE 0 END)" for c in range(5))
_SCORED = _MODELS + f", e AS (SELECT user_id, [{_SHARES}] AS e FROM ap GROUP BY user_id), kept AS (SELECT 0 AS ord, label FROM sizes WHERE size >= 50 UNION ALL SELECT 1, label FROM sizes WHERE size >= 60 UNION ALL SELECT 2, label FROM sizes WHERE size >= 40), pt AS (SELECT ord, user_id, l.label, e FROM labels l JOIN kept ON kept.label = l.label JOIN e USING (user_id)), pd AS (SELECT a.ord, a.user_id, a.label AS own, b.label, sum(list_distance(a.e, b.e) ** 2) AS t, count(*) AS n FROM pt a JOIN pt b ON a.ord = b.ord GROUP BY ALL), ps AS (SELECT ord, user_id, max(n) FILTER (own = label) AS size, max(t / (n - 1)) FILTER (own = label) AS a, min(t / n) FILTER (own <> label) AS b FROM pd GROUP BY ord, user_id), sil AS (SELECT ord, avg(CASE WHEN size > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS sil FROM ps GROUP BY ord)"


@query(_SCORED + ", s AS (SELECT model, c.ord, coalesce(sil, 0) AS sil, 100 * coalesce(sil, 0) + (100 - noise_pct) + greatest(0, 20 - abs(num_roles - 10)) AS b FROM c LEFT JOIN sil ON sil.ord = c.ord) SELECT (SELECT model FROM s ORDER BY sil DESC, ord LIMIT 1) AS best_silhouette, model AS most_balanced, round(b, 6)::DOUBLE AS balance FROM s ORDER BY b DESC, ord LIMIT 1")
def h16_recommend_measured(v: Iam) -> DataFrame:
    """The three role models of h15 with silhouettes measured on the users' shares of applications by category."""
    points = cut(_by_category(v))
    every = [("small", 0, 50, 0.3), ("large", 1, 60, 0.3), ("loose", 2, 40, 0.2)]
    return compare.recommend_model(reduce(DataFrame.unionByName, [_scored(v, points, *m) for m in every]))


@query('SELECT role AS "Role", permission_id AS "Permission", round(frequency, 6) AS "Frequency", frequency >= 0.3 - 1e-12 AS "Meets_Impact_Threshold" FROM freq JOIN roles USING (label)')
def a7_role_details(v: Iam) -> DataFrame:
    return io.role_details(roles.role_permissions(v.up, v.labels, _roles(v), IMPACT, all_=True))


# ---- users left over ----


@query(", s AS (SELECT n.user_id, rp.role, count(*) AS b FROM noise n JOIN up ON up.user_id = n.user_id JOIN role_perms rp ON rp.permission_id = up.permission_id GROUP BY n.user_id, rp.role), j AS (SELECT s.user_id, s.role, b / ((SELECT count(*) FROM up WHERE up.user_id = s.user_id) + (SELECT count(*) FROM role_perms p WHERE p.role = s.role) - b)::DOUBLE AS sim FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, length(role), role) AS r FROM j) SELECT user_id, role, round(sim, 6) AS similarity FROM k WHERE r = 1 AND sim >= 0.1 - 1e-12")
def e5_assign_noise(v: Iam) -> DataFrame:
    return roles.assign_noise_nearest(v.up, _noise(v), _role_perms(v), least=0.1)


@query("SELECT 'MicroRole_' || (row_number() OVER (ORDER BY n.user_id) - 1) AS role, n.user_id, coalesce(string_agg(CAST(permission_id AS VARCHAR), ',' ORDER BY permission_id), '') AS permissions, CAST(1 AS BIGINT) AS size, 1.0::DOUBLE AS cohesion, 1.0::DOUBLE AS coverage FROM noise n LEFT JOIN up ON up.user_id = n.user_id GROUP BY n.user_id")
def e6_micro_roles(v: Iam) -> DataFrame:
    return roles.micro_roles(v.up, _noise(v)).withColumn("permissions", F.array_join("permissions", ","))


@query("SELECT n.user_id, count(permission_id) AS permission_count, (SELECT greatest(0, count(*) - 10) FROM noise) AS remaining FROM (SELECT user_id FROM noise ORDER BY user_id LIMIT 10) n LEFT JOIN up ON up.user_id = n.user_id GROUP BY n.user_id")
def e7_flag_noise(v: Iam) -> DataFrame:
    return roles.flag_noise(v.up, _noise(v))


# ---- similarity and DBSCAN, on applications ----

_AP = ", s AS (SELECT user_id, count(*) AS n FROM ap GROUP BY user_id), o AS (SELECT x.user_id AS a, y.user_id AS b, count(*) AS b2 FROM ap x JOIN ap y ON x.permission_id = y.permission_id AND x.user_id < y.user_id GROUP BY x.user_id, y.user_id), sim AS (SELECT a, b, b2 / (sa.n + sb.n - b2)::DOUBLE AS jac, b2 / sqrt(sa.n * sb.n) AS cos, sqrt(sa.n + sb.n - 2 * b2) AS euc FROM o JOIN s sa ON sa.user_id = a JOIN s sb ON sb.user_id = b)"


@query(_AP + " SELECT a, b, round(jac, 6) AS value FROM sim WHERE jac >= 0.85 - 1e-9")
def e1_similarity_join(v: Iam) -> DataFrame:
    return similarity.similarity_join(v.app_rights, "jaccard", 0.85)


@query()
def e1_minhash_join(v: Iam) -> DataFrame:
    """The first of these by MinHash: its pairs are a subset of the exact ones, which SQL can't choose."""
    return similarity.similarity_join(v.app_rights, "jaccard", 0.85, mode="minhash")


@query(_AP + ", l AS (SELECT a, b FROM sim WHERE jac >= 0.85 - 1e-9 UNION ALL SELECT b, a FROM sim WHERE jac >= 0.85 - 1e-9), p AS (SELECT user_id, min(user_id) OVER (PARTITION BY perms) AS profile FROM (SELECT user_id, list_sort(list(permission_id)) AS perms FROM ap GROUP BY user_id)) SELECT p.user_id, p.profile, count(l.b) AS links FROM p LEFT JOIN l ON l.a = p.user_id GROUP BY p.user_id, p.profile")
def e1_similarity_links(v: Iam) -> DataFrame:
    return similarity.similarity_links(v.app_rights, "jaccard", 0.85)


@query(_AP + " SELECT a, b, round(cos, 6) AS value FROM sim WHERE cos >= 0.93 - 1e-9")
def e1_cosine_join(v: Iam) -> DataFrame:
    return similarity.similarity_join(v.app_rights, "cosine", 0.93)


@query(_AP + ", z AS (SELECT x.user_id AS a, y.user_id AS b, sqrt(x.n + y.n) AS euc FROM s x JOIN s y ON x.user_id < y.user_id AND x.n + y.n <= 3 WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.a = x.user_id AND o.b = y.user_id)) SELECT a, b, round(euc, 6) AS value FROM sim WHERE euc <= 1.5 + 1e-9 UNION ALL SELECT a, b, round(euc, 6) FROM z WHERE euc <= 1.5")
def e1_euclidean_join(v: Iam) -> DataFrame:
    return similarity.similarity_join(v.app_rights, "euclidean", 1.5)


_KD = ", s AS (SELECT user_id, count(*) AS n FROM up GROUP BY user_id), o AS (SELECT x.user_id AS a, y.user_id AS b, count(*) AS b2 FROM up x JOIN up y ON x.permission_id = y.permission_id GROUP BY x.user_id, y.user_id), d AS (SELECT a, b, 1 - b2 / (sa.n + sb.n - b2)::DOUBLE AS d FROM o JOIN s sa ON sa.user_id = a JOIN s sb ON sb.user_id = b), k AS (SELECT a AS user_id, d, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM d)"


@query(_KD + " SELECT user_id, round(d, 6) AS distance FROM k WHERE r = 5")
def e2_k_distance(v: Iam) -> DataFrame:
    return similarity.k_distance(v.up, 5)


@query(_KD + ", q AS (SELECT d FROM k WHERE r = 5) SELECT CAST(0 AS BIGINT) AS ord, 0.3::DOUBLE AS eps UNION ALL SELECT i + 1, round(quantile_cont(d, 0.5 + 0.05 * i), 4) FROM q, (SELECT unnest(range(0, 10)) AS i) GROUP BY i".replace("quantile_cont(d, 0.5 + 0.05 * i)", "CASE i " + " ".join(f"WHEN {i} THEN quantile_cont(d, {(50 + 5 * i) / 100})" for i in range(10)) + " END"))
def e3_suggest_eps(v: Iam) -> DataFrame:
    return similarity.suggest_eps(similarity.k_distance(v.up, 5), 0.7)


@query(_KD + " SELECT CAST(r AS BIGINT) AS min_samples, round(quantile_cont(d, 0.95), 3) AS eps FROM k WHERE r IN (3, 5, 10) GROUP BY r")
def e4_suggest_dbscan(v: Iam) -> DataFrame:
    return similarity.suggest_dbscan(v.up)


@query("""
, RECURSIVE_MARK
s AS (SELECT user_id, count(*) AS n FROM ap GROUP BY user_id),
e AS (SELECT x.user_id AS a, y.user_id AS b FROM ap x JOIN ap y ON x.permission_id = y.permission_id JOIN s sa ON sa.user_id = x.user_id JOIN s sb ON sb.user_id = y.user_id GROUP BY x.user_id, y.user_id, sa.n, sb.n HAVING count(*) / (sa.n + sb.n - count(*))::DOUBLE >= 0.8 - 1e-9),
core AS (SELECT a FROM e GROUP BY a HAVING count(*) >= 4),
ce AS (SELECT a, b FROM e WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
reach AS (SELECT a, a AS r FROM core UNION SELECT ce.a, reach.r FROM ce JOIN reach ON ce.b = reach.a),
comp AS (SELECT a, min(r) AS c FROM reach GROUP BY a),
num AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS k FROM (SELECT DISTINCT c FROM comp)),
lab AS (SELECT a, k FROM comp JOIN num USING (c)),
bord AS (SELECT e.a, min(k) AS k FROM e JOIN lab ON e.b = lab.a WHERE e.a NOT IN (SELECT a FROM core) GROUP BY e.a)
SELECT user_id, CAST(coalesce(lab.k, bord.k, -1) AS BIGINT) AS label FROM s LEFT JOIN lab ON lab.a = user_id LEFT JOIN bord ON bord.a = user_id""".replace("RECURSIVE_MARK\n", ""))
def f6_dbscan(v: Iam) -> DataFrame:
    return clustering.dbscan(v.app_rights, eps=0.2, min_samples=4, metric="jaccard")


# ---- K-means and refinement ----


@query(", c AS (SELECT l.label, permission_id, count(*) / any_value(n)::DOUBLE AS value FROM up JOIN labels l USING (user_id) JOIN (SELECT label, count(*) AS n FROM labels GROUP BY label) z ON z.label = l.label GROUP BY l.label, permission_id), c2 AS (SELECT label, sum(value ** 2) AS c2 FROM c GROUP BY label), n AS (SELECT user_id, count(*) AS n FROM up GROUP BY user_id), uc AS (SELECT user_id, label, sum(value) AS uc FROM up JOIN c USING (permission_id) GROUP BY user_id, label), d AS (SELECT n.user_id, c2.label, n - 2 * coalesce(uc, 0) + c2 AS d2 FROM n CROSS JOIN c2 LEFT JOIN uc ON uc.user_id = n.user_id AND uc.label = c2.label), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(d2, 9), label) AS r FROM d) SELECT user_id, label, round(d2, 6) AS d2 FROM k WHERE r = 1")
def f2_assign_to_centroids(v: Iam) -> DataFrame:
    return clustering.assign_sparse(v.up, clustering.sparse_centroids(v.up, v.labels))


@query()
def f1_kmeans(v: Iam) -> DataFrame:
    return clustering.kmeans(v.points, 10, n_init=2, max_iter=20)[0]


@query()
def f3_sweep_k(v: Iam) -> DataFrame:
    return clustering.sweep_k(v.points, range(4, 13, 4), n_init=1)


_SWEEP = """
, ks AS (SELECT unnest(range(2, 9)) AS k), p AS (SELECT k, id, label % k AS label, e FROM points, ks),
cent AS (SELECT k, label, list(m ORDER BY i) AS c FROM (SELECT k, label, i, avg(x) AS m FROM (SELECT k, label, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM p) GROUP BY k, label, i) GROUP BY k, label),
near AS (SELECT p.k, p.label, sum(list_distance(e, c) ** 2) AS w, avg(list_distance(e, c)) AS s, any_value(c) AS c FROM p JOIN cent ON p.k = cent.k AND p.label = cent.label GROUP BY p.k, p.label),
db AS (SELECT k, avg(r) AS db FROM (SELECT a.k, a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM near a JOIN near b ON a.k = b.k AND a.label <> b.label GROUP BY a.k, a.label) GROUP BY k),
far AS (SELECT a.id, a.label AS own, b.label, sum(list_distance(a.e, b.e) ** 2) AS t, count(*) AS n FROM points a, points b GROUP BY a.id, a.label, b.label),
fk AS (SELECT k, id, own % k AS own, label % k AS label, sum(t) AS t, sum(n) AS n FROM far, ks GROUP BY 1, 2, 3, 4),
sp AS (SELECT k, id, max(n) FILTER (own = label) AS size, max(t / (n - 1)) FILTER (own = label) AS a, min(t / n) FILTER (own <> label) AS b FROM fk GROUP BY k, id),
sil AS (SELECT k, avg(CASE WHEN size > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM sp GROUP BY k),
s AS (SELECT k, inertia, silhouette, db FROM (SELECT k, sum(w) AS inertia FROM near GROUP BY k) JOIN sil USING (k) JOIN db USING (k))"""


def _sweep(v: Iam) -> DataFrame:
    """Seven coarsenings of the points' own labels, scored."""
    return metrics.sweep_scores(v.points, {k: v.point_labels.select("id", (F.col("label") % k).alias("label")) for k in range(2, 9)})


@query(_SWEEP + ", x AS (SELECT k, silhouette, (inertia - (SELECT min(inertia) FROM s)) / (SELECT max(inertia) - min(inertia) FROM s) AS x FROM s), d AS (SELECT k, silhouette, round(x - 2 * lag(x, 1) OVER (ORDER BY k) + lag(x, 2) OVER (ORDER BY k), 12) AS d FROM x), e AS (SELECT k AS e FROM d WHERE d IS NOT NULL ORDER BY d DESC, k LIMIT 1), b AS (SELECT k AS b FROM d ORDER BY silhouette DESC, k LIMIT 1) SELECT CAST(e AS BIGINT) AS elbow_k, CAST(b AS BIGINT) AS silhouette_k, CAST(CASE WHEN abs(e - b) <= 2 THEN b ELSE e END AS BIGINT) AS chosen_k FROM e, b")
def f4_choose_k(v: Iam) -> DataFrame:
    return clustering.choose_k(cut(_sweep(v)))


@query()
def f4_tuned_k(v: Iam) -> DataFrame:
    """A real sweep over the points and the k that follows from it."""
    return clustering.choose_k(clustering.sweep_k(v.points, range(2, 13, 2), n_init=1))


@query("SELECT greatest(2, count(*) // 9) AS k, greatest(5, count(*) // 100) AS k_embeddings FROM users")
def f5_default_k(v: Iam) -> DataFrame:
    n = v.users.count()
    return v.spark.createDataFrame([(clustering.default_k(n, 3), clustering.default_k(n, 3, embeddings=True))], "k long, k_embeddings long")


@query()
def f7_hierarchical(v: Iam) -> DataFrame:
    return clustering.hierarchical(v.points, 10, micro=60)


@query()
def f8_spectral(v: Iam) -> DataFrame:
    return clustering.spectral(v.points, 10)


@query()
def f8_neighbours(v: Iam) -> DataFrame:
    """The nearest ten by random projections; SQL can't say which of them a projection finds."""
    return neighbours.nearest_likely(v.points, 10)


@query()
def f9_cluster_auto(v: Iam) -> DataFrame:
    return clustering.cluster_auto(v.points, 10)


@query(", d AS (SELECT a.label, sum(list_distance(a.e, b.e)) AS t, count(*) AS m FROM points a JOIN points b ON a.label = b.label AND a.id <> b.id GROUP BY a.label) SELECT CAST(label AS BIGINT) AS label, round(1 / (1 + t / m), 6) AS quality FROM d")
def f10_cluster_quality(v: Iam) -> DataFrame:
    return refine.cluster_quality(v.points, v.point_labels)


@query(", d AS (SELECT a.label, avg(list_distance(a.e, b.e) ** 2) AS m FROM points a JOIN points b ON a.label = b.label AND a.id <> b.id GROUP BY a.label) SELECT CAST(label AS BIGINT) AS label, round(1 / (1 + sqrt(m)), 6) AS quality FROM d")
def f10_cluster_quality_squared(v: Iam) -> DataFrame:
    return refine.cluster_quality_squared(v.points, v.point_labels)


@query(_CENT + ", m AS (SELECT p.id, arg_min(cent.label, round(list_distance(p.e, c), 9)) AS new FROM points p, cent WHERE p.label % 3 = 0 AND cent.label % 3 <> 0 GROUP BY p.id) SELECT p.id, CAST(coalesce(m.new, p.label) AS BIGINT) AS label FROM points p LEFT JOIN m ON m.id = p.id")
def f11_reassign(v: Iam) -> DataFrame:
    quality = v.point_labels.select("label").distinct().withColumn("quality", F.when(F.col("label") % 3 == 0, 0.1).otherwise(0.9))
    return refine.reassign_low_quality(v.points, v.point_labels, quality)


@query(_CENT + ", d AS (SELECT a.label, 1 / (1 + sqrt(avg(list_distance(a.e, b.e) ** 2))) AS q FROM points a JOIN points b ON a.label = b.label AND a.id <> b.id GROUP BY a.label), good AS (SELECT label FROM d WHERE q >= (SELECT avg(q) FROM d)), m AS (SELECT p.id, arg_min(cent.label, round(list_distance(p.e, c), 9)) AS new FROM points p, cent WHERE p.label NOT IN (SELECT label FROM good) AND cent.label IN (SELECT label FROM good) GROUP BY p.id) SELECT p.id, CAST(coalesce(m.new, p.label) AS BIGINT) AS label FROM points p LEFT JOIN m ON m.id = p.id")
def f11_reassign_measured(v: Iam) -> DataFrame:
    """Points of the clusters whose measured quality is below the mean go to the others."""
    quality = cut(refine.cluster_quality_squared(v.points, v.point_labels))
    mean = quality.agg(F.avg("quality")).first()[0] or 0.0
    return refine.reassign_low_quality(v.points, v.point_labels, quality, mean)


@query(_CENT + " SELECT CAST(a.label AS BIGINT) AS a, CAST(b.label AS BIGINT) AS b, round(list_dot_product(a.c, b.c), 6) AS similarity FROM cent a JOIN cent b ON a.label < b.label WHERE list_dot_product(a.c, b.c) > 0.0")
def f12_similar_clusters(v: Iam) -> DataFrame:
    return refine.similar_clusters(v.points, v.point_labels, 0.0)


@query()
def f12_merge_clusters(v: Iam) -> DataFrame:
    return refine.merge_similar_clusters(v.points, v.point_labels, 0.0)


@query()
def f13_refine(v: Iam) -> DataFrame:
    return refine.refine(v.points, v.point_labels, iterations=2, least=0.4)


@query(_SWEEP + ", t AS (SELECT k, silhouette, db, 100 * silhouette - 10 * db AS score FROM s) SELECT CAST(k AS BIGINT) AS k, round(silhouette, 6) AS silhouette, round(db, 6) AS davies_bouldin, round(score, 6) AS score, k = (SELECT k FROM t ORDER BY score DESC, k LIMIT 1) AS best FROM t")
def f14_combined_score(v: Iam) -> DataFrame:
    return refine.combined_score(cut(_sweep(v).drop("inertia")))


@query()
def f14_tune_embedding_k(v: Iam) -> DataFrame:
    return refine.tune_embedding_k(v.points, 5, n_init=1)


# ---- factors ----


@query()
def g1_nmf(v: Iam) -> DataFrame:
    return factor.nmf(v.up, 5, max_iter=5)[0]


@query()
def g1_nmf_spectral_start(v: Iam) -> DataFrame:
    return factor.nmf(v.up, 5, max_iter=5, start="nndsvda")[0]


@query("SELECT user_id, CAST(role_id AS BIGINT) AS role_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, role_id) AS r FROM w) WHERE r = 1")
def g2_dominant_role(v: Iam) -> DataFrame:
    return factor.dominant_role(v.weights)


_TOP = ", t AS (SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY weight DESC, permission_id) AS r FROM h WHERE weight > 0)"


@query(_TOP + " SELECT CAST(role_id AS BIGINT) AS role_id, string_agg(CAST(permission_id AS VARCHAR), ',' ORDER BY r) AS permissions, round(sum(weight), 6) AS total_weight FROM t WHERE r <= 10 GROUP BY role_id")
def g3_role_definitions(v: Iam) -> DataFrame:
    return factor.role_definitions(v.factor).withColumn("permissions", F.array_join("permissions", ","))


@query(_TOP + " SELECT CAST(role_id AS BIGINT) AS role_id, r AS rank, t.permission_id, perm_name, app_name, round(weight, 6) AS weight FROM t LEFT JOIN permissions USING (permission_id) LEFT JOIN applications USING (application_id) WHERE r <= 10")
def g4_top_permissions(v: Iam) -> DataFrame:
    return factor.role_top_permissions(v.factor, v.permissions, v.applications)


@query(_TOP + ", n AS (SELECT role_id, app_name, min(r) AS r FROM t JOIN permissions USING (permission_id) JOIN applications USING (application_id) WHERE r <= 10 GROUP BY role_id, app_name), q AS (SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY r) AS k FROM n) SELECT CAST(role_id AS BIGINT) AS role_id, string_agg(app_name, ', ' ORDER BY k) AS apps FROM q WHERE k <= 4 GROUP BY role_id")
def g4_dominant_apps(v: Iam) -> DataFrame:
    return factor.dominant_apps(factor.role_top_permissions(v.factor, v.permissions, v.applications))


@query("SELECT user_id, coalesce(string_agg(CAST(role_id AS VARCHAR), ',' ORDER BY weight DESC, role_id) FILTER (weight > 0.1), '') AS roles FROM w GROUP BY user_id")
def g5_user_roles(v: Iam) -> DataFrame:
    return factor.user_roles(v.weights).withColumn("roles", F.array_join("roles", ","))


_SHARES = ", s AS (SELECT user_id, role_id, CASE WHEN sum(weight) OVER (PARTITION BY user_id) > 0 THEN weight / sum(weight) OVER (PARTITION BY user_id) ELSE 0 END AS share FROM w), y AS (SELECT user_id, role_id, share FROM s WHERE share > 0.151)"


@query(_SHARES + " SELECT user_id, CAST(role_id AS BIGINT) AS role_id, round(share, 6) AS share FROM y")
def g6_multi_role_labels(v: Iam) -> DataFrame:
    return factor.multi_role_labels(v.weights, 0.151)


@query(_SHARES + " SELECT CAST(role_id AS BIGINT) AS role_id, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM users), 6) AS pct, 100.0 * count(*) / (SELECT count(*) FROM users) < 1 AS too_rare FROM y GROUP BY role_id")
def g7_role_distribution(v: Iam) -> DataFrame:
    return factor.role_distribution(factor.multi_role_labels(v.weights, 0.151), v.users)


@query("SELECT CAST(role_id AS BIGINT) AS role_id, string_agg(CAST(permission_id AS VARCHAR), ',' ORDER BY permission_id) AS permissions, count(*) AS n FROM h WHERE weight > 0.5 GROUP BY role_id")
def g8_active_permissions(v: Iam) -> DataFrame:
    return factor.active_permissions(v.factor, 0.5).withColumn("permissions", F.array_join("permissions", ","))


@query(", y AS (SELECT w.user_id, h.permission_id, sum(w.weight * h.weight) / 2 AS y FROM w JOIN h USING (role_id) GROUP BY w.user_id, h.permission_id), c AS (SELECT y, CASE WHEN up.user_id IS NULL THEN 0.0 ELSE 1.0 END AS x FROM y LEFT JOIN up ON up.user_id = y.user_id AND up.permission_id = y.permission_id) SELECT round(avg((x - y) ** 2), 6)::DOUBLE AS mse, round(avg(CASE WHEN (y > 0.5) = (x = 1) THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy FROM c")
def g10_reconstruction(v: Iam) -> DataFrame:
    return factor.reconstruction_quality(v.up, v.weights.withColumn("weight", F.col("weight") / 2), v.factor)


@query()
def g9_tune_components(v: Iam) -> DataFrame:
    return factor.tune_components(v.app_rights, most=3, max_iter=3)[0]


# ---- graph and embeddings ----

_EDGES = ", e AS (SELECT user_id, permission_id, ln((SELECT count(*) FROM users) / (c + 1)::DOUBLE) + 1 AS weight FROM up JOIN (SELECT permission_id, count(*) AS c FROM up GROUP BY permission_id) USING (permission_id))"


@query(_EDGES + " SELECT user_id, permission_id, round(weight, 6) AS weight FROM e")
def i1_bipartite_edges(v: Iam) -> DataFrame:
    return graph.bipartite_edges(v.up, v.users)


@query(_EDGES + " SELECT (SELECT count(*) FROM users) + (SELECT count(*) FROM permissions) AS nodes, count(*) AS edges, round(avg(weight), 6) AS avg_weight, round(2 * count(*) / ((SELECT count(*) FROM users) * (SELECT count(*) FROM permissions))::DOUBLE, 6) AS density FROM e")
def i2_graph_stats(v: Iam) -> DataFrame:
    return graph.graph_stats(graph.bipartite_edges(v.up, v.users), v.users, v.permissions)


@query()
def i3_svd_embeddings(v: Iam) -> DataFrame:
    return graph.svd_embeddings(v.up, v.users, 16)[0]


@query()
def i4_random_walks(v: Iam) -> DataFrame:
    return graph.random_walks(graph.bipartite_edges(v.up, v.users), 1, 6)


@query()
def i5_walk_embeddings(v: Iam) -> DataFrame:
    return graph.walk_embeddings(graph.random_walks(graph.bipartite_edges(v.app_rights, v.users), 1, 6), v.users, 8)


@query()
def i6_nmf_embeddings(v: Iam) -> DataFrame:
    return graph.nmf_embeddings(v.app_rights, v.users, 4)


@query()
def i7_ensemble(v: Iam) -> DataFrame:
    a = graph.svd_embeddings(v.app_rights, v.users, 8)[0]
    return graph.ensemble_embeddings([a, a.select("id", F.reverse("embedding").alias("embedding"))], 4)


@query("SELECT id, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first_value, round(sqrt(list_dot_product(e, e)), 4) AS norm FROM points")
def i8_l2_normalise(v: Iam) -> DataFrame:
    unit = graph.l2_normalise(v.points).select("id", F.col("embedding")[0].alias("first_value"))
    return unit.join(v.points.select("id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm")), "id")


@query(", n AS (SELECT sqrt(list_dot_product(e, e)) AS n FROM points) SELECT round(avg(n), 6) AS mean_norm, round(stddev_pop(n), 6) AS std_norm FROM n")
def i8_norm_stats(v: Iam) -> DataFrame:
    return graph.norm_stats(v.points)


# ---- predictors ----


@query()
def j1_role_classifier(v: Iam) -> DataFrame:
    roles_ = factor.dominant_role(v.weights)
    _, accuracy, out = predict.train_role_classifier(v.users, roles_, trees=10)
    return out.select("user_id", "role_id", F.col("prediction").cast("long").alias("predicted"))


@query(", y AS (SELECT role_id, CASE WHEN weight > 0.5 THEN 1 ELSE 0 END AS y FROM w) SELECT CAST(role_id AS BIGINT) AS role_id, CAST(y AS BIGINT) AS y, round(sum(count(*)) OVER (PARTITION BY role_id) / (2 * count(*))::DOUBLE, 6) AS weight FROM y GROUP BY role_id, y")
def j2_balance_weights(v: Iam) -> DataFrame:
    return predict.balance_weights(v.weights.select("user_id", "role_id", (F.col("weight") > 0.5).cast("long").alias("y")))


@query()
def j2_multi_role(v: Iam) -> DataFrame:
    y = factor.multi_role_labels(v.weights)
    role_ids = [r["role_id"] for r in y.select("role_id").distinct().orderBy("role_id").collect()]
    return predict.role_probabilities(predict.train_multi_role(v.users, y, role_ids), v.users)


@query()
def j3_mlp(v: Iam) -> DataFrame:
    model, _ = predict.train_mlp(v.users, v.labels.where("label <> -1").select("user_id", F.col("label").alias("role_id")))
    return model.transform(v.users).select("user_id", F.col("prediction").cast("long").alias("predicted"))


@query()
def j4_permission_predictor(v: Iam) -> DataFrame:
    columns = ("department", "location")
    models = predict.train_permission_predictor(v.users, catalog.permission_lists(v.rights, v.users), columns)
    return predict.predict_permissions(models, v.users, columns, 0.25)


_P = ", pr AS (SELECT user_id, role_id, (user_id * (role_id + 7)) % 17 / 16.0::DOUBLE AS p FROM w)"


def _probabilities(v: Iam) -> DataFrame:
    return v.weights.select("user_id", "role_id", ((F.col("user_id") * (F.col("role_id") + 7)) % 17 / 16.0).alias("p"))


@query(_P + " SELECT user_id, CAST(role_id AS BIGINT) AS role_id, round(p, 6) AS p, '[' || role_id || '] ' || CASE role_id WHEN 0 THEN 'Reader' WHEN 1 THEN 'Writer' ELSE 'not named' END AS title FROM pr WHERE p >= 0.25")
def j5_recommend_roles(v: Iam) -> DataFrame:
    names = v.spark.createDataFrame([(0, "Reader"), (1, "Writer")], "role_id int, name string")
    return predict.recommend_roles(_probabilities(v), names)


@query("SELECT user_id, p.application_id, p.permission_id FROM users u JOIN applications a ON a.app_name = 'Access Badge System - ' || u.location JOIN permissions p ON p.application_id = a.application_id WHERE perm_name = 'access_building'")
def j6_location_badge(v: Iam) -> DataFrame:
    return predict.location_badge_rule(v.users, v.applications, v.permissions)


@query(_P + ", c AS (SELECT user_id, max(p) AS confidence FROM pr GROUP BY user_id) SELECT user_id, round(confidence, 6) AS confidence, CASE WHEN confidence > 0.8 THEN 'auto' ELSE 'review' END AS route FROM c")
def j7_route(v: Iam) -> DataFrame:
    return predict.route_by_confidence(_probabilities(v).groupBy("user_id").agg(F.max("p").alias("confidence")))


@query("SELECT user_id, CASE WHEN user_id % 10 = 0 THEN (label + 1) % 5 ELSE label END AS role_id, CAST(CASE WHEN user_id % 10 = 0 THEN 5 ELSE 1 END AS BIGINT) AS weight FROM labels")
def j8_feedback(v: Iam) -> DataFrame:
    train = v.labels.select("user_id", F.col("label").alias("role_id"))
    return predict.apply_feedback(train, train.where("user_id % 10 = 0").select("user_id", ((F.col("role_id") + 1) % 5).alias("corrected_role")))


@query()
def j8_refit(v: Iam) -> DataFrame:
    """The predictor fitted again after reviewers moved the largest cohort's users to the next one."""
    train = v.labels.where("label <> -1").select("user_id", F.col("label").alias("role_id"))
    most = train.groupBy("role_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "role_id"))["role_id"].alias("role_id"))
    roles_ = train.agg(F.max("role_id")).first()[0] + 1
    feedback = train.join(F.broadcast(most), "role_id").select("user_id", ((F.col("role_id") + 1) % roles_).alias("corrected_role"))
    before, _ = predict.train_mlp(v.users, train)
    return predict.refit_with_feedback(v.users, train, feedback, before)[2]


_Y = _P + ", t AS (SELECT user_id, role_id FROM w WHERE weight > 0.5), g AS (SELECT user_id, role_id FROM pr WHERE p > 0.5), c AS (SELECT coalesce(t.role_id, g.role_id) AS label, count(*) FILTER (t.role_id IS NOT NULL AND g.role_id IS NOT NULL) AS tp, count(*) FILTER (t.role_id IS NULL) AS fp, count(*) FILTER (g.role_id IS NULL) AS fn FROM t FULL JOIN g ON t.user_id = g.user_id AND t.role_id = g.role_id GROUP BY 1)"


def _truth(v: Iam) -> DataFrame:
    return v.weights.where("weight > 0.5").select(F.col("user_id").alias("id"), F.col("role_id").alias("label"))


def _guess(v: Iam) -> DataFrame:
    return _probabilities(v).where("p > 0.5").select(F.col("user_id").alias("id"), F.col("role_id").alias("label"))


@query(_Y + " SELECT CAST(label AS BIGINT) AS label, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, tp + fn AS support FROM c")
def j9_per_label(v: Iam) -> DataFrame:
    return metrics.per_label_scores(metrics.multilabel_counts(_truth(v), _guess(v)))


@query(_Y + ", x AS (SELECT user_id FROM t FULL JOIN g USING (user_id, role_id) WHERE (SELECT count(*) FROM t a WHERE a.user_id = user_id) >= 0), wrong AS (SELECT DISTINCT user_id FROM ((SELECT * FROM t EXCEPT SELECT * FROM g) UNION ALL (SELECT * FROM g EXCEPT SELECT * FROM t))), s AS (SELECT sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, sum(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)) / 6 AS m FROM c), n AS (SELECT count(*)::DOUBLE AS n FROM users) SELECT round(1 - (SELECT count(*) FROM wrong) / n, 6) AS subset_accuracy, round((fp + fn) / (n * 6), 6) AS hamming_loss, round(m, 6) AS f1_macro, round(tp / (tp + fp), 6) AS precision_micro, round(tp / (tp + fn), 6) AS recall_micro, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_micro FROM s, n".replace(", x AS (SELECT user_id FROM t FULL JOIN g USING (user_id, role_id) WHERE (SELECT count(*) FROM t a WHERE a.user_id = user_id) >= 0)", ""))
def j9_multilabel_metrics(v: Iam) -> DataFrame:
    return metrics.multilabel_metrics(_truth(v), _guess(v), v.users.select("user_id"), 6)


@query(_P + ", c AS (SELECT count(*) FILTER (NOT y AND NOT g) AS tn, count(*) FILTER (NOT y AND g) AS fp, count(*) FILTER (y AND NOT g) AS fn, count(*) FILTER (y AND g) AS tp FROM (SELECT w.weight > 0.5 AS y, p >= 0.45 AS g FROM w JOIN pr USING (user_id, role_id))) SELECT tn, fp, fn, tp, round(fp / (fp + tn)::DOUBLE, 6) AS over_rate, round(fn / (fn + tp)::DOUBLE, 6) AS under_rate FROM c")
def j10_provisioning_rates(v: Iam) -> DataFrame:
    pred = v.weights.join(_probabilities(v), ["user_id", "role_id"]).select((F.col("weight") > 0.5).cast("int").alias("y"), "p")
    return metrics.provisioning_rates(pred)


@query(", g AS (SELECT user_id, role FROM labels JOIN roles USING (label)), gp AS (SELECT user_id, permission_id FROM g JOIN role_perms USING (role)), r AS (SELECT user_id, permission_id FROM up WHERE user_id IN (SELECT user_id FROM g)), b AS (SELECT coalesce(r.user_id, gp.user_id) AS user_id, r.user_id IS NOT NULL AS real, gp.user_id IS NOT NULL AS given FROM r FULL JOIN gp ON r.user_id = gp.user_id AND r.permission_id = gp.permission_id), p AS (SELECT user_id, count(*) FILTER (given AND NOT real) / nullif(count(*) FILTER (given), 0)::DOUBLE AS o, count(*) FILTER (real AND NOT given) / nullif(count(*) FILTER (real), 0)::DOUBLE AS u FROM b GROUP BY user_id) SELECT g.user_id, round(coalesce(o, 0), 6) AS over, round(coalesce(u, 0), 6) AS under FROM g LEFT JOIN p ON p.user_id = g.user_id".replace('AS over,', 'AS "over",').replace("AS under FROM", 'AS "under" FROM'))
def j11_provisioning_gap(v: Iam) -> DataFrame:
    granted = roles.role_users(v.labels, _roles(v)).select("user_id", "role")
    return metrics.provisioning_gap(v.up, granted, _role_perms(v))


@query()
def j11_predicted_gap(v: Iam) -> DataFrame:
    """The whole way: factors to roles and labels, a forest that predicts them, and each test user's gap under the predicted role."""
    w, h, _ = factor.nmf(v.up, 5, max_iter=20)
    weights = cut(h)
    _, _, predicted = predict.train_role_classifier(v.users, cut(factor.dominant_role(w)))
    granted = cut(predicted.select("user_id", F.col("prediction").cast("int").alias("role")))
    return metrics.provisioning_gap(v.up, granted, weights.where("weight > 0.01").select(F.col("role_id").alias("role"), "permission_id"))


# ---- synthetic data, as many users as the tables have ----


@query()
def k1_generate(v: Iam) -> DataFrame:
    users = generate.generate_users(v.spark, v.users.count())
    apps = cut(generate.generate_applications(v.spark))
    perms = cut(generate.generate_permissions(apps))
    rules = generate.draw_group_rules(v.spark, perms, apps)
    return generate.provision_rights(users, rules, perms, apps)


@query("SELECT user_id, 'G' || (user_id % 3) AS grp, permission_id FROM users JOIN permissions p ON p.application_id % 3 = user_id % 3 AND perm_name = 'promo'")
def k3_base_rights(v: Iam) -> DataFrame:
    rules = v.permissions.where("perm_name = 'promo'").select(F.concat(F.lit("G"), (F.col("application_id") % 3).cast("string")).alias("group"), "application_id", "permission_id")
    named = v.users.withColumn("position", (F.col("user_id") % 3).cast("string"))
    groups = v.spark.createDataFrame([(str(i), f"G{i}") for i in range(3)], "position string, group string")
    out = generate.base_rights(named, rules, groups)
    return out.select("user_id", F.concat(F.lit("G"), (F.col("user_id") % 3).cast("string")).alias("grp"), "permission_id")
