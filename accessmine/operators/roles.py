"""From labelled users to roles, and what becomes of the users left over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accessmine.functions.common import jaccard, ratio, small


def check_thresholds(similarity: float = 0.7, grouping: int = 3, impact: float = 0.8) -> None:
    if not 0 <= similarity <= 1 or not 0 <= impact <= 1:
        raise ValueError("similarity and impact must be between 0 and 1")
    if grouping < 1:
        raise ValueError("grouping must be at least 1")


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.where("label <> -1").groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def permission_frequencies(up: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, permission_id, holders, size, frequency) of every cluster."""
    held = labels.where("label <> -1").join(up, "user_id").groupBy("label", "permission_id").agg(F.count(F.lit(1)).alias("holders"))
    return held.join(cluster_sizes(labels), "label").withColumn("frequency", F.col("holders") / F.col("size"))


def extract_roles(up: DataFrame, labels: DataFrame, grouping: int = 3, impact: float = 0.8, strict: bool = False) -> DataFrame:
    """(role, label, size, permission_count, original_permissions, cohesion, coverage) of clusters large enough.

    A permission belongs to the role if at least ``impact`` of its users hold it. strict:
    roles without permissions go too, and roles are numbered from 1 by label.
    """
    check_thresholds(grouping=grouping, impact=impact)
    sizes = cluster_sizes(labels).where(F.col("size") >= grouping)
    inside = F.col("frequency") >= impact - 1e-12
    held = permission_frequencies(up, labels).groupBy("label").agg(
        F.count_if(inside).alias("permission_count"), F.count(F.lit(1)).alias("original_permissions"), F.avg(F.when(inside, F.col("frequency"))).alias("cohesion")
    )
    roles = sizes.join(held, "label", "left").na.fill(0, ["permission_count", "original_permissions"]).na.fill(0.0, ["cohesion"])
    roles = roles.withColumn("coverage", ratio(F.col("permission_count"), F.col("original_permissions")))
    name = F.col("label")
    if strict:
        roles = roles.where("permission_count > 0")
        name = F.row_number().over(Window.orderBy("label"))
    return roles.select(F.concat(F.lit("Role_"), name.cast("string")).alias("role"), "label", "size", "permission_count", "original_permissions", "cohesion", "coverage")


def role_permissions(up: DataFrame, labels: DataFrame, roles: DataFrame, impact: float = 0.8, all_: bool = False) -> DataFrame:
    """(role, permission_id, frequency, meets_impact); only those that meet it, or all."""
    freq = permission_frequencies(up, labels).join(roles.select("role", "label"), "label")
    out = freq.select("role", "permission_id", "frequency", (F.col("frequency") >= impact - 1e-12).alias("meets_impact"))
    return out if all_ else out.where("meets_impact")


def role_users(labels: DataFrame, roles: DataFrame) -> DataFrame:
    return labels.join(roles.select("role", "label"), "label").select("role", "user_id")


def effective_labels(labels: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, label, effective_label): -1 where the cluster gave no role."""
    kept = roles.select("label", F.lit(True).alias("_kept"))
    return labels.join(kept, "label", "left").select("user_id", "label", F.when(F.col("_kept"), F.col("label")).otherwise(-1).alias("effective_label"))


def rejected_clusters(labels: DataFrame, grouping: int = 3) -> DataFrame:
    out = cluster_sizes(labels).where(F.col("size") < grouping)
    return out.withColumn("reason", F.concat(F.lit("size "), F.col("size").cast("string"), F.lit(f" < {grouping}")))


def adjust_thresholds(up: DataFrame, labels: DataFrame, grouping: int, impact: float, from_labels: str = "original") -> DataFrame:
    """Roles at other thresholds without clustering anew; ``effective``: users rejected before stay out."""
    if from_labels == "effective":
        labels = labels.select("user_id", F.col("effective_label").alias("label"))
    return extract_roles(up, labels.select("user_id", "label"), grouping, impact)


def assign_noise_nearest(up: DataFrame, noise: DataFrame, role_perms: DataFrame, least: float = 0.3) -> DataFrame:
    """(user_id, role, similarity) for users of noise whose most similar role is similar enough; ties go to the first role."""
    own = up.join(noise.select("user_id"), "user_id", "left_semi")
    sizes = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    roles = role_perms.select("role", "permission_id")
    role_sizes = roles.groupBy("role").agg(F.count(F.lit(1)).alias("m"))
    both = own.join(small(roles), "permission_id").groupBy("user_id", "role").agg(F.count(F.lit(1)).alias("both"))
    sim = both.join(sizes, "user_id").join(small(role_sizes), "role").withColumn("similarity", jaccard(F.col("both"), F.col("n"), F.col("m")))
    best = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("similarity"), F.length("role"), "role"))
    return sim.withColumn("_r", best).where((F.col("_r") == 1) & (F.col("similarity") >= least - 1e-12)).select("user_id", "role", "similarity")


def micro_roles(up: DataFrame, noise: DataFrame) -> DataFrame:
    """(role, user_id, permissions, size, cohesion, coverage): one role for each user, in order of id."""
    lists = up.join(noise.select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(F.array_sort(F.collect_set("permission_id")).alias("permissions"))
    from accessmine.operators.catalog import dense_index

    out = dense_index(noise.select("user_id"), "user_id", "i").join(lists, "user_id", "left")
    one = F.lit(1.0)
    return out.select(F.concat(F.lit("MicroRole_"), F.col("i").cast("string")).alias("role"), "user_id", F.coalesce("permissions", F.array().cast("array<bigint>")).alias("permissions"), F.lit(1).cast("long").alias("size"), one.alias("cohesion"), one.alias("coverage"))


def flag_noise(up: DataFrame, noise: DataFrame, shown: int = 10) -> DataFrame:
    """(user_id, permission_count, remaining): the first users, and how many more there are."""
    counts = up.groupBy("user_id").agg(F.count(F.lit(1)).alias("permission_count"))
    out = noise.select("user_id").join(counts, "user_id", "left").na.fill(0, ["permission_count"])
    total = noise.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - shown).alias("remaining"))
    return out.orderBy("user_id").limit(shown).crossJoin(F.broadcast(total))


def roles_table(roles: DataFrame, members: DataFrame, perms: DataFrame, shown: int = 3) -> DataFrame:
    """Roles with their first users and permissions as text, "(+n)" for the rest."""

    def listed(df: DataFrame, col: str, out: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("role").orderBy(col))
        size = F.count(F.lit(1)).over(Window.partitionBy("role"))
        top = df.withColumn("_r", rank).withColumn("_n", size).where(F.col("_r") <= shown)
        text = F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("_r", col))), lambda x: x[col].cast("string")))
        more = F.when(F.max("_n") > shown, F.concat(F.lit(" (+"), (F.max("_n") - shown).cast("string"), F.lit(")"))).otherwise("")
        return top.groupBy("role").agg(F.concat(text, more).alias(out))

    out = roles.join(listed(members, "user_id", "users"), "role", "left").join(listed(perms, "permission_id", "permissions"), "role", "left")
    return out.select("role", "size", "permission_count", (100 * F.col("cohesion")).alias("cohesion_pct"), (100 * F.col("coverage")).alias("coverage_pct"), "users", F.coalesce("permissions", F.lit("")).alias("permissions"))


def members_profile(labels: DataFrame, users: DataFrame, columns: tuple[str, ...] = ("position", "department")) -> DataFrame:
    """(label, attribute, value, n, rank) of the members' attributes."""
    long = labels.join(users, "user_id").select("label", *columns).unpivot("label", list(columns), "attribute", "value")
    counts = long.groupBy("label", "attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("label", "attribute").orderBy(F.desc("n"), "value")).cast("long"))
