"""Seeded synthetic access rights of any size: the same rows whatever the partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accessmine.functions.common import hash_uniform, small

#: Locations, contract types and seniority levels with their shares.
LOCATIONS = ("Paris", "Toulouse", "Nantes", "Lyon", "Marseille", "Strasbourg", "Montpellier", "Bordeaux", "Rouen")
CONTRACTS = (("CDI", 0.5), ("CDD", 0.2), ("Stage", 0.15), ("Apprentissage", 0.1), ("Interim", 0.05))
SENIORITY = (("Junior", 0.5), ("Medium", 0.3), ("Senior", 0.15), ("Lead", 0.04), ("Executive", 0.01))
#: Positions of each group, and how many permissions of which pools all its members get.
GROUPS = {
    "IT": (("Sysadmin", "Dev", "DevOps", "Architect", "IT Support", "Security Engineer", "DBA"), (("it", 6), ("hr", 1))),
    "HR": (("HR Manager", "Recruiter", "Payroll Specialist"), (("hr", 5), ("pay", 2))),
    "Finance": (("Accountant", "Financial Analyst", "Payroll Manager"), (("pay", 5), ("it", 1))),
    "Facilities": (("Facility Manager", "Receptionist", "Cleaner", "Security Guard"), (("buildings", 4),)),
    "Sales": (("Sales Rep", "Account Manager", "Sales Manager"), (("it", 2), ("buildings", 1))),
    "R&D": (("Researcher", "Scientist", "Engineer"), (("it", 3),)),
    "Product": (("Product Manager", "Product Owner", "Business Analyst"), (("it", 3),)),
    "Legal": (("Legal Counsel",), (("it", 2),)),
    "Intern": (("Intern",), (("it", 2),)),
}
#: The categories of each pool, and the applications of each category besides the badge systems.
POOLS = {"it": ("DEVOPS", "ITSM", "SECURITY", "DATA"), "hr": ("HR",), "pay": ("PAYROLL", "FINANCE"), "buildings": ("FACILITIES",)}
CATEGORIES = {"COLLAB": 6, "HR": 3, "PAYROLL": 3, "FINANCE": 2, "CRM": 3, "DEVOPS": 5, "ITSM": 1, "SECURITY": 4, "DATA": 4, "ERP": 2, "DOCS": 3, "FACILITIES": 1}
#: What permissions of a category are about; names are an action and one of these.
THINGS = {
    "COLLAB": ("meeting", "post", "room"), "HR": ("profile", "contract", "leave"), "PAYROLL": ("salary", "bonus", "slip"),
    "FINANCE": ("ledger", "budget", "claim"), "CRM": ("contact", "deal", "campaign"), "DEVOPS": ("branch", "build", "release", "board"),
    "ITSM": ("incident", "asset", "change"), "SECURITY": ("account", "policy", "finding"), "DATA": ("table", "chart", "model", "query"),
    "ERP": ("stock", "delivery", "supplier"), "DOCS": ("file", "page", "drive"), "FACILITIES": ("badge", "visit", "room"),
}
BASIC = ("view", "edit", "approve", "admin")
ACTIONS = ("add", "archive", "assign", "close", "copy", "delete", "export", "import", "list", "lock", "move", "print", "share")
#: Permissions of an application: a Poisson number of this mean, but its five basic ones at least.
MEAN_PERMISSIONS = 9


def _choice(u: Column, shares) -> Column:
    total = sum(s for _, s in shares)
    out, upto = None, 0.0
    for value, share in shares:
        upto += share / total
        out = F.when(u < upto, F.lit(value)) if out is None else out.when(u < upto, F.lit(value))
    return out.otherwise(F.lit(shares[-1][0]))


def generate_users(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    ids = spark.range(1, n + 1).withColumnRenamed("id", "user_id")
    u = lambda k: hash_uniform(seed + k, F.col("user_id"))
    positions = [(p, 5.0 if g == "Intern" else 20.0) for g, (ps, _) in GROUPS.items() for p in ps]
    out = ids.withColumn("position", _choice(u(1), positions))
    department = F.create_map(*[F.lit(x) for g, (ps, _) in GROUPS.items() for p in ps for x in (p, f"Department {g}")])
    out = out.withColumn("department", department[F.col("position")])
    out = out.withColumn("location", _choice(u(2), [(x, 1.0) for x in LOCATIONS]))
    return out.withColumn("contract_type", _choice(u(3), CONTRACTS)).withColumn("seniority", _choice(u(4), SENIORITY))


def generate_applications(spark: SparkSession, locations: tuple[str, ...] = LOCATIONS) -> DataFrame:
    """(application_id, app_name, category): a badge system for each location, then the others, from 1."""
    names = [(f"Access Badge System - {x}", "FACILITIES") for x in locations] + [(f"{c} App {i}", c) for c, n in CATEGORIES.items() for i in range(1, n + 1)]
    return spark.createDataFrame([(i + 1, a, c) for i, (a, c) in enumerate(names)], "application_id long, app_name string, category string")


def _poisson(u: Column, mean: float) -> Column:
    """The Poisson number whose share of the distribution holds u in [0, 1)."""
    upto, term, steps = 0.0, math.exp(-mean), []
    for n in range(int(mean + 12 * mean**0.5) + 1):
        upto += term
        steps.append(F.lit(upto))
        term *= mean / (n + 1)
    return F.size(F.filter(F.array(*steps), lambda x: x <= u))


def generate_permissions(apps: DataFrame, seed: int = 42) -> DataFrame:
    """(application_id, permission_id, perm_name): five basic names and random ones, ids in order of name.

    Every application of category FACILITIES has access_building.
    """
    things = F.create_map(*[x for c, ts in THINGS.items() for x in (F.lit(c), F.array(*map(F.lit, ts)))])[F.col("category")]
    rows = apps.select("application_id", "category", F.coalesce(things, F.array(F.lit("record"), F.lit("report"), F.lit("entry"))).alias("things"))
    named = lambda actions: F.flatten(F.transform(F.array(*map(F.lit, actions)), lambda a: F.transform("things", lambda t: F.concat(a, F.lit("_"), t))))
    first = F.transform(F.array(*map(F.lit, BASIC)), lambda a: F.concat(a, F.lit("_"), F.col("things")[0]))
    building = F.when(F.col("category") == "FACILITIES", F.lit("access_building")).otherwise(F.lit("login"))
    basic = rows.select("application_id", F.explode(F.concat(F.array(building), first)).alias("perm_name"))
    drawn = rows.select("application_id", F.explode(named(ACTIONS)).alias("perm_name"))
    rank = F.row_number().over(Window.partitionBy("application_id").orderBy(hash_uniform(seed, F.col("application_id"), F.col("perm_name")), "perm_name"))
    wanted = _poisson(hash_uniform(seed + 1, F.col("application_id")), MEAN_PERMISSIONS) - (len(BASIC) + 1)
    drawn = drawn.withColumn("r", rank).where(F.col("r") <= wanted).select("application_id", "perm_name")
    order = Window.orderBy("application_id", "perm_name")
    return basic.unionByName(drawn).withColumn("permission_id", F.row_number().over(order).cast("long")).select("application_id", "permission_id", "perm_name")


def draw_group_rules(spark: SparkSession, perms: DataFrame, apps: DataFrame, seed: int = 42) -> DataFrame:
    """(group, application_id, permission_id): so many permissions of the group's pools, by a seeded rank."""
    want = spark.createDataFrame([(g, p, c, k) for g, (_, ps) in GROUPS.items() for p, k in ps for c in POOLS[p]], "group string, pool string, category string, k int")
    pool = want.join(apps, "category").join(perms, "application_id")
    rank = F.row_number().over(Window.partitionBy("group", "pool").orderBy(hash_uniform(seed, F.col("group"), F.col("permission_id")), "permission_id"))
    return pool.withColumn("r", rank).where("r <= k").select("group", "application_id", "permission_id")


def badge_rights(users: DataFrame, perms: DataFrame, apps: DataFrame) -> DataFrame:
    from accessmine.operators.predict import location_badge_rule

    return location_badge_rule(users, apps, perms)


def base_rights(users: DataFrame, rules: DataFrame, group_of: DataFrame) -> DataFrame:
    """Each user's group rights; group_of: (position, group)."""
    return users.join(small(group_of), "position").join(small(rules), "group").select("user_id", "application_id", "permission_id")


def provision_rights(users: DataFrame, rules: DataFrame, perms: DataFrame, apps: DataFrame, seed: int = 42) -> DataFrame:
    """Rights: group rules less 2 %, for 3 % of users one to three more, some of collaboration, the badge."""
    spark = users.sparkSession
    group_of = spark.createDataFrame([(p, g) for g, (ps, _) in GROUPS.items() for p in ps], "position string, group string")
    base = base_rights(users, rules, group_of).where(hash_uniform(seed, F.col("user_id"), F.col("permission_id")) >= 0.02)
    count = perms.count()
    ranked = small(perms.withColumn("i", F.row_number().over(Window.orderBy("permission_id")) - 1))
    extra = users.where(hash_uniform(seed + 1, F.col("user_id")) < 0.03).withColumn("k", F.explode(F.sequence(F.lit(1), (1 + F.floor(hash_uniform(seed + 2, F.col("user_id")) * 3)).cast("int"))))
    extra = extra.withColumn("i", F.floor(hash_uniform(seed + 3, F.col("user_id"), F.col("k")) * count).cast("int")).join(ranked, "i").select("user_id", "application_id", "permission_id")
    collab = perms.join(apps.where("category = 'COLLAB'").select("application_id"), "application_id", "left_semi")
    m = collab.count()
    collab = small(collab.withColumn("i", F.row_number().over(Window.orderBy("permission_id")) - 1))
    drawn = users.withColumn("k", F.explode(F.sequence(F.lit(1), (2 + F.floor(hash_uniform(seed + 4, F.col("user_id")) * 2)).cast("int"))))
    drawn = drawn.withColumn("i", F.floor(hash_uniform(seed + 5, F.col("user_id"), F.col("k")) * m).cast("int")).join(collab, "i").select("user_id", "application_id", "permission_id")
    return base.unionByName(extra).unionByName(drawn).unionByName(badge_rights(users, perms, apps)).distinct()
