"""Queries by name, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessmine.plans.iam_view import Iam, with_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Roles of the test view need so many users and such a share of holders.
GROUPING, IMPACT = 60, 0.3


def query(sql: str | None = None):
    """Register a function of an Iam view; doubles are rounded to 6 places in both results."""

    def add(f: Callable[[Iam], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(Iam(spark, sf_dir)))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = with_view(sql)
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places (and no negative zero), integers as long."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.round(c, places) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        cols.append(c.alias(name))
    return df.select(*cols)
