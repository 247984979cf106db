"""Column expressions, cut lineage, and bounded broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast by name; larger ones are left to Spark.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only in local mode, where none is set."""
    context = spark.sparkContext
    set_ = context._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (set_.get() if set_.isDefined() else None)
    if not found:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
    if not set_.isDefined():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few enough rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def vector_sum(array: str) -> Column:
    """The element-wise sum of arrays of doubles, as a vector, combined before it is shuffled."""
    return Summarizer.sum(array_to_vector(array))


def jaccard(both: Column, a: Column, b: Column) -> Column:
    """From sizes of the intersection and of both sets; two empty sets are alike."""
    return F.when(a + b == 0, 1.0).otherwise(both / (a + b - both))


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(empty))


def squared(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def unit(x: Column) -> Column:
    """x with length 1; zero stays zero."""
    n = F.sqrt(squared(x))
    return F.when(n > 0, F.transform(x, lambda v: v / n)).otherwise(x)


def hash_uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and key alone, not on partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)) / F.lit(float(1 << 52))
