"""Contiguous shards of nearly equal bytes, from global prefix sums of byte sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessmine.llm.common import fresh, numbered, own_ids, stored

SHARDS = 16
#: Rows of a part whose total enters the prefix sums, and the most parts that one task adds up.
PART_ROWS, PARTS = 200_000, 1 << 14
#: Rows that one output file of a shard holds, by target.
FILE_ROWS = 100_000


def byte_size(text: Column) -> Column:
    """Bytes of the text and one for its end; null has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _placed(rows: DataFrame, order: list[str], shards: int) -> DataFrame:
    """rows (size, ...) with shard and slot: in the order given, cut at equal shares of all bytes.

    Rows are dealt by ranges into parts. A part's rows need only the bytes and rows of the
    parts before it, which come from one total for each part. A row goes to the shard in
    whose share its middle byte lies, so a shard misses its share by half a row at each end
    at most. The shards' first rows make 'slot' begin at 0.
    """
    spark = rows.sparkSession
    n = rows.count()
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(PARTS, max(4 * wide, -(-n // PART_ROWS)))
    rows = stored(rows.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order]).withColumn("_part", F.spark_partition_id()), "shard-parts")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(F.sum("size").alias("_b"), F.count(F.lit(1)).alias("_n"))
    ahead = totals.select(
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_bytes"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"),
        F.sum("_b").over(Window.partitionBy()).alias("_all"),
    )
    within = Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    rows = rows.withColumn("_upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(within) - 1)
    # a row for each part, PARTS at most
    rows = rows.join(F.broadcast(ahead), F.col("_part") == F.col("_p"))
    middle = 2 * (F.col("_bytes") + F.col("_upto")) - F.col("size")
    shard = F.call_function("div", middle * F.lit(shards).cast("long"), 2 * F.col("_all")).cast("int")
    rows = rows.withColumn("shard", shard).withColumn("_at", F.col("_rows") + F.col("_nth"))
    rows = stored(rows.drop("_upto", "_nth", "_p", "_bytes", "_rows", "_all", "_part"), "shard-rows")
    first = rows.groupBy(F.col("shard").alias("_s")).agg(F.min("_at").alias("_first"))
    # a row for each shard
    return rows.join(F.broadcast(first), F.col("shard") == F.col("_s")).withColumn("slot", F.col("_at") - F.col("_first")).drop("_s", "_first", "_at")


def shard_plan(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text).

    Law 'bytes': in order of doc_id (null first; then of checksum and size), shards are
    contiguous and their bytes near equal. A null text has no bytes; every row counts one
    more for its end, so empty texts spread too. Rows that repeat a doc_id and a text are
    interchangeable and get slots of their own; texts of any length count whole and stay
    whole. With fewer rows than shards some shards are empty; an empty table gives an empty
    result. Other columns, whatever their names, are not read. ``grown_shard`` is null, as
    cuts at equal shares move when shards are added.
    """
    own = F.monotonically_increasing_id().alias("_own")
    rows = docs.select("doc_id", byte_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), own)
    out = _placed(stored(rows, "shard-sizes"), ["doc_id", "text_crc32", "size", "_own"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with ``shard`` and ``slot`` in front, or names like these that docs doesn't have.

    Shards and slots as in shard_plan; rows without a doc_id of their own go by a number.
    The rows' order within a shard is that of slot.
    """
    if own_ids(docs):
        key, rows = "doc_id", docs
    else:
        key = fresh(docs, "_row")
        rows = numbered(docs, key)
    sizes = stored(rows.select("doc_id", byte_size(F.col("text")).alias("size"), F.col(key).alias("_key")), "shard-sizes")
    placed = _placed(sizes, ["doc_id", "_key"], shards).select(F.col("_key").alias("_k"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    out = rows.select(F.struct(*[rows[c] for c in docs.columns]).alias("_doc"), F.col(key).alias("_key")).join(placed, F.col("_key") == F.col("_k"))
    names = [fresh(docs, "shard"), fresh(docs, "slot")]
    return out.select(F.col("_shard").alias(names[0]), F.col("_slot").alias(names[1]), *[F.col("_doc").getField(c).alias(c) for c in docs.columns])


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """docs as Parquet, a folder for each shard; each file holds a stretch of slots, in order.

    A shard is written by as many tasks as it has stretches, so its size bounds no task.
    """
    out = sharded(docs, shards)
    shard, slot = out.columns[:2]
    stretch = F.floor(F.col(slot) / FILE_ROWS)
    out = out.repartition(shard, stretch).sortWithinPartitions(shard, slot)
    out.write.partitionBy(shard).parquet(path)
