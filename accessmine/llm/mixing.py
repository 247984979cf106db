"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessmine.llm.common import WORD, stored

#: Blocks into which all words are cut (besides one for each source): the second bounds the tree's rows.
BLOCKS = (1 << 12, 1 << 20)
BLOCK_WORDS = 1_000_000
#: Words of an output shard, and most shards.
SHARD_WORDS, SHARDS = 4_000_000, 1 << 16
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """totals (source, source_size, ...) with the words each source should give, ``target``.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` of
    all words; none gets over ``most`` times its size, and the excess goes to the others by
    weight. With sources in the order in which they fill up, the level that they share
    follows from running sums: the first source that stays below its limit sets it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    t = totals.withColumn("_w", weight.cast("double")).withColumn("_cap", F.lit(most) * F.col("source_size"))
    t = t.withColumn("_all", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
    fills = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    t = t.withColumn("_before", F.coalesce(F.sum("_cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("_open", F.sum("_w").over(fills.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_open"))
    free = F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), "_level"))
    t = t.withColumn("_found", F.min(free).over(Window.partitionBy())["_level"])
    target = F.when(F.col("_found").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_found") * F.col("_w")))
    return t.withColumn("target", target).drop("_w", "_cap", "_all", "_before", "_open", "_level", "_found")


def shards_of(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """Each drawn block copy with its ``shard``, by splitting the quotas in two, again and again.

    A node splits its blocks between the shards of its left and right half: of its blocks
    in random order as many go left as the left shards take. How many of each source go
    left is then multivariate hypergeometric, and every source's quota is met exactly.
    """
    levels = max(1, shards - 1).bit_length()
    out = blocks.withColumn("_lo", F.lit(0)).withColumn("_n", F.lit(shards))
    for level in range(levels):
        node = Window.partitionBy("_lo")
        draw = F.xxhash64(F.lit(seed), F.lit(level), "_source_key", "_block", "_epoch")
        out = out.withColumn("_at", F.row_number().over(node.orderBy(draw, "_source_key", "_block", "_epoch"))).withColumn("_of", F.count(F.lit(1)).over(node))
        half = F.floor(F.col("_n") / 2)
        left = (F.col("_n") > 1) & (F.col("_at") <= F.round(F.col("_of") * half / F.col("_n")))
        out = out.select(
            *[c for c in out.columns if c not in ("_lo", "_n", "_at", "_of")],
            F.when((F.col("_n") <= 1) | left, F.col("_lo")).otherwise(F.col("_lo") + half).cast("int").alias("_lo"),
            F.when(F.col("_n") <= 1, F.col("_n")).when(left, half).otherwise(F.col("_n") - half).cast("int").alias("_n"),
        )
    return out.withColumnRenamed("_lo", "shard").drop("_n")


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, blocks: int | None = None, shards: int | None = None, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(sources with targets, draws) for sizes (doc_id, source, size, _h).

    A source's documents are dealt over its blocks by a hash. A target takes every block as
    many whole times as it covers the source, and then one part of the source: blocks in
    random order, as many as fit, and the head of the next, whose last document is cut to
    the word. draws has a row for each time a document is taken: doc_id, _h, epoch, take
    (words), shard, place (order within the shard).
    """
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    goals = targets(totals, weights, share, most).withColumn("_source_key", key)
    all_words = F.sum("source_size").over(Window.partitionBy())
    cut = F.lit(blocks) if blocks else F.greatest(F.lit(BLOCKS[0]), F.least(F.lit(BLOCKS[1]), F.floor(all_words / BLOCK_WORDS)))
    goals = goals.withColumn("_blocks", F.greatest(F.lit(1), F.least(F.floor(F.col("source_size") * cut / F.greatest(all_words, F.lit(1))), F.floor(F.col("_docs") / 4))).cast("long"))
    goals = goals.withColumn("_full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0).cast("long"))
    goals = goals.withColumn("_rest", F.greatest(F.lit(0), F.round(F.col("target")) - F.col("_full") * F.col("source_size")).cast("long"))
    goals = stored(goals, "mix-sources")
    if shards is None:
        words = goals.agg(F.sum("target")).first()[0] or 0
        shards = int(min(SHARDS, max(8, words // SHARD_WORDS)))
    where = goals.select("_source_key", "_blocks")
    dealt = sizes.withColumn("_source_key", key).join(where, "_source_key").withColumn("_block", F.pmod(F.col("_h"), F.col("_blocks")))
    dealt = dealt.select("doc_id", "size", "_h", "_source_key", "_block")
    block = dealt.groupBy("_source_key", "_block").agg(F.sum("size").alias("_words"))
    shuffled = Window.partitionBy("_source_key").orderBy(F.xxhash64(F.lit(seed), "_source_key", "_block"), "_block")
    block = block.withColumn("_ahead", F.sum("_words").over(shuffled) - F.col("_words")).join(goals.select("_source_key", "_full", "_rest"), "_source_key")
    part = F.greatest(F.lit(0), F.least(F.col("_words"), F.col("_rest") - F.col("_ahead")))
    copies = F.array_append(F.transform(F.sequence(F.lit(1), F.greatest(F.col("_full"), F.lit(1))), lambda k: F.struct(k.alias("e"), F.when(k <= F.col("_full"), F.col("_words")).otherwise(0).cast("long").alias("q"))), F.struct((F.col("_full") + 1).alias("e"), part.cast("long").alias("q")))
    drawn = block.select("_source_key", "_block", "_words", F.explode(copies).alias("_c")).select("_source_key", "_block", "_words", F.col("_c.e").alias("_epoch"), F.col("_c.q").alias("_quota")).where("_quota > 0")
    drawn = shards_of(drawn, shards, seed)
    order = Window.partitionBy("_source_key", "_block", "_epoch").orderBy(F.xxhash64(F.lit(seed + 1), "_h", "_epoch"), "doc_id", "size")
    rows = dealt.where("size > 0").join(drawn, ["_source_key", "_block"])
    whole = rows.where("_quota = _words").withColumn("take", F.col("size"))
    head = rows.where("_quota < _words").withColumn("_ahead", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    head = head.withColumn("take", F.least(F.col("size"), F.col("_quota") - F.col("_ahead"))).where("take > 0").drop("_ahead")
    place = F.xxhash64(F.lit(seed + 2), "shard", "_h", "doc_id", "_epoch")
    draws = whole.unionByName(head).select("doc_id", "_h", F.col("_epoch").alias("epoch"), "take", "size", "shard", place.alias("place"))
    return goals, draws


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash of each row: the one pass over the texts."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("_h"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a row for each time, cut where only a part is taken.

    Columns of docs, in shards, shuffled within each. Documents without words are never
    taken. Null sources form one source, the last; rows that repeat a doc_id and its text
    are drawn alike, by the largest take of any; texts of any length are cut at words only;
    columns may have any names beside; an empty table gives an empty result.
    """
    sizes = stored(sized(docs), "mix-sizes")
    _, draws = plan(sizes, **options)
    # rows that repeat are drawn alike: where one was cut and another not, by the larger take
    most = F.max(F.struct("take", "shard", "place", "size")).alias("_m")
    draws = draws.groupBy("doc_id", "_h", "epoch").agg(most).select("doc_id", "_h", "_m.*")
    own = docs.select(F.struct("*").alias("_doc"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("_h"))
    draws = draws.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_hh"), "take", "size", "shard", "place")
    out = own.join(draws, (own["_h"] == draws["_hh"]) & own["doc_id"].eqNullSafe(draws["_id"]))
    tokens = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    head = F.array_join(F.slice(tokens, F.lit(1), F.greatest(F.lit(1), F.col("take")).cast("int")), "")
    text = F.when(F.col("take") >= F.col("size"), F.col("text")).otherwise(head)
    out = out.withColumn("text", text).repartition("shard").sortWithinPartitions("shard", "place")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (doc_id, text, source).

    Null texts have no words and are never taken, null sources form one source, the last; of
    rows that repeat a doc_id and its text each has an equal share of what they give
    together. Texts count whole; other columns, whatever their names, are not read; an empty
    table gives an empty result.
    """
    sizes = stored(sized(docs), "mix-sizes")
    goals, draws = plan(sizes, **options)
    taken = draws.groupBy(F.col("doc_id").alias("_id"), "_h").agg(F.sum("take").alias("_taken"))
    rows = sizes.withColumn("_source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).join(goals.select("_source_key", "source_size", "target"), "_source_key")
    times = sizes.groupBy(F.col("doc_id").alias("_id"), "_h").agg(F.count(F.lit(1)).alias("_rows"))
    taken = taken.join(times, taken._h.eqNullSafe(times._h) & taken._id.eqNullSafe(times._id)).select(taken._id, taken._h.alias("_hh"), F.floor(F.col("_taken") / F.col("_rows")).alias("_taken"))
    out = rows.join(taken, (rows._h == taken._hh) & rows.doc_id.eqNullSafe(taken._id), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))
