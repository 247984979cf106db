"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accessmine.llm.common import fresh, light_batches, long_lists, mixed, numbered, own_ids, shingle_sets, stored

#: Bands of so many coordinates: a pair of Jaccard 0.8 misses them all with a chance of 1.3e-7.
BANDS, ROWS = 40, 5
#: Size of the circle on which the second permutation is laid out.
CIRCLE = 1 << 22
#: Longs of a set's parity bitmap, in which each element flips one bit.
PARITY = 16

_circle: list[np.ndarray] = []


def _windows() -> np.ndarray:
    """Row s holds the second permutation at s, s+1, ...: all coordinates of an element at s."""
    if not _circle:
        order = np.random.default_rng(10).permutation(CIRCLE).astype(np.uint32)
        around = np.concatenate([order, order[: BANDS * ROWS]])
        _circle.append(np.lib.stride_tricks.sliding_window_view(around, BANDS * ROWS))
    return _circle[0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Every coordinate of the circulant MinHash of a set of 64-bit hashes.

    The first permutation scatters the set over the circle; the second, shifted by one
    place for each next coordinate, ranks it.
    """
    at = (mixed(shingles ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(42)).astype(np.int64)
    out = None
    for k in range(0, len(at), 4096):
        low = _windows()[at[k : k + 4096]].min(axis=0)
        out = low if out is None else np.minimum(out, low)
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, r])
    return key


def _sketches(size: int):
    kind = T.StructType([T.StructField(x, T.LongType()) for x in ("n", "a", "b")] + [T.StructField("bands", T.ArrayType(T.LongType()))])

    @F.arrow_udf(kind)
    def sketch(texts: pa.Array) -> pa.Array:
        n, a, b, bands = [], [], [], []
        with np.errstate(over="ignore"):
            for s in shingle_sets(texts, size):
                n.append(len(s))
                a.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                b.append(int(mixed(s + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                bands.append(_bands(signature(s)) if len(s) else s)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), long_lists(bands)], names=["n", "a", "b", "bands"])

    return sketch


def parity(shingles: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set: two sets differ in no fewer elements than their bitmaps in bits."""
    at = (mixed(shingles ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(64 * PARITY)).astype(np.int64)
    odd = (np.bincount(at, minlength=64 * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _sets(size: int):
    @F.arrow_udf("struct<s:array<bigint>,bits:array<bigint>>")
    def shingles(texts: pa.Array) -> pa.Array:
        rows = list(shingle_sets(texts, size))
        with np.errstate(over="ignore"):
            bits = [parity(s) for s in rows]
        return pa.StructArray.from_arrays([long_lists(rows), long_lists(bits)], names=["s", "bits"])

    return shingles


def components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of edges (a, b) with the smallest node it can reach.

    Rounds of large-star and small-star steps until the edges are stars around the
    smallest nodes; a hub's edges are spread over tasks by the join on it.
    """
    greatest, least = F.greatest("a", "b"), F.least("a", "b")
    edges = stored(edges.where("a <> b").select(greatest.alias("a"), least.alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("s").alias("_s"))
    b = sets.select(F.col("node").alias("b"), F.col("s").alias("_t"))
    both = F.size(F.array_intersect("_s", "_t"))
    return pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.size("_s") + F.size("_t") - both)).select("a", "b")


def _several(placed: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, of texts that are in two such buckets at least.

    Texts of Jaccard 0.8 share fewer than two buckets with a chance of 2.6e-6; what met in
    one bucket only has met by chance.
    """
    several = F.min("label").alias("_l"), F.max("label").alias("_h"), F.min("n").alias("_low")
    split = placed.groupBy("band", "bucket").agg(*several).where("_l <> _h").select("band", "bucket", "_low")
    rows = placed.drop("_low").join(split, ["band", "bucket"])
    often = rows.groupBy("node").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("node")
    return stored(rows.join(often, "node", "left_semi"), "open")


def _rest(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of texts in open buckets that may be linked across components.

    A link between sets of n and m shingles takes percent / (100 + percent) * (n + m) common
    ones. With shingles in order from rare to common, such sets share one of their first
    n - that + 1; a text with many shingles of its own has hardly others among these, so
    the copies of one text don't meet pair by pair. Of texts that meet, a pair becomes a row
    only if the bits in which their parity bitmaps differ leave room for a link, which is
    never wrong and keeps out nearly all pairs below the threshold.
    """
    nodes = open_.groupBy("node").agg(F.min("label").alias("label"), F.min("n").alias("n"), F.min("_low").alias("_low"))
    tokens = nodes.join(sets, "node").select("node", "label", "n", "_low", F.explode("s").alias("t"))
    # shingles of one component link nothing
    use = tokens.groupBy("t").agg(F.min("label").alias("_l"), F.max("label").alias("_h"), F.count(F.lit(1)).alias("f")).where("_l <> _h").select("t", "f")
    common = F.ceil(percent * (F.col("n") + F.greatest("_low", F.ceil(F.col("n") * percent / 100))) / (100 + percent))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("f", "t"))
    shared = tokens.join(use, "t").withColumn("r", rank).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("node")))
    # the shingles left out are the rarest: they fill the first places
    place = F.col("r") + F.col("n") - F.col("c")
    first = shared.where(place <= F.col("n") - common + 1).select("t", "node", "label", "n", place.alias("r")).join(sets.select("node", "bits"), "node").select("t", "node", "label", "n", "r", "bits")
    first = stored(first, "first")
    x, y = first.toDF("t", "a", "_la", "_na", "_ra", "_xa"), first.toDF("t", "b", "_lb", "_nb", "_rb", "_xb")
    both = F.col("_na") + F.col("_nb")
    # the first common shingle leaves room for so many common ones in either set
    room = 1 + F.least(F.col("_na") - F.col("_ra"), F.col("_nb") - F.col("_rb"))
    differ = sum((F.bit_count(F.col("_xa")[k].bitwiseXOR(F.col("_xb")[k])).cast("long") for k in range(PARITY)), F.lit(0))
    near = ((100 + percent) * room >= percent * both) & ((100 + percent) * (both - differ) >= 2 * percent * both)
    return x.join(y, "t").where((F.col("_la") > F.col("_lb")) & near).select("a", "b").distinct()


def _linked(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, n, component) of rows (id, text) with an id each: the smallest id that links reach.

    1. Equal sets make a class, by 128-bit fingerprints, with its smallest id in front.
    2. Classes that share a band meet in a bucket. Each is compared with the bucket's
       smallest; verified links give components. Classes in buckets that still hold
       several components are compared across components by an exact prefix filter, so no
       link is lost while copies of one text never meet pair by pair.
    """
    marked = stored(rows.select("id", _sketches(size)("text").alias("_k")).select("id", "_k.*"), "sketches")
    key = ["n", "a", "b"]
    classes = stored(marked.where("n > 0").groupBy(*key).agg(F.min("id").alias("node"), F.min_by("bands", "id").alias("bands")), "classes")
    spread = classes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    heads = spread.groupBy("band", "bucket").agg(F.min(F.struct("node", "n")).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(spread.join(heads.drop("size"), ["band", "bucket"]).select("band", "bucket", "node", "n", "head"), "members")
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    first = members.where((F.col("node") != F.col("head.node")) & fits(F.col("n"), F.col("head.n"))).select(F.col("node").alias("a"), F.col("head.node").alias("b")).distinct()
    first = stored(first, "pairs")
    wanted = members.select(F.col("node").alias("id")).distinct()
    sets = stored(rows.join(wanted, "id").select(F.col("id").alias("node"), _sets(size)("text").alias("_k")).select("node", "_k.*"), "sets")
    links = stored(_confirmed(first, sets, percent), "links")
    labels = components(links)
    # what is left: buckets that hold several components
    placed = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("band", "bucket", "node", "n", "label")
    rest = _rest(_several(_several(placed)), sets, percent)
    tried = first.unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    late = stored(_confirmed(rest.join(tried, ["a", "b"], "left_anti"), sets, percent), "links")
    if not late.isEmpty():
        labels = components(links.unionByName(late))
    ends = classes.select(*key, "node").join(labels, "node", "left").select(*key, F.coalesce("label", "node").alias("_label"))
    return marked.drop("bands").join(ends, key, "left").select("id", "n", F.coalesce("_label", "id").alias("component"))


def near_groups(docs: DataFrame, shingle_words: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Words are lower-cased in A-Z. Texts without words (null ones too) are linked with
    nothing. Every row is a text of its own, whatever its doc_id: rows that repeat a doc_id
    are linked by their texts only, component_id is the smallest doc_id of the rows that can
    be reached, and rows with that doc_id among them are kept. A row whose doc_id is null
    takes part in nothing and is kept. Other columns, whatever their names, are not read;
    texts may be of any length; an empty table gives an empty result.

    A link of Jaccard 0.8 is lost with a chance of 2.6e-6, where two texts share fewer than
    two of the 40 buckets.
    """
    rows = docs.select("doc_id", "text")
    if own_ids(rows):
        out = _linked(rows.withColumnRenamed("doc_id", "id"), shingle_words, percent)
        return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    rows = numbered(rows, "id")
    found = stored(_linked(rows.where("doc_id is not null").select("id", "text"), shingle_words, percent), "linked")
    found = found.join(rows.select("id", "doc_id"), "id")
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = found.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    apart = rows.where("doc_id is null").select("doc_id", _sketches(shingle_words)("text")["n"].alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(apart)


def near_deduplicated(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group; columns as they were.

    Where doc_ids are null or repeated, rows go by a number of their own, so that no text
    goes but for a near copy that stays, and of rows that repeat an id and a text one stays.
    """
    light_batches(docs.sparkSession)
    if own_ids(docs):
        own, rows = "doc_id", docs
    else:
        own = fresh(docs, "_row")
        rows = numbered(docs, own)
    gone = _linked(rows.select(F.col(own).alias("id"), "text"), shingle_words, percent).where("id <> component")
    gone = gone.select(F.col("id").alias(fresh(docs, "_gone")))
    return rows.join(gone, rows[own] == gone[gone.columns[0]], "left_anti").select(*[rows[c] for c in docs.columns])
