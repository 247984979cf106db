"""Exact deduplication by composable polynomial fingerprints."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessmine.llm.common import _LOW, fresh, light_batches, lowered, numbered, own_ids, stored, utf8

#: Two primes below 2**31: a product of residues fits 64 bits.
PRIMES = (2147483647, 2147483629)
BASES = (1160605487, 803217289)
#: Bytes that one dot product hashes.
CHUNK = 1 << 15
#: Characters from which a text counts as huge and is hashed by many tasks.
HUGE = 1 << 22
PART = 1 << 18

_tables: dict[tuple[int, int], np.ndarray] = {}


def _falling(base: int, prime: int) -> np.ndarray:
    """base**(CHUNK-1) ... base**0 modulo prime."""
    if (base, prime) not in _tables:
        row, x = np.empty(CHUNK, np.uint64), 1
        for k in range(CHUNK - 1, -1, -1):
            row[k], x = x, x * base % prime
        _tables[base, prime] = row
    return _tables[base, prime]


def joined(left: int, right: int, right_bytes: int, base: int, prime: int) -> int:
    """The fingerprint of a+b from those of a and b: a's is shifted by b's length."""
    return (left * pow(base, right_bytes, prime) + right) % prime


def polynomial(data: np.ndarray, base: int, prime: int) -> int:
    """The fingerprint of bytes, from their chunks'."""
    falling, out = _falling(base, prime), 0
    for k in range(0, len(data), CHUNK):
        part = data[k : k + CHUNK]
        # every byte counts as 1..256, so that leading zero bytes matter
        own = int(((part.astype(np.uint64) + np.uint64(1)) * falling[CHUNK - len(part) :]).sum() % np.uint64(prime))
        out = joined(out, own, len(part), base, prime)
    return out


def _fingerprints(primes: tuple[int, int], whole: bool):
    """Fingerprint of a text lower-cased in A-Z, with its SHA-256, or (whole) its bytes."""

    @F.arrow_udf("struct<fp:struct<n:bigint,a:bigint,b:bigint>," + ("own:binary>" if whole else "own:string>"))
    def fingerprint(texts: pa.Array) -> pa.Array:
        data, bounds = utf8(texts)
        spans, own = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)), []
        values: tuple[list[int], list[int]] = ([], [])
        for a, b in spans:
            low = _LOW[data[a:b]]
            for k in (0, 1):
                values[k].append(polynomial(low, BASES[k], primes[k]))
            own.append(low.tobytes() if whole else hashlib.sha256(low).hexdigest())
        fp = pa.StructArray.from_arrays([pa.array(np.diff(bounds), pa.int64()), *(pa.array(v, pa.int64()) for v in values)], names=["n", "a", "b"])
        return pa.StructArray.from_arrays([fp, pa.array(own, pa.binary() if whole else pa.string())], names=["fp", "own"])

    return fingerprint


def _shifts(primes: tuple[int, int]):
    """For parts of a huge text: their share of its fingerprint, given the bytes behind them."""

    @F.arrow_udf("struct<n:bigint,a:bigint,b:bigint>")
    def share(texts: pa.Array, behind: pa.Array) -> pa.Array:
        data, bounds = utf8(texts)
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), behind.to_pylist(), strict=True))
        cols = [pa.array(np.diff(bounds), pa.int64())]
        for base, prime in zip(BASES, primes, strict=True):
            cols.append(pa.array([polynomial(data[a:b], base, prime) * pow(base, rest, prime) % prime for a, b, rest in spans], pa.int64()))
        return pa.StructArray.from_arrays(cols, names=["n", "a", "b"])

    return share


def _length() -> Column:
    return F.length(F.coalesce("text", F.lit("")))


def _parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))


def _huge(docs: DataFrame, primes: tuple[int, int], huge: int) -> DataFrame:
    """(doc_id, text, _fp) of the huge texts, lower-cased.

    Their parts are hashed by as many tasks as there are, and their shifted hashes add up to the whole's.
    """
    rows = docs.where(_length() >= huge).select("doc_id", lowered(F.col("text")).alias("text"))
    rows = rows.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row"), _parts(F.col("text")).alias("_parts"))
    rows = rows.withColumn("_sizes", F.transform("_parts", lambda x: F.octet_length(x).cast("long")))
    upto = lambda i: F.aggregate(F.slice("_sizes", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    behind = F.transform("_sizes", lambda x, i: F.octet_length("_doc.text") - upto(i))
    # the row itself goes along with its first part only
    parts = rows.select("_row", "_doc", F.posexplode(F.arrays_zip(F.col("_parts").alias("part"), behind.alias("behind"))).alias("_at", "_p"))
    parts = parts.select("_row", "_at", F.when(F.col("_at") == 0, F.col("_doc")).alias("_doc"), F.col("_p")["part"].alias("_part"), F.col("_p")["behind"].alias("_behind"))
    shares = parts.repartition("_row", "_at").withColumn("_s", _shifts(primes)("_part", "_behind"))
    sums = F.struct(F.sum("_s.n").alias("n"), (F.sum("_s.a") % primes[0]).alias("a"), (F.sum("_s.b") % primes[1]).alias("b"))
    return shares.groupBy("_row").agg(F.first("_doc", ignorenulls=True).alias("_doc"), sums.alias("_fp")).select("_doc.*", "_fp")


def fingerprinted(docs: DataFrame, primes: tuple[int, int] = PRIMES, huge: int = HUGE) -> DataFrame:
    """(doc_id, _fp, text_sha256) of docs (doc_id, text), of texts lower-cased in A-Z: bytes and two residues, and SHA-256.

    A text of at least ``huge`` characters is hashed in parts, by many tasks.
    """
    small = docs.where(_length() < huge).select("doc_id", _fingerprints(primes, False)("text").alias("_k"))
    small = small.select("doc_id", F.col("_k.fp").alias("_fp"), F.col("_k.own").alias("text_sha256"))
    return small.unionByName(_huge(docs, primes, huge).select("doc_id", "_fp", F.sha2("text", 256).alias("text_sha256")))


def _chunks(docs: DataFrame, primes: tuple[int, int], huge: int) -> DataFrame:
    """(doc_id, _fp, _at, _part): the bytes of every compared text, in chunks from number 0."""
    small = docs.where(_length() < huge).select("doc_id", _fingerprints(primes, True)("text").alias("_k"))
    ends = F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("_k.own") - 1, F.lit(0)) / PART).cast("int"))
    pieces = F.transform(ends, lambda i: F.substring(F.col("_k.own"), i * PART + 1, F.lit(PART)))
    small = small.select("doc_id", F.col("_k.fp").alias("_fp"), F.posexplode(pieces).alias("_at", "_part"))
    large = _huge(docs, primes, huge).select("doc_id", "_fp", F.posexplode(_parts(F.col("text"))).alias("_at", "_part"))
    return small.unionByName(large.withColumn("_part", F.col("_part").cast("binary")))


def exact_groups(docs: DataFrame, primes: tuple[int, int] = PRIMES, huge: int = HUGE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with
    the largest doc_id of a group stays; a null doc_id is smaller than any other. Rows that
    repeat a doc_id and its text share one fate. Other columns, whatever their names, are not
    read; texts may be of any length. An empty table gives an empty result.

    Fingerprints gather the candidates. Equal ones are compared chunk by chunk: for each
    (fingerprint, chunk number) there must be one chunk only, which partial aggregation
    settles without ever holding a group in one place. Groups that fail (two texts with one
    fingerprint) are told apart by the SHA-256 of their texts.
    """
    docs = docs.select("doc_id", "text")
    rows = stored(fingerprinted(docs, primes, huge), "exact-rows")
    compared = _chunks(docs, primes, huge).groupBy("_fp", "_at", "_part").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("_n"))
    begin = F.when(F.col("_at") == 0, F.col("_n"))
    one = F.count(F.lit(1)) == F.max("_at") + 1
    groups = stored(compared.groupBy("_fp").agg(F.max("keep_id").alias("keep_id"), F.sum(begin).alias("group_size"), one.alias("_same")), "exact-groups")
    sure = groups.where("_same").drop("_same")
    out = rows.join(sure, "_fp")
    if not groups.where("not _same").isEmpty():
        unsure = groups.where("not _same").select("_fp")
        texts = rows.join(unsure, "_fp", "left_semi").groupBy("_fp", "text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.unionByName(rows.join(texts, ["_fp", "text_sha256"]))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, of the largest doc_id; columns as they were.

    Where doc_ids are null or repeated, rows go by a number of their own, so that no text
    goes without a copy that stays, and of rows that repeat an id and a text one stays.
    Null counts as empty; texts of any length are compared whole; columns may have any names
    beside; an empty table stays empty.
    """
    light_batches(docs.sparkSession)
    if own_ids(docs):
        own, rows, order = "doc_id", docs, F.col("doc_id")
    else:
        own = fresh(docs, "_row")
        rows = numbered(docs, own)
        order = F.struct(F.col("doc_id").alias("id"), F.col(own).alias("row"))
    gone = exact_groups(rows.select(order.alias("doc_id"), "text")).where("not kept")
    gone = gone.select((F.col("doc_id") if own == "doc_id" else F.col("doc_id.row")).alias(fresh(docs, "_gone")))
    return rows.join(gone, rows[own] == gone[gone.columns[0]], "left_anti").select(*[rows[c] for c in docs.columns])
