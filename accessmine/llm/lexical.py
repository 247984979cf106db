"""Ranked lexical search: bit-sliced Bloom signatures bound every score, exact scores settle what the bounds leave."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessmine.llm.common import LOWER, UPPER, light_batches, lowered, mixed, numbered, own_ids, steps, stored, utf8, words_of

#: Terms are runs of ASCII letters and digits and of anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A signature holds a key for a term and each of these numbers that its occurrences reach.
TIERS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512, 1024])
#: Bits for a key (doubled at most, to a power of two) and places of a key.
BITS, PROBES = 12, 4
#: Bits of a block of signatures, documents in one, and bytes of text hashed at a time.
BLOCK_BITS, BLOCK_DOCS, STEP = 1 << 23, 1024, 1 << 20
#: Items, and terms of items, that are searched together in one pass (on average; an item's terms stay together).
ITEMS, ITEM_TERMS = 256, 100_000
#: Documents scored first for each that an item asks for: more than one, as the highest bounds are those of false presence.
FIRST = 3
#: Pairs of document and item up to which they are broadcast to the scan of the texts.
LIGHT = 500_000

_BETWEEN = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
_FOLD = bytes(32 if _BETWEEN[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms_of(text: Column) -> Column:
    """All terms of a text in order, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(lowered(text), F.lit(TERM), F.lit(0))


def _keys(terms: np.ndarray, tier: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(terms * np.uint64(0x9FB21C651E98DF25) + np.asarray(tier).astype(np.uint64))


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The places of each key among so many bits, a power of two."""
    with np.errstate(over="ignore"):
        at = (keys & np.uint64(0xFFFFFFFF))[:, None] + ((keys >> np.uint64(32)) | np.uint64(1))[:, None] * np.arange(PROBES, dtype=np.uint64)
    return (at & np.uint64(bits - 1)).astype(np.int64)


def _block(bits: int, rows: list[int], n: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
    """Signatures of documents, sliced: for each bit a bitmap over the documents."""
    cells = np.zeros((bits, -(-len(rows) // 8) * 8), bool)
    doc = np.repeat(np.arange(len(rows)), [len(k) * PROBES for k in keys])
    cells[_places(np.concatenate(keys), bits).ravel(), doc] = True
    return pa.RecordBatch.from_arrays(
        [pa.array([bits], pa.int32()), pa.array([rows], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), pa.array([len(n)], pa.int64()), pa.array([sum(n)], pa.int64()), pa.array([np.packbits(cells, axis=1).tobytes()], pa.binary())],
        names=["bits", "rows", "n", "docs", "terms", "slices"],
    )


def _term_keys(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts: their numbers of terms, all keys by text, and the keys of each text."""
    with np.errstate(over="ignore"):
        words, first = words_of(data, bounds, _BETWEEN)
    n = np.diff(first)
    # 48 bits of hash: terms that share them only raise a bound
    own = np.sort((np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(48)) | (words >> np.uint64(16)))
    head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    reached = np.searchsorted(TIERS, np.diff(np.append(head, len(own))), "right")
    own = own[head]
    tier = np.arange(int(reached.sum())) - np.repeat(np.cumsum(reached) - reached, reached)
    sizes = np.bincount((own >> np.uint64(48)).astype(np.int64), weights=reached, minlength=len(n)).astype(np.int64)
    return n, _keys(np.repeat(own & np.uint64((1 << 48) - 1), reached), tier), sizes


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_: dict[int, tuple[list, list, list]] = {}
    for batch in batches:
        rows = batch.column("_row").to_pylist()
        data, bounds = utf8(batch.column("text"))
        for begin, end in steps(bounds, STEP):
            for i in range(begin, end, 1 << 16):
                j = min(end, i + (1 << 16))
                n, keys, sizes = _term_keys(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                ends = np.cumsum(sizes)
                for x in np.flatnonzero(n).tolist():
                    bits = max(64, 1 << (BITS * int(sizes[x]) - 1).bit_length())
                    block = open_.setdefault(bits, ([], [], []))
                    for to, value in zip(block, (rows[i + x], int(n[x]), keys[ends[x] - sizes[x] : ends[x]]), strict=True):
                        to.append(value)
                    if len(block[0]) >= min(BLOCK_DOCS, max(8, BLOCK_BITS // bits)):
                        yield _block(bits, *open_.pop(bits))
    for bits in sorted(open_):
        yield _block(bits, *open_[bits])


@dataclass
class Index:
    """Documents (_row, doc_id, text), their signatures, and how many hold terms, and how many terms."""

    docs: DataFrame
    signatures: DataFrame
    n_docs: int
    n_terms: int


def indexed(docs: DataFrame) -> Index:
    """The signatures of every row of docs (doc_id, text), stored in the shared folder.

    Blocks hold documents of like size, whose bits they share out by document: a bit's slice
    is a bitmap over the block. Documents without a term aren't in it.
    """
    light_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("_row", F.col("doc_id")) if own_ids(docs) else numbered(docs, "_row")
    signatures = stored(docs.select("_row", "text").mapInArrow(_sliced, "bits int, rows array<long>, n array<long>, docs long, terms long, slices binary"), "lexical-index")
    total = signatures.agg(F.sum("docs").alias("d"), F.sum("terms").alias("t")).first()
    return Index(docs, signatures, total.d or 0, total.t or 0)


def weighted(index: Index, items: DataFrame) -> DataFrame:
    """(_item, term, w) for the distinct terms of items (_item, text) that some document holds."""
    terms = items.select("_item", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    known = terms.select("term").distinct()
    known = F.broadcast(known) if known.count() <= LIGHT else known
    held = index.docs.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).join(known, "term")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return terms.join(df, "term").select("_item", "term", F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))


class Searched:
    """Some items with their terms and weights, as arrays, and the corpus figures of the score."""

    def __init__(self, rows: list, index: Index, top: int):
        self.items = sorted({r._item for r in rows})
        self.terms = sorted({r.term.encode() for r in rows})
        at, nth = {k: x for x, k in enumerate(self.items)}, {k: x for x, k in enumerate(self.terms)}
        self.pairs = np.array([(at[r._item], nth[r.term.encode()], r.w) for r in rows], np.int64).reshape(-1, 3)
        self.n_docs, self.n_terms, self.top = index.n_docs, index.n_terms, top

    def ready(self) -> Searched:
        """In a task: what is large and follows from the rest."""
        data, bounds = np.frombuffer(b"".join(self.terms), np.uint8), np.cumsum([0, *map(len, self.terms)])
        with np.errstate(over="ignore"):
            self.hashes = words_of(data, bounds, _BETWEEN)[0] >> np.uint64(16)
        exact = np.bincount(self.pairs[:, 0], weights=self.pairs[:, 2]).max(initial=0) < 1 << 24
        self.weights = np.zeros((len(self.items), len(self.terms)), np.float32 if exact else np.float64)
        self.weights[self.pairs[:, 0], self.pairs[:, 1]] = self.pairs[:, 2]
        return self

    def damping(self, n):
        return 100 - 50 + (50 * n * self.n_docs) // self.n_terms

    def bounds(self, bits: int, n: np.ndarray, slices: bytes) -> np.ndarray:
        """Upper bounds of the score of every item (rows) for every document of a block.

        The slices of a term's key, and-ed, are a bitmap of documents that may hold it so
        often. Weighted sums of the bitmaps of each tier, times what a document's score can
        gain between two tiers, add up to the bound.
        """
        table = np.frombuffer(slices, np.uint8).reshape(bits, -1)
        damping, alive, seen = self.damping(n), np.arange(len(self.terms)), None
        total, before = np.zeros((len(self.items), len(n))), np.zeros(len(n), np.int64)
        for k in range(len(TIERS)):
            maps = np.bitwise_and.reduce(table[_places(_keys(self.hashes[alive], k), bits)], axis=1)
            if seen is not None:
                maps &= seen
            on = maps.any(axis=1)
            alive, seen = alive[on], maps[on]
            if not len(alive):
                break
            tf = np.minimum(n, TIERS[k + 1] - 1) if k + 1 < len(TIERS) else n
            most = (1_000_000_000 * tf) // (1000 * tf + 20 * damping)
            held = np.unpackbits(seen, axis=1)[:, : len(n)].astype(self.weights.dtype)
            total += (self.weights[:, alive] @ held) * (most - before)
            before = most
        return total


def _each(batches: Iterator[pa.RecordBatch], searched: Searched) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every block its rows and the bounds."""
    for batch in batches:
        for k in range(batch.num_rows):
            bits, rows, n, slices = (batch.column(c)[k] for c in ("bits", "rows", "n", "slices"))
            yield rows.values.to_numpy(), searched.bounds(bits.as_py(), n.values.to_numpy(), slices.as_py())


def _pairs(items: list[int], rows: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(rows, pa.int64()), pa.array(bound.astype(np.int64))], names=["_item", "_row", "bound"])


def _likeliest(searched: Searched):
    """Each task's documents of the highest bounds for every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, top = searched.ready(), searched.top * FIRST
        best, who = np.zeros((len(q.items), top)), np.zeros((len(q.items), top), np.int64)
        for rows, bound in _each(batches, q):
            better = np.flatnonzero(bound.max(axis=1) > best.min(axis=1))
            values = np.concatenate([best[better], bound[better]], axis=1)
            names = np.concatenate([who[better], np.broadcast_to(rows, (len(better), len(rows)))], axis=1)
            at = np.argpartition(-values, top - 1, axis=1)[:, :top]
            best[better], who[better] = np.take_along_axis(values, at, 1), np.take_along_axis(names, at, 1)
        item, k = np.nonzero(best)
        yield _pairs([q.items[x] for x in item.tolist()], who[item, k], best[item, k])

    return run


def _open(searched: Searched, least: dict[int, int]):
    """All documents that the bounds don't exclude: those that may reach the item's least score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = searched.ready()
        limit = np.array([max(1, least.get(x, 0)) for x in q.items])
        for rows, bound in _each(batches, q):
            item, k = np.nonzero(bound >= limit[:, None])
            yield _pairs([q.items[x] for x in item.tolist()], rows[k], bound[item, k])

    return run


def _exactly(searched: Searched):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[tuple[bytes, int]]] = {}
        for x, t, w in searched.pairs.tolist():
            own.setdefault(searched.items[x], []).append((searched.terms[t], w))
        for batch in batches:
            out = []
            for row, doc_id, text, items in zip(*(batch.column(c).to_pylist() for c in ("_row", "doc_id", "text", "_items")), strict=True):
                terms = (text or "").encode().translate(_FOLD).split()
                tf, damping = Counter(terms), searched.damping(len(terms))
                for item in items:
                    score = sum(w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * damping)) for t, w in own[item] if t in tf)
                    if score > 0:
                        out.append((item, row, doc_id, score))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["_item", "_row", "doc_id", "score"])

    return run


def rescored(index: Index, pairs: DataFrame, searched: Searched) -> DataFrame:
    """(_item, _row, doc_id, score) of pairs (_item, _row), from the texts; scores of 0 are left out.

    Only the pairs' documents leave the scan of the texts, by a broadcast while the pairs are
    few, which is counted.
    """
    wanted = pairs.groupBy(F.col("_row").alias("_r")).agg(F.collect_list("_item").alias("_items"))
    wanted = F.broadcast(wanted) if pairs.count() <= LIGHT else wanted
    texts = index.docs.join(wanted, F.col("_row") == F.col("_r")).select("_row", "doc_id", "text", "_items")
    return texts.mapInArrow(_exactly(searched), "_item long, _row long, doc_id long, score long")


def _best(scores: DataFrame, top: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("_item").orderBy(*order))
    return scores.withColumn("rank", rank).where(F.col("rank") <= top)


def ranked(index: Index, items: DataFrame, top: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items (item_id, text) its best documents.

    Scores follow the weighted, damped term counts of ``Searched``; equal ones go by doc_id,
    null last. An item without terms, or whose terms no document holds, has no row; rows that
    repeat an item, or a document, are each their own. Texts of any length go whole. Other
    columns, whatever their names, are not read; empty tables give an empty result.

    The documents with the highest bounds are scored; the worst of an item's best ``top`` of
    them is a score that no result can be below. A second pass over the signatures gives every document
    whose bound reaches it, and those alone are scored. Many items go in blocks, one after
    another; a block's terms pass the driver.
    """
    items = numbered(items.select("item_id", "text"), "_item")
    weights = stored(weighted(index, items), "lexical-weights")
    size = weights.agg(F.count_distinct("_item").alias("i"), F.count(F.lit(1)).alias("t")).first()
    blocks = max(1, -(-size.i // ITEMS), -(-size.t // ITEM_TERMS))
    out = None
    last = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    for b in range(blocks):
        rows = weights.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        searched = Searched(rows, index, top)
        pair = "_item long, _row long, bound long"
        first = _best(index.signatures.mapInArrow(_likeliest(searched), pair), top * FIRST, F.col("bound").desc(), F.col("_row"))
        found = _best(rescored(index, stored(first.select("_item", "_row"), "lexical-first"), searched), top, *last)
        least = {r._item: r.least for r in found.groupBy("_item").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= top).collect()}
        left = stored(index.signatures.mapInArrow(_open(searched, least), pair).select("_item", "_row"), "lexical-open")
        best = stored(_best(rescored(index, left, searched), top, *last), "lexical-best")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return items.limit(0).select("item_id", F.lit(1).cast("int").alias("rank"), F.lit(1).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("score"))
    return out.join(items.select("_item", "item_id"), "_item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def oracle(top: int = 50) -> str:
    """The same in DuckDB's SQL."""
    term = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""
        WITH d AS (SELECT doc_id, {term} AS terms FROM documents),
             s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
             tf AS (SELECT doc_id, len(terms)::BIGINT AS n, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM d) GROUP BY ALL),
             w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term),
             i AS (SELECT DISTINCT item_id, unnest({term}) AS term FROM benchmark),
             g AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // total)))))::BIGINT AS score
                   FROM i JOIN w USING (term) JOIN tf USING (term), s GROUP BY item_id, doc_id),
             r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM g WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {top}"""
