"""Language identification by bit-sliced Bloom filters over letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accessmine.llm.common import fresh, mixed

#: Slots of every language's filter, and slots that one trigram sets.
SLOTS, PROBES = 1 << 19, 3
#: A language contains the trigrams that make up so much of it, so 100,000 at most,
LEAST_SHARE, LEAST_COUNT = 1e-5, 3
#: and that are not so much rarer in it than where they are most common (stray foreign words).
LEAST_RATIO = 0.05
#: More languages than this is taken for a wrong column.
MOST_LANGUAGES = 1024
STEP_CHARS = 1 << 19

_letters: list[np.ndarray] = []


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigram around each letter, with blanks for what isn't a letter, and the first of each text (with the end)."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    low = [x.lower() for x in texts]
    codes = np.frombuffer(("\0".join(low) + "\0").encode("utf-32-le", "replace"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in low])])
    keep = _letters[0][codes]
    own = np.where(keep, codes, 0).astype(np.uint64)
    before, after = np.concatenate([[0], own[:-1]]).astype(np.uint64), np.concatenate([own[1:], [0]]).astype(np.uint64)
    at = np.flatnonzero(keep)
    grams = (before[at] << np.uint64(42)) | (own[at] << np.uint64(21)) | after[at]
    return grams, np.searchsorted(at, starts)


def _pieces(texts: list[str]):
    """Ranges of texts with not too many characters together."""
    i = size = 0
    for k, x in enumerate(texts):
        if size and size + len(x) > STEP_CHARS:
            yield i, k
            i, size = k, 0
        size += len(x)
    if i < len(texts):
        yield i, len(texts)


def slots_of(grams: np.ndarray) -> list[np.ndarray]:
    h = mixed(grams)
    return [((h >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(PROBES)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) -> (lang, gram, n), summed within a batch."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = [x or "" for x in batch.column("text").to_pylist()]
        for lang in dict.fromkeys(langs.tolist()):
            own = [texts[k] for k in np.flatnonzero(langs == lang)]
            parts = [np.unique(trigrams(own[i:j])[0], return_counts=True) for i, j in _pieces(own)]
            grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([c for _, c in parts]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


class Filters:
    """One row of mask words per slot; bit l of a mask belongs to language l."""

    def __init__(self, languages: list[str], masks: np.ndarray, sizes: np.ndarray):
        self.languages, self.masks = languages, masks
        self.sizes = sizes
        bits = [(masks[:, k // 63] >> np.uint64(k % 63)) & np.uint64(1) for k in range(len(languages))]
        self.false = np.array([b.mean() ** PROBES for b in bits])

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams of each text, and how many of them each language contains."""
        grams, first = trigrams(texts)
        n = np.diff(first)
        out = np.zeros((len(texts), len(self.languages)))
        found = self.masks[slots_of(grams)[0]]
        for more in slots_of(grams)[1:]:
            found = found & self.masks[more]
        for k in range(len(self.languages)):
            one = ((found[:, k // 63] >> np.uint64(k % 63)) & np.uint64(1)).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(one)])
            out[:, k] = total[first[1:]] - total[first[:-1]]
        return n, out

    def decide(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language with most trigrams after false positives, and its share of all languages' hits."""
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        n, found = self.hits(texts)
        sure = np.maximum(0, (found - n[:, None] * self.false) / np.maximum(1e-9, 1 - self.false))
        best = np.where(sure.max(axis=1) > 0, sure.argmax(axis=1), int(self.sizes.argmax()))
        total = sure.sum(axis=1)
        score = np.where(total > 0, sure.max(axis=1) / np.maximum(total, 1e-9), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best, n, strict=True)], np.where(n > 0, score, 0.0).tolist()


def learned(train: DataFrame) -> Filters:
    """Filters from train (text, lang).

    Trigrams are counted over all rows. What comes to the driver are the filters' slots,
    as many for any amount of text.
    """
    counts = train.where("lang is not null").select("lang", "text").mapInArrow(_count, "lang string, gram bigint, n bigint")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    best = F.max("share").over(Window.partitionBy("gram"))
    inside = counts.join(F.broadcast(totals.limit(MOST_LANGUAGES + 1)), "lang").withColumn("share", share).withColumn("best", best)
    inside = inside.where((F.col("share") >= LEAST_SHARE) & (F.col("n") >= LEAST_COUNT) & (F.col("share") >= LEAST_RATIO * F.col("best")))
    numbered = inside.select("lang", "total", F.explode(F.array(*_slot_columns())).alias("slot"))
    sliced = numbered.groupBy("slot").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    sizes = {r["lang"]: r["total"] for r in totals.limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    place = {x: k for k, x in enumerate(languages)}
    masks = np.zeros((SLOTS, max(1, -(-len(languages) // 63))), np.uint64)
    table = sliced.toArrow()
    if table.num_rows:
        lists = table["langs"].combine_chunks()
        rows = np.repeat(table["slot"].to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False))
        owners = lists.flatten().dictionary_encode()
        bits = np.array([place[x] for x in owners.dictionary.to_pylist()])[owners.indices.to_numpy()]
        np.bitwise_or.at(masks, (rows, bits // 63), np.uint64(1) << (bits % 63).astype(np.uint64))
    return Filters(languages, masks, np.array([sizes[x] for x in languages] or [0]))


def _slot_columns():
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def slots(grams: pa.Array) -> pa.Array:
        cols = np.stack(slots_of(grams.to_numpy(zero_copy_only=False).astype(np.uint64)), axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, cols.size + 1, PROBES, dtype=np.int32)), pa.array(cols.ravel()))

    s = slots("gram")
    return [s.getItem(k) for k in range(PROBES)]


def identified(docs: DataFrame, filters: Filters, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs (text and any other columns) with ``lang_pred`` and ``score``.

    ``und`` where the text is null or has no letter. A text none of whose trigrams is
    known gets the language with most training text and score 0; ties go to the first
    language by name. Without any learned language everything is ``und``. Each row is
    judged by its whole text alone, so repeated rows get the same answer, and a very long
    text is a step of its own. Columns of docs named as the two new ones give way to them
    (name the new ones otherwise to keep both); any other name is free. An empty table
    stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def decide(texts: pa.Array) -> pa.Array:
        texts = [x or "" for x in texts.to_pylist()]
        langs, scores = [], []
        for i, j in _pieces(texts):
            a, b = shared.value.decide(texts[i:j])
            langs += a
            scores += b
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    others, found = docs.drop(lang, score), fresh(docs, "_found")
    return others.withColumn(found, decide("text")).select(*(f"`{c}`" for c in others.columns), F.col(f"{found}.lang").alias(lang), F.col(f"{found}.score").alias(score))
