"""Quality rules whose cutoffs come with a guarantee on wrong rejections."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accessmine.llm.common import light_batches, stored

SYMBOLS = "#*$%&|<>"
#: Word counts that part the strata.
STRATA = (50, 200, 1000)
#: Signals that may reject a text with too much of them, all shares from 0 to 1.
SIGNALS = ("symbol_share", "repeat_share", "line_share", "same_share")
#: Cutoffs tried, from strict to mild.
CUTOFFS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8)
#: Most good texts that all signals of a stratum together may reject, and the chance that any bound is wrong.
FALSE_REJECTION, ERROR = 0.04, 0.05

_word = re.compile(r"[^\x20\x09-\x0D]+")
_fields = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct")


def measured(text: str) -> tuple[int, ...]:
    """The values of ``_fields`` for one text."""
    words = _word.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if _word.search(x)]
    repeated = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            first: dict = {}
            again = bytearray(len(windows))
            for k, w in enumerate(windows):
                j = first.setdefault(w, k)
                if j != k:
                    again[j] = again[k] = 1
            reach = 0
            for k, twice in enumerate(again):
                if twice:
                    repeated += k + 5 - max(k, reach)
                    reach = k + 5
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated, len(set(words))


@F.arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in _fields]))
def _measures(texts: pa.Array) -> pa.Array:
    rows = [measured(x.as_py() or "") for x in texts]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(_fields), names=list(_fields))


def with_measures(docs: DataFrame) -> DataFrame:
    """docs with ``_m`` (counts), ``_base_failed``, ``_stratum`` and ``_signals``."""
    out = docs.withColumn("_m", _measures("text"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m = {x: F.col(f"_m.{x}") for x in _fields}
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    stratum = sum(((m["n_words"] >= n).cast("int") for n in STRATA), F.lit(0))
    signals = F.struct(
        share(m["n_symbols"], m["word_chars"]).alias("symbol_share"),
        share(m["n_repeat_words"], m["n_words"]).alias("repeat_share"),
        share(m["n_dup_lines"], m["n_lines"]).alias("line_share"),
        share(m["n_words"] - m["n_distinct"], m["n_words"]).alias("same_share"),
    )
    return out.withColumn("_base_failed", failed).withColumn("_stratum", stratum).withColumn("_signals", signals)


def upper_bound(k: int, n: int, error: float) -> float:
    """Exact (Clopper-Pearson) upper confidence bound of a rate, after k of n."""
    if k >= n:
        return 1.0

    def tail(p: float) -> float:
        """Chance of k or fewer, from k down; what is left out is bounded by a geometric series and added."""
        first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
        term = total = 1.0
        for i in range(k, 0, -1):
            ratio = i / (n - i + 1) * (1 - p) / p  # below 1, as p is over k / n, and ever smaller
            rest = term * ratio / (1 - ratio) if ratio < 1 else math.inf
            if rest < 1e-12 * total:
                total += rest
                break
            term *= ratio
            total += term
        return math.exp(first) * total

    low, high = k / n, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if mid > 0 and tail(min(mid, 1 - 1e-15)) > error else (low, mid)
    return high


def cutoffs(judged: DataFrame, allowed: float = FALSE_REJECTION, error: float = ERROR) -> dict[tuple[int, str], float]:
    """For (stratum, signal) the strictest cutoff that wrongly rejects few enough good texts.

    judged: measured documents with ``quality`` (1 good), the labelled holdout. Each
    stratum's allowance is shared out among the signals, the error among all strata and
    signals (Bonferroni). Within one, cutoffs are tested in a fixed sequence from mild to
    strict up to the first that can't be vouched for, which needs no further correction.
    Where none can, none is used. What reaches the driver is a count for each stratum,
    signal and cutoff.
    """
    good = judged.where((F.col("quality") == 1) & ~F.col("_base_failed"))
    over = [F.sum((F.col(f"_signals.{s}") > c).cast("long")).alias(f"{s}:{i}") for s in SIGNALS for i, c in enumerate(CUTOFFS)]
    rows = good.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n"), *over).collect()
    families = (len(STRATA) + 1) * len(SIGNALS)
    found = {}
    for row in rows:
        for s in SIGNALS:
            for i in reversed(range(len(CUTOFFS))):
                if upper_bound(row[f"{s}:{i}"], row["n"], error / families) > allowed / len(SIGNALS):
                    break
                found[row["_stratum"], s] = CUTOFFS[i]
    return found


def verdict(found: dict[tuple[int, str], float]) -> Column:
    """True for measured documents that pass the base rules and every cutoff."""
    bad = F.col("_base_failed")
    for (stratum, signal), c in found.items():
        bad = bad | ((F.col("_stratum") == stratum) & (F.col(f"_signals.{signal}") > c))
    return ~bad


def holdout(measured_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a label: one for each doc_id, its smallest where labels disagree."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("quality"))
    return measured_docs.join(marks, measured_docs.doc_id == marks._id)


def judged(docs: DataFrame, labels: DataFrame, allowed: float = FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """docs, measured, with ``kept``: see :func:`with_measures` for the other columns.

    A null or empty text has no words and fails the base rules. Repeated rows get the same
    verdict. Without labels only the base rules hold. An empty table stays empty. Columns
    of docs other than doc_id and text are not read, so their names can't clash.
    """
    marked = with_measures(docs.select("doc_id", "text"))
    return marked.withColumn("kept", verdict(cutoffs(holdout(marked, labels), allowed, error)))


def quality_filtered(docs: DataFrame, labels: DataFrame, allowed: float = FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """The rows of docs that pass; columns as they were, whatever their names.

    A null or empty text fails the base rules, so its row goes; repeated rows get the same
    verdict; texts of any length are measured whole. Without labels only the base rules
    hold. An empty table stays empty.
    """
    light_batches(docs.sparkSession)
    measures = stored(with_measures(docs.select("doc_id", "text")).drop("text"), "quality")
    found = cutoffs(holdout(measures, labels), allowed, error)
    return with_measures(docs.select(F.struct("*").alias("_doc"), "text")).where(verdict(found)).select("_doc.*")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed and kept for each row of docs (doc_id, text); texts are measured once.

    A null or empty text has no words and fails the base rules. Repeated rows get the same
    verdict; texts of any length are measured whole; other columns, whatever their names,
    are not read. Without labels only the base rules hold. An empty table gives an empty
    result.
    """
    marked = stored(with_measures(docs.select("doc_id", "text")).drop("text"), "quality")
    m = [F.col(f"_m.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    kept = verdict(cutoffs(holdout(marked, labels)))
    return marked.select("doc_id", *m, F.col("_base_failed").alias("base_failed"), kept.alias("kept"))
