"""Removal of long repeated byte strings, by longest-previous-factor arrays over suffix order.

A 400-byte string that occurs twice has the same 64-byte grams in both places, so also the
same smallest gram hash, its lead, at the same offset. That gives every window one place
where all its copies meet, found from its own bytes alone:

1. Each document's windows fall into runs that share a lead, cut at a fixed offset. A run
   has a core (the bytes that all windows at these offsets share) and a string (all bytes
   of its windows). Cores that occur once can't hold a repeated window and end here.
2. Runs with equal strings are copies as a whole. Of each string one run goes on, and only
   where other strings share its core.
3. Strings that share a core are put in suffix order, to the depth of a window. In that
   order, with ties by position, the neighbours at smaller and larger positions say
   whether a window's longest previous or next factor spans the window.

A core with very many different strings, as next to a passage that everyone quotes, isn't
gathered anywhere: its runs are halved again and again, and only the parts whose own,
longer cores still repeat go on, down to single windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accessmine.llm.common import _BYTES, STEP_BYTES, mixed, span_hashes, steps, stored, utf8

LENGTH, GRAM = 400, 64
#: Different strings on one core that one step may hold.
TOGETHER = 1500
#: Bytes that one step puts in suffix order.
SORTED_BYTES = 1 << 20


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of so many values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, p, n, at, core, tid) of the runs of windows that start at first[i] .. last[i]-1 of a buffer."""
    width = length - gram + 1
    half = width // 2
    grams = span_hashes(_BYTES[data], np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1))
    place = np.uint64((1 << 22) - 1)
    lead = (smallest((grams & ~place) | np.arange(len(grams), dtype=np.uint64), width) & place).astype(np.int64)
    row = np.repeat(np.arange(len(first)), last - first)
    p = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(last - first)[:-1]]) - first, last - first)
    a = lead[p]
    far = a - p > half
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1]) | (far[1:] != far[:-1])])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(p)))
    row, p, a, far = row[begin], p[begin], a[begin], far[begin]
    # offsets 0..half, or half+1..width-1: what all windows at these offsets share
    core_begin = np.where(far, a - half - 1, a)
    core_end = np.where(far, a - (width - 1) + length, a - half + length)
    values = _BYTES[data]
    core = mixed(span_hashes(values, core_begin, core_end) + far.astype(np.uint64))
    return row, p, n, a - p, core, span_hashes(values, p, p + n - 1 + length)


def _all_runs(length: int, gram: int):
    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("p", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("core", T.LongType()), T.StructField("tid", T.LongType())])))
    def found(texts: pa.Array) -> pa.Array:
        data, bounds = utf8(texts)
        rows: list[tuple] = []

        def add(buffer: np.ndarray, first: np.ndarray, last: np.ndarray, row0: int, p0: np.ndarray) -> None:
            live = last > first
            if live.any():
                which = np.flatnonzero(live)
                r, p, n, at, core, tid = runs(buffer, first[live], last[live], length, gram)
                rows.append((row0 + which[r], p + p0[which[r]], n, at, core, tid))

        with np.errstate(over="ignore"):
            for i, j in steps(bounds, STEP_BYTES):
                size = bounds[j] - bounds[i]
                if size <= 2 * STEP_BYTES:
                    first = bounds[i:j] - bounds[i]
                    if size >= length:
                        add(data[bounds[i] : bounds[j]], first, np.maximum(first, bounds[i + 1 : j + 1] - bounds[i] - length + 1), i, -first)
                else:  # one long text, in parts
                    for s in range(0, size - length + 1, STEP_BYTES):
                        e = min(size, s + STEP_BYTES + length - 1)
                        add(data[bounds[i] + s : bounds[i] + e], np.array([0]), np.array([e - s - length + 1]), i, np.array([s]))
        cols = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 6
        counts = np.bincount(cols[0], minlength=len(texts)) if len(cols[0]) else np.zeros(len(texts), np.int64)
        kinds = (np.int64, np.int32, np.int32, np.int64, np.int64)
        values = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(k)) for c, k in zip(cols[1:], kinds, strict=True)]
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(values, names=["p", "n", "at", "core", "tid"]))

    return found


def factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows at ``starts`` (ascending): do they have a previous, and a next, factor of so many bytes?

    Suffixes are ranked by their first 8, 16, 32 ... bytes, until ranks tell windows apart.
    In the resulting order, with ties by position, the nearest smaller and larger positions
    with a common prefix of a whole window are a window's neighbours of equal rank.
    """
    padded = np.concatenate([data, np.zeros(2 * length, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data) + length]
    rank = np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    depth = min(8, length)
    while depth < length:
        step = min(depth, length - depth)
        rank = np.unique((rank[:-step] << np.uint64(32)) | rank[step:], return_inverse=True)[1].astype(np.uint64)
        depth += step
    own = rank[starts]
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    previous, following = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    previous[order[1:]] = same
    following[order[:-1]] = same
    return previous, following


def _spans(flags: np.ndarray) -> list[dict]:
    """Maximal runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"from": int(a), "to": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


FOUND = "core bigint, tid bigint, found array<struct<from:int,to:int>>"


def _sorter(length: int, keep_first: bool):
    """Partitions with whole cores, ordered by core and then by place -> windows that repeat, by string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kind = pa.schema([("core", pa.int64()), ("tid", pa.int64()), ("found", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))])

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(x[4]) for x in held])
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            n = np.array([x[2] for x in held])
            starts = np.concatenate([b + np.arange(k) for b, k in zip(begin, n, strict=True)])
            previous, following = factors(np.frombuffer(b"".join(x[4] for x in held), np.uint8), starts, length)
            hit = np.split(previous if keep_first else previous | following, np.cumsum(n)[:-1])
            rows = [{"core": x[0], "tid": x[1], "found": _spans(h)} for x, h in zip(held, hit, strict=True)]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema=kind)

        size, core = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if size > SORTED_BYTES and row["core"] != core:
                    yield flush()
                    size = 0
                core = row["core"]
                held.append((core, row["tid"], row["n"], row["c"], row["t"]))
                size += len(row["t"])
        if held:
            yield flush()

    return run


def _refined(hot: DataFrame, length: int, gram: int, keep_first: bool) -> DataFrame:
    """What :func:`_sorter` finds, for cores with too many strings, by ever shorter parts of their runs."""
    width = length - gram + 1
    out: DataFrame | None = None
    # o1..o2: the offsets of the part's windows before their lead; w: only there for others to be compared with
    live = hot.select("core", "tid", F.col("rep").alias("order"), F.lit(0).alias("rel"), "n", "at", "t", F.lit(False).alias("w"))
    for size in [x for x in (42, 11, 3) if x < width] + [1]:
        low, high = F.floor((F.col("at") - F.col("n") + 1) / size), F.floor(F.col("at") / size)
        parts = live.withColumn("part", F.explode(F.sequence(low, high)))
        a, b = F.least(F.col("at"), (F.col("part") + 1) * size - 1), F.greatest(F.col("at") - F.col("n") + 1, F.col("part") * size)
        skip = (F.col("at") - a).cast("int")
        count = (a - b + 1).cast("int")
        at_core = F.col("at") - F.col("part") * size  # where the core begins
        cut = F.substring
        parts = parts.select(
            "core", "tid", "order", (F.col("rel") + skip).alias("rel"), count.alias("n"), a.cast("int").alias("at"), "part", "w",
            cut("t", skip + 1, count + length - 1).alias("t"),
            F.md5(cut("t", at_core.cast("int") + 1, F.lit(length - size + 1))).alias("inner"),
        )
        parts = stored(parts.withColumn("whole", F.md5("t")), "parts")
        strings = parts.groupBy("core", "part", "inner", "whole").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("order", "tid", "rel")).alias("one"))
        inner = strings.groupBy("core", "part", "inner").agg(F.count(F.lit(1)).alias("k"))
        live = parts.join(strings, ["core", "part", "inner", "whole"]).join(inner, ["core", "part", "inner"])
        first = F.struct("order", "tid", "rel") == F.col("one")
        done = live.where("c > 1 and not w")
        done = done.where(~first) if keep_first else done
        done = done.select("core", "tid", F.col("rel").alias("from"), (F.col("rel") + F.col("n")).alias("to"))
        out = done if out is None else out.unionByName(done)
        again = F.lit(False) if keep_first else F.col("w") | (F.col("c") > 1)
        live = live.where(((F.col("c") == 1) | first) & (F.col("k") > 1)).select("core", "tid", "order", "rel", "n", "at", "t", again.alias("w"))
    return out.groupBy("core", "tid").agg(F.collect_list(F.struct("from", "to")).alias("found"))


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = True, together: int = TOGETHER) -> DataFrame:
    """(_id, _key, spans): the byte spans of each document that repeated windows cover.

    keep_first: only windows with an earlier copy, in order of doc_id and place; else every
    window that occurs again anywhere.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))
    marked = keyed.where(F.octet_length("text") >= length)
    rows = marked.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), "_key", F.explode(_all_runs(length, gram)("text")).alias("r")).select("_id", "_key", "r.*")
    rows = stored(rows, "runs")
    # a table of its own, so that the join below can split a crowded core among tasks
    twice = stored(rows.groupBy("core").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("core"), "cores")
    rows = stored(rows.join(twice, "core"), "runs")
    strings = rows.groupBy("core", "tid").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("_id", "_key", "p")).alias("rep"), F.first("n").alias("n"), F.first("at").alias("at"))
    strings = stored(strings, "strings")
    open_ = strings.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("least")).where("k > 1" if keep_first else "k > 1 and least = 1")
    wanted = strings.join(open_.select("core", "k"), "core")
    lists = wanted.groupBy(F.col("rep._id").alias("_id"), F.col("rep._key").alias("_key")).agg(F.collect_list(F.struct("core", "tid", "n", "at", "c", "k", "rep")).alias("r"))
    binary = F.col("text").cast("binary")
    cut = F.transform("r", lambda x: F.struct(x["core"].alias("core"), x["tid"].alias("tid"), x["n"].alias("n"), x["at"].alias("at"), x["c"].alias("c"), x["k"].alias("k"), x["rep"].alias("rep"), F.substring(binary, (x["rep"]["p"] + 1).cast("int"), x["n"] - 1 + length).alias("t")))
    texts = marked.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), "_key", "text")
    bytes_ = stored(texts.join(lists, ["_id", "_key"]).select(F.explode(cut).alias("x")).select("x.*"), "bytes")
    few = bytes_.where(F.col("k") <= together).select("core", "tid", "n", "c", "rep", "t")
    found = few.repartition("core").sortWithinPartitions("core", "rep", "tid").select("core", "tid", "n", "c", "t").mapInArrow(_sorter(length, keep_first), FOUND)
    hot = bytes_.where(F.col("k") > together)
    if not hot.isEmpty():
        found = found.unionByName(_refined(hot, length, gram, keep_first))
    known = strings.select("core", "tid", "c", "rep").join(found, ["core", "tid"], "left")
    # a table of its own, as above: the rows of a string that very many documents share are split among tasks
    known = stored(known.where("c > 1 or size(found) > 0"), "known")
    own = F.coalesce("found", F.array().cast("array<struct<from:int,to:int>>"))
    everything = F.array(F.struct(F.lit(0).alias("from"), F.col("n").alias("to")))
    itself = F.struct("_id", "_key", "p") == F.col("rep")
    use = F.when(F.col("c") == 1, own).when(itself, own if keep_first else everything).otherwise(everything)
    spans = rows.join(known, ["core", "tid"]).select("_id", "_key", "p", F.explode(use).alias("u"))
    spans = spans.select("_id", "_key", (F.col("p") + F.col("u.from")).alias("from"), (F.col("p") + F.col("u.to") - 1 + length).alias("to"))
    return spans.groupBy("_id", "_key").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("spans"))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in spans or []:
        if out and x["from"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["to"]))
        else:
            out.append((x["from"], x["to"]))
    return out


@F.arrow_udf(T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]))
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    n, removed, count, kept = [], [], [], []
    for text, own in zip(texts.cast(pa.large_binary()), spans, strict=True):
        raw = text.as_py() or b""
        gone = _merged(own.as_py())
        edges = [0, *(x for s in gone for x in s), len(raw)]
        n.append(len(raw))
        removed.append(sum(b - a for a, b in gone))
        count.append(len(gone))
        kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], names=["n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, together: int = TOGETHER, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for every row of docs.

    Texts count as UTF-8 bytes; null is empty; matches never cross documents. Rows that
    repeat a doc_id and its text are copies of each other: without keep_first both go, with
    it both share the fate of the first. A null doc_id comes before all others. An empty
    table gives an empty result.
    """
    spans = repeated(docs, length, gram, keep_first, together)
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), F.xxhash64("doc_id", "text").alias("_key"))
    return rows.join(spans, ["_id", "_key"], "left").withColumn("_r", _without("text", "spans")).select("doc_id", "_r.*")


def repeats_report(docs: DataFrame) -> DataFrame:
    """What :func:`without_repeats` leaves when every copy goes, by its hash.

    n_bytes is the size of the text as given; whether a row lost anything is told by
    n_removed. Passages of fewer than 400 bytes stay, however many words they have.
    """
    out = without_repeats(docs, keep_first=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
