"""Periodic runs of words: recompression into a run-length grammar, whose LCE queries extend candidates."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessmine.llm.common import AS_IS, mixed, words_of

#: Bytes of text that make one grammar; a longer document has one of its own.
STEP = 1 << 20
#: A run has at least so many words, and so many periods.
LEAST, TIMES = 6, 4


@dataclass
class Level:
    """A string of the grammar, and how its symbols make up those of the next level.

    symbols: the string. at: the first word of each symbol, and the end. head: where each
    symbol of the next level begins here, and the end. up: the next level's symbol that
    each one is part of. right: for pairs, whether a symbol can be a second half; for
    blocks None.
    """

    symbols: np.ndarray
    at: np.ndarray
    head: np.ndarray | None = None
    up: np.ndarray | None = None
    right: np.ndarray | None = None

    def next(self, head: np.ndarray, symbols: np.ndarray) -> Level:
        begins = np.zeros(len(self.symbols), np.int32)
        begins[head] = 1
        self.head = np.append(head, len(self.symbols)).astype(np.int32)
        self.up = np.cumsum(begins, dtype=np.int32) - 1
        return Level(symbols.astype(np.int32), np.append(self.at[:-1][head], self.at[-1]))


def _blocks(level: Level) -> Level | None:
    """Every stretch of one symbol becomes one symbol; None if there is none."""
    s = level.symbols
    new = s[1:] != s[:-1]
    if new.all():
        return None
    head = np.flatnonzero(np.concatenate([[True], new]))
    times = np.diff(np.append(head, len(s)))
    return level.next(head, np.unique(s[head].astype(np.int64) * (int(times.max()) + 1) + times, return_inverse=True)[1])


def _pairs(level: Level, salt: int) -> Level:
    """Symbols are split in two classes by a hash; each left one before a right one joins it.

    Of both ways to call the classes the one that joins more is taken: at least a fourth of
    all neighbours are expected to join.
    """
    s = level.symbols
    with np.errstate(over="ignore"):
        right = (mixed(np.arange(int(s.max()) + 1, dtype=np.uint64) + np.uint64(salt << 40)) & np.uint64(1)).astype(bool)
    r = right[s]
    ups, downs = int((~r[:-1] & r[1:]).sum()), int((r[:-1] & ~r[1:]).sum())
    if downs > ups:
        right, r = ~right, ~r
    level.right = right
    joins = np.append(~r[:-1] & r[1:], False)
    head = np.flatnonzero(~np.concatenate([[False], joins[:-1]]))
    other = np.where(joins[head], np.append(s[1:], 0)[head] + np.int64(1), 0)
    return level.next(head, np.unique(s[head].astype(np.int64) * (len(right) + 1) + other, return_inverse=True)[1])


def grammar(symbols: np.ndarray) -> list[Level]:
    """Levels from the string itself up to one symbol, by block and pair compression in turn."""
    levels = [Level(symbols.astype(np.int32), np.arange(len(symbols) + 1, dtype=np.int32))]
    salt = 0
    while len(levels[-1].symbols) > 1:
        up = _blocks(levels[-1])
        if up is None:
            salt += 1
            up = _pairs(levels[-1], salt)
        levels.append(up)
    return levels


def _eaten(level: Level, p: np.ndarray, q: np.ndarray, ahead: bool) -> tuple[np.ndarray, np.ndarray]:
    """Symbols from p and q on that are equal within both blocks, and whether both blocks end together."""
    a, b = level.up[p], level.up[q]
    left = (level.head[a + 1] - p, level.head[b + 1] - q) if ahead else (p - level.head[a] + 1, q - level.head[b] + 1)
    return np.minimum(*left), left[0] == left[1]


def extension(levels: list[Level], i: np.ndarray, j: np.ndarray, ahead: bool) -> np.ndarray:
    """For each pair of words i < j how many equal ones follow from them on (or, not ahead, go back from them).

    The string must begin and end with symbols that occur once. Equal symbols that a next
    level could put together with different neighbours are taken off, after which both
    places begin a symbol there; once symbols differ, the way goes down again, and on each
    level at most one block or one half of a pair is still equal. All pairs go at once.
    """
    found = np.zeros(len(i), np.int64)
    d = 1 if ahead else -1

    def take(level: Level, who: np.ndarray, p: np.ndarray, m) -> None:
        found[who] += level.at[p + m] - level.at[p] if ahead else level.at[p + 1] - level.at[p + 1 - m]

    who, p, q = np.arange(len(i)), i.astype(np.int64), j.astype(np.int64)
    apart: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for level in levels:
        same = level.symbols[p] == level.symbols[q]
        apart.append((who[~same], p[~same], q[~same]))
        who, p, q = who[same], p[same], q[same]
        if not len(who):
            break
        if level.right is None:
            m, together = _eaten(level, p, q, ahead)
            take(level, who, p, m)
            p, q = p + d * m, q + d * m
            last = apart[-1]
            apart[-1] = tuple(np.concatenate([x, y[~together]]) for x, y in zip(last, (who, p, q), strict=True))
            who, p, q = who[together], p[together], q[together]
        else:
            off = level.right[level.symbols[p]] == ahead
            take(level, who[off], p[off], 1)
            p, q = p + d * off, q + d * off
        p, q = level.up[p].astype(np.int64), level.up[q].astype(np.int64)
    who, p, q = apart.pop()
    for level, more in zip(levels[len(apart) - 1 :: -1] if apart else [], apart[::-1], strict=True):
        p, q = (level.head[p], level.head[q]) if ahead else (level.head[p + 1] - 1, level.head[q + 1] - 1)
        p, q = p.astype(np.int64), q.astype(np.int64)
        same = np.flatnonzero(level.symbols[p] == level.symbols[q])
        m = _eaten(level, p[same], q[same], ahead)[0] if level.right is None else np.ones(len(same), np.int64)
        take(level, who[same], p[same], m)
        p[same] += d * m
        q[same] += d * m
        who, p, q = (np.concatenate([x, y]) for x, y in zip((who, p, q), more, strict=True))
    return found


def _candidates(s: np.ndarray, most: int, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): grid places of each period q whose symbol comes again q later.

    A run of period q repeats at least (times - 1) * q symbols, so a grid of that step has a
    place in it: n/q places for each q, a harmonic sum. What repeats so long also repeats
    next to the place, and further off, on one side at least.
    """
    at, period = [], []
    for q in range(1, most + 1):
        step = max((times - 1) * q, least - q)
        hit = np.flatnonzero(s[: len(s) - q : step] == s[q::step]) * step
        if len(hit):
            at.append(hit)
            period.append(np.full(len(hit), q))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, q = np.concatenate(at), np.concatenate(period)
    for near in (True, False):
        half = (np.maximum((times - 1) * q, least - q) - 1) // 2
        off = np.minimum(half, 1) if near else half
        low, high = np.maximum(i - off, 0), np.minimum(i + off, len(s) - 1 - q)
        on = (s[low] == s[low + q]) | (s[high] == s[high + q])
        i, q = i[on], q[on]
    return i, q


def runs(symbols: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length, period) of every run, in order of begin, then period.

    symbols: the words of several texts, as numbers from 0; first: each text's first word,
    and the end. A run is a stretch of one text with smallest period q and at least
    max(least, times * q) words that can't be longer; times is 2 at least.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    sizes = np.diff(first)
    n, texts = len(symbols), len(sizes)
    own = np.arange(n) + np.repeat(np.arange(1, texts + 1), sizes)
    s = np.empty(n + texts + 1, np.int64)
    s[own] = symbols
    marks = np.concatenate([[0], first[1:] + np.arange(1, texts + 1)])
    s[marks] = (int(symbols.max()) + 1 if n else 0) + np.arange(texts + 1)  # each once, so nothing crosses texts
    i, q = _candidates(s, int(sizes.max(initial=0)) // times, least, times)
    if not len(i):
        return i, i, q
    levels = grammar(s)
    ahead = extension(levels, i, i + q, True)
    back = extension(levels, i - 1, i + q - 1, False)
    begin, length = i - back, ahead + back + q
    long = length >= np.maximum(least, times * q)
    begin, length, q = begin[long], length[long], q[long]
    order = np.lexsort((q, length, begin))
    begin, length, q = begin[order], length[order], q[order]
    one = np.ones(len(begin), bool)  # of one stretch the smallest period
    one[1:] = (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])
    begin, length, q = begin[one], length[one], q[one]
    order = np.lexsort((q, begin))
    begin, length, q = begin[order], length[order], q[order]
    return begin - np.searchsorted(marks, begin), length, q


def _looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """Where each word of a document comes from, if its id has its end repeat."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _steps(texts: list[bytes], most: int) -> Iterator[list[int]]:
    """Numbers of texts, like sizes together, so many bytes at a time."""
    step, size = [], 0
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k])):
        if step and size + len(texts[k]) > most:
            yield step
            step, size = [], 0
        step.append(k)
        size += len(texts[k])
    if step:
        yield step


def found(texts: list[bytes], ids: list[int | None] | None, least: int, times: int, step: int = STEP):
    """For each text, out of order: its number, its words, and begin, length and period of its runs.

    With ids, the ends of some texts are made to repeat first.
    """
    for chosen in _steps(texts, step):
        some = [texts[k] for k in chosen]
        words = [t.split() for t in some]  # at ASCII white space
        data = np.frombuffer(b"".join(some), np.uint8)
        bounds = np.cumsum([0, *map(len, some)])
        with np.errstate(over="ignore"):
            hashes, first = words_of(data, bounds, folded=AS_IS) if len(data) else (np.zeros(0, np.uint64), np.zeros(len(some) + 1, np.int64))
        for x, k in enumerate(chosen if ids is not None else []):
            at = _looped(ids[k], len(words[x]))
            if at is not None:
                own = hashes[first[x] : first[x + 1]]
                own[:] = own[at]
                words[x] = [words[x][y] for y in at.tolist()]
        begin, length, q = runs(np.unique(hashes, return_inverse=True)[1], first, least, times)
        split = np.searchsorted(begin, first)
        for x, k in enumerate(chosen):
            a, b = split[x], split[x + 1]
            yield k, words[x], begin[a:b] - first[x], length[a:b], q[a:b]


def _kept(words: list[bytes], begin: np.ndarray, length: np.ndarray, q: np.ndarray) -> bytes:
    """Words that no run holds after its first q, joined by one space."""
    if not len(begin):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, begin + q, 1)
    np.add.at(change, begin + length, -1)
    return b" ".join(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def run_report(docs: DataFrame, least: int = LEAST, times: int = TIMES, looped: bool = True) -> DataFrame:
    """One row for every row of docs (doc_id, text): its runs, the longest, and its text without repeats as a digest.

    doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256. The
    longest run: ties by smallest start, then period; four nulls without any. With ``looped``
    the end of some texts, chosen by doc_id, is made to repeat first; a null doc_id chooses none.
    Null and empty texts have no words. Rows that repeat are judged alike; other columns,
    whatever their names, are not read; an empty table gives an empty result. A text is one
    grammar, whole, in memory linear in its words. Words are compared by 64-bit hashes.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows: list = [None] * len(ids)
            for k, words, begin, length, q in found(_texts(batch.column("text")), ids if looped else None, least, times):
                listed = "".join(f"{b},{m},{p}\n" for b, m, p in zip(begin.tolist(), length.tolist(), q.tolist(), strict=True))
                best = (None,) * 4
                if len(begin):
                    x = np.lexsort((q, begin, -length))[0]
                    best = (int(begin[x]), int(length[x]), int(q[x]), int(1000 * length[x] // q[x]))
                rows[k] = (ids[k], len(begin), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(_kept(words, begin, length, q)).hexdigest())
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    kind = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(report, kind)


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, start, length, period: a row for every run of every text of docs (doc_id, text); edge cases as in run_report."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for k, _, begin, length, q in found(_texts(batch.column("text")), None, least, times):
                yield pa.RecordBatch.from_arrays([pa.array([ids[k]] * len(begin), pa.int64()), *(pa.array(x, pa.int64()) for x in (begin, length, q))], names=["doc_id", "start", "length", "period"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with texts whose periodic runs keep their first period only; columns as they were.

    A text without runs stays letter for letter; in others the kept words are joined by one
    space. ``n_chars`` follows the text where docs has it. Null stays null.
    """

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        out = column.to_pylist()
        for k, words, begin, length, q in found(_texts(column), None, least, times):
            if len(begin):
                out[k] = _kept(words, begin, length, q).decode()
        return pa.array(out, pa.string())

    out = docs.withColumn("text", texts("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
