import hashlib
import random
import zlib

import numpy as np
import pytest

from accessmine.llm import periodic


def runs_by_hand(w, least=6, times=4):
    """Every stretch with smallest period q that can't be longer, by comparing word by word."""
    out = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            k = i
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            length = k - i + q
            if k > i and length >= max(least, times * q):
                piece = w[i : i + length]
                if not any(piece[p:] == piece[:-p] for p in range(1, q)):
                    out.add((i, length, q))
            i = k + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def report_by_hand(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(w)
    gone = {i for b, m, q in runs for i in range(b + q, b + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    listed = "".join(f"{b},{m},{q}\n" for b, m, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def text_with_runs(r):
    out = []
    for _ in range(r.randint(1, 6)):
        unit = [r.choice("abcd") for _ in range(r.randint(1, 6))]
        if r.random() < 0.3:
            unit = unit * r.randint(2, 4) + [r.choice("abcd")]
        out += unit * r.randint(1, 7) + unit[: r.randint(0, len(unit))]
        out += [r.choice("abcdefgh") for _ in range(r.randint(0, 8))]
    return out


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (1, 3), (9, 2)])
def test_runs_of_many_texts_at_once(least, times):
    r = random.Random(times)
    texts = [text_with_runs(r) for _ in range(150)] + [[], ["a"], ["a"] * 40, ["a", "b"] * 30 + ["a"]]
    r.shuffle(texts)
    first = np.cumsum([0, *map(len, texts)])
    begin, length, q = periodic.runs(np.array([ord(c) - 97 for t in texts for c in t]), first, least, times)
    for k, t in enumerate(texts):
        own = (begin >= first[k]) & (begin < first[k + 1])
        got = list(zip((begin[own] - first[k]).tolist(), length[own].tolist(), q[own].tolist(), strict=True))
        assert got == runs_by_hand(t, least, times)


def test_grammar_and_its_queries():
    r = np.random.default_rng(3)
    s = np.concatenate([[90], np.tile(r.integers(0, 3, 40), 6), r.integers(0, 2, 300), np.zeros(50, int), np.tile(r.integers(0, 4, 7), 30), [91]])
    levels = periodic.grammar(s)
    assert len(levels[-1].symbols) == 1
    for level in levels:  # the same symbol stands for the same words
        texts = {}
        for x, a, b in zip(level.symbols.tolist(), level.at[:-1].tolist(), level.at[1:].tolist(), strict=True):
            assert texts.setdefault(x, s[a:b].tolist()) == s[a:b].tolist()
        assert len({tuple(t) for t in texts.values()}) == len(texts)
    i, j = np.sort(r.integers(0, len(s), (2, 4000)), axis=0)
    i, j = i[i < j], j[i < j]
    for ahead, d in ((True, 1), (False, -1)):
        got = periodic.extension(levels, i, j, ahead)
        for a, b, k in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
            n = 0
            while s[a + d * n] == s[b + d * n]:
                n += 1
            assert n == k


def test_report(spark, odd):
    r = random.Random(8)
    rows = [(x.doc_id, x.text) for x in odd.select("doc_id", "text").collect() if x.doc_id != 1005]
    rows += [(k, " ".join(text_with_runs(r)) + "\t\n Ä\x0bä") for k in range(2000, 2300)] + [(5000 + k, None) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(x) for x in periodic.run_report(docs).collect()), key=repr)
    assert got == sorted((report_by_hand(*x) for x in rows), key=repr)
    assert sum(x[1] > 0 for x in got) > 100


def test_very_long_and_clashing(spark, odd, none):
    got = {x.doc_id: x for x in periodic.run_report(odd).collect()}
    assert (got[1005].n_runs, got[1005].start, got[1005].length, got[1005].period) == (1, 1, 60000, 2)
    assert periodic.run_report(none).collect() == [] and periodic.periodic_runs(none).collect() == [] and periodic.collapsed(none).collect() == []
    flat = periodic.collapsed(odd)
    assert flat.columns == odd.columns and flat.count() == odd.count()
    rows = {x.doc_id: x for x in flat.collect()}
    assert rows[1005].text == "é" * 5000 + " x y" and rows[1005].n_chars == 5004
    assert rows[1000].text is None and rows[1002].text == " \t\n\r "
    assert [tuple(x) for x in periodic.periodic_runs(odd).where("doc_id = 1005").collect()] == [(1005, 1, 60000, 2)]
