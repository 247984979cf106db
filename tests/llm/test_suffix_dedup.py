import random

import pytest

from accessmine.llm import suffix_dedup as sd


def brute(rows, length, keep_first=False):
    """rows (id, text) in order -> kept bytes, spans removed."""
    places = {}
    raws = [(t or "").encode() for _, t in rows]
    for i, raw in enumerate(raws):
        for p in range(len(raw) - length + 1):
            places.setdefault(raw[p : p + length], []).append((i, p))
    out = []
    for i, raw in enumerate(raws):
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            found = places[raw[p : p + length]]
            if found[0] != (i, p) if keep_first else len(found) > 1:
                gone[p : p + length] = b"\1" * length
        n = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((rows[i][0], len(raw), sum(gone), n, bytes(c for c, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def texts(seed, n=40, common=10):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcdé ") for _ in range(r.randint(20, 160))) for _ in range(5)]
    rows = []
    for i in range(n):
        t = "".join(r.choice("abcdefgh ü") for _ in range(r.randint(0, 120)))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            t = t[: len(t) // 2] + p[a : a + r.randint(10, 160)] + t[len(t) // 2 :]
        rows.append((i, t))
    hot = passages[0]
    rows += [(1000 + i, "".join(r.choice("xyz") for _ in range(20)) + hot + "".join(r.choice("xyz") for _ in range(20))) for i in range(common)]
    rows += [(500, "q" * 300), (501, ""), (502, None), (503, rows[0][1]), (504, (passages[1] + "-") * 3)]
    return sorted(rows, key=lambda x: x[0])


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("together", [1500, 2])
def test_against_brute_force(spark, keep_first, together):
    length, gram = 40, 8
    rows = texts(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.without_repeats(docs, length, keep_first, together, gram).collect()), key=repr)
    assert got == brute(rows, length, keep_first)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in sd.repeats_report(odd).collect()), key=repr)
    small = [x for x in rows if len(x[1] or "") < 9999]
    want = sorted(((a, b, c, d) for a, b, c, d, _ in brute(small, 400)), key=repr)
    assert [x for x in got if x[1] < 9999] == want
    big = [x for x in got if x[1] > 9999]
    assert len(big) == 1 and big[0][2] > big[0][1] - 800
    assert sd.repeats_report(none).count() == 0


def test_long_texts_go_in_parts(spark, monkeypatch):
    from accessmine.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 100)
    rows = texts(5, 20) + [(2000, "".join(t for _, t in texts(7, 10) if t))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    import pyarrow as pa

    found = suffix_dedup._all_runs(40, 8).func(pa.array([t for _, t in rows])).to_pylist()
    whole = [sorted(p for x in r for p in range(x["p"], x["p"] + x["n"])) for r in found]
    assert whole == [list(range(max(0, len((t or "").encode()) - 39))) for _, t in rows] and docs.count() == len(rows)


def test_passages_of_over_50_words_go_by_their_bytes(spark):
    """Planted in two documents each: from 400 bytes on they go from both, below that they stay, whatever their words."""
    r = random.Random(11)

    def words(size, letters):
        """Over 50 words that fill so many bytes."""
        out = " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(51))
        return out + "".join(r.choice("abcdef") for _ in range(size - len(out.encode())))

    planted = {size: words(size, "abcdef") for size in (330, 399, 400, 401, 520)}
    planted[700] = words(700, "äéö")
    rows, want = [], {}
    for size, passage in planted.items():
        assert len(passage.split()) > 50 and len(passage.encode()) == size
        for edges in ("[]", "()"):
            own = " ".join("".join(r.choice("uvwxyz") for _ in range(6)) for _ in range(80))
            want[len(rows)] = (size, 1) if size >= 400 else (0, 0)
            rows.append((len(rows), own[: 40 * size % 500] + edges[0] + passage + edges[1] + own[::-1]))
    for _ in range(5):
        want[len(rows)] = (0, 0)
        rows.append((len(rows), " ".join("".join(r.choice("abcdef") for _ in range(6)) for _ in range(200))))
    got = {x.doc_id: x for x in sd.repeats_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {i: (x.n_removed, x.n_spans) for i, x in got.items()} == want
    assert {i: x.n_bytes for i, x in got.items()} == {i: len(t.encode()) for i, t in rows}
    assert sorted((i, x.n_removed, x.n_spans) for i, x in got.items()) == [(a, c, d) for a, _, c, d, _ in sorted(brute(rows, 400))]
