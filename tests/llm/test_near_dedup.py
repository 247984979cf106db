import random
import re

from accessmine.llm import near_dedup as nd

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size=2):
    sets = {d: shingles(t, size) for d, t in rows}
    ids = sorted(sets)
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {(d, len(sets[d]), root(d), root(d) == d) for d in ids}


def test_against_brute_force(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    for size in (2, 5):
        assert {tuple(r) for r in nd.near_groups(odd, size).where("doc_id is not null").collect()} == brute(rows, size)
    assert nd.near_groups(odd).where("doc_id is null and kept and component_id is null").count() == 2
    assert nd.near_groups(odd).count() == odd.count() and nd.near_groups(none).count() == 0
    out = nd.near_deduplicated(odd, 2)
    assert out.columns == odd.columns and nd.near_deduplicated(none).count() == 0


def test_rows_with_null_or_repeated_ids_are_texts_of_their_own(spark):
    rows = [(1, "Same text here now"), (1, "Other words only in this row"), (2, "same Text here now"), (2, "nothing else is like this"), (None, "a row without an id"), (None, "A row without an id"), (3, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = sorted(((r.doc_id, r.component_id, r.kept) for r in nd.near_groups(docs).collect()), key=repr)
    want = [(1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True), (None, None, True), (None, None, True), (3, 3, True), (3, 3, True)]
    assert groups == sorted(want, key=repr)
    left = [(r.text or "").translate(LOW) for r in nd.near_deduplicated(docs, 2).collect()]
    assert sorted(left) == sorted(["same text here now", "other words only in this row", "nothing else is like this", "a row without an id", "", ""])


def test_pairs_just_above_and_below_the_threshold(spark):
    r = random.Random(7)
    rows = []
    for g in range(12):  # copies of one text with so many words changed that some pairs pass and some fail
        base = [f"g{g}w{k}" for k in range(120)]
        for i in range(12):
            w = list(base)
            for k in r.sample(range(120), 6):
                w[k] = f"x{g}-{i}-{k}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (2, 5):
        assert {tuple(x) for x in nd.near_groups(docs, size).collect()} == brute(rows, size)


def test_parity_bitmaps_bound_the_difference():
    import numpy as np

    r = np.random.default_rng(3)
    for n, m, both in [(50, 60, 40), (3000, 2800, 2500), (1, 1, 0), (7, 0, 0)]:
        x = r.integers(0, 1 << 62, n + m - both, dtype=np.uint64)
        with np.errstate(over="ignore"):
            a, b = nd.parity(np.unique(x[:n])), nd.parity(np.unique(x[n - both :]))
        assert sum(int(v).bit_count() for v in (a ^ b).view(np.uint64)) <= n + m - 2 * both


def test_chains_of_near_copies(spark):
    r = random.Random(4)
    base, rows = [f"w{r.randint(0, 999)}" for _ in range(90)], []
    for i in range(60):  # each differs from the next by little, from the last by much
        base[(i * 7) % 90] = f"x{i}"
        rows.append((1000 - i, " ".join(base)))
    rows += [(i, " ".join(f"w{r.randint(0, 99)}" for _ in range(50))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(x) for x in nd.near_groups(docs).collect()} == brute(rows)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 470)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {tuple(x) for x in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, root(x)) for a, b in edges if a != b for x in (a, b)}
