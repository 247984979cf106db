import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from accessmine.llm import lexical, queries
from tests.oracle import compared, connected

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def scores(docs, items):
    """{item: [(score, doc_id)]} of all documents, scored one by one."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    held = [c for _, c in counts if c]
    N, L = len(held), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((score, doc_id))
        out.append((item_id, sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))))
    return out


@pytest.mark.parametrize("top", [1, 7, 50])
def test_odd_rows(spark, odd, top):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = [(k, docs[k * 5][1][:60]) for k in range(8)] + [(20, None), (21, "  --"), (22, "x X y"), (None, "OTHER ba"), (None, "nowhere-at-all"), (22, "x X y")]
    table = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = lexical.ranked(lexical.indexed(odd), table, top).collect()
    want = [(i, k + 1, d, s) for i, found in scores(docs, items) for k, (s, d) in enumerate(found[:top])]
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=repr) == sorted(want, key=repr)


def test_many_documents_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 64)
    monkeypatch.setattr(lexical, "ITEMS", 3)
    r = random.Random(6)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.choice([3, 40, 40, 300])))) for k in range(1500)]
    docs += [(k + 2000, docs[k][1]) for k in range(200)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 30)))) for k in range(10)]
    index = lexical.indexed(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    got = lexical.ranked(index, spark.createDataFrame(items, "item_id long, text string"))
    want = [(i, k + 1, d, s) for i, found in scores(docs, items) for k, (s, d) in enumerate(found[:50])]
    assert sorted((x.item_id, x.rank, x.doc_id, x.score) for x in got.collect()) == sorted(want)


def test_bounds_are_never_below_and_seldom_far_above(spark):
    r = random.Random(7)
    docs = [(k, " ".join(f"w{int(r.paretovariate(0.5))}" for _ in range(r.choice([20, 200, 2000])))) for k in range(400)]
    items = [(k, " ".join(f"w{int(r.paretovariate(0.5))}" for _ in range(25))) for k in range(5)]
    index = lexical.indexed(spark.createDataFrame(docs, "doc_id long, text string").repartition(2))
    table = spark.createDataFrame(items, "_item long, text string")
    q = lexical.Searched(lexical.weighted(index, table).collect(), index, 50).ready()
    exact = {(i, d): s for i, found in scores(docs, items) for s, d in found}
    far = []
    for block in index.signatures.collect():
        bound = q.bounds(block.bits, np.array(block.n), bytes(block.slices))
        for x, item in enumerate(q.items):
            for y, row in enumerate(block.rows):
                assert bound[x, y] >= exact.get((item, row), 0)
                far.append(bound[x, y] / max(1, exact.get((item, row), 1)) > 1.1)
    assert len(far) == 2000 and sum(far) < 400


def test_none(spark, none, odd):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked(lexical.indexed(none), items).collect() == []
    assert lexical.ranked(lexical.indexed(odd), items.limit(0)).collect() == []


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compared(queries.QUERIES["op11_lexical_search"](spark, sf), queries.ORACLE["op11_lexical_search"], connected(sf)) is None
