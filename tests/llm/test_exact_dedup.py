import hashlib
from collections import defaultdict

from accessmine.llm import exact_dedup as e

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOW)].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((x for x in ids if x is not None), default=None)
        out += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out, key=repr)


def test_against_brute_force(odd):
    want = brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert sorted(map(tuple, e.exact_groups(odd).collect()), key=repr) == want


def test_huge_texts_are_hashed_in_parts(odd, monkeypatch):
    whole = {(r.doc_id, r._fp) for r in e.fingerprinted(odd.select("doc_id", "text")).collect()}
    monkeypatch.setattr(e, "PART", 37)
    assert {(r.doc_id, r._fp) for r in e.fingerprinted(odd.select("doc_id", "text"), huge=50).collect()} == whole
    want = brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert sorted(map(tuple, e.exact_groups(odd, huge=50).collect()), key=repr) == want


def test_colliding_fingerprints_are_told_apart(odd):
    want = brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert sorted(map(tuple, e.exact_groups(odd, primes=(2, 3)).collect()), key=repr) == want


def test_polynomials_compose():
    import numpy as np

    a, b = np.frombuffer(b"\0abc" * 20000, np.uint8), np.frombuffer(b"xyz" * 999, np.uint8)
    base, prime = e.BASES[0], e.PRIMES[0]
    assert e.polynomial(np.concatenate([a, b]), base, prime) == e.joined(e.polynomial(a, base, prime), e.polynomial(b, base, prime), len(b), base, prime)


def test_filter_keeps_columns_and_empty_tables(odd, none):
    out = e.deduplicated(odd)
    assert out.columns == odd.columns
    # one row for each text, also of rows that repeat an id and a text
    texts = [(r.text or "").translate(LOW) for r in out.collect()]
    assert sorted(texts) == sorted({(r.text or "").translate(LOW) for r in odd.collect()})
    assert e.exact_groups(none).count() == 0 and e.deduplicated(none).count() == 0


def test_filter_tells_rows_with_one_id_apart(spark):
    rows = [(None, "x"), (None, "y"), (5, "X"), (1, "a"), (2, "a"), (1, "b"), (None, None), (7, ""), (None, "z"), (3, "y z")]
    rows += [(8, "twice"), (8, "Twice"), (8, "once")]
    out = e.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    out = out.where("not (doc_id = 8 and lower(text) = 'twice')").unionByName(out.where("doc_id = 8 and lower(text) = 'twice'").selectExpr("doc_id", "lower(text) as text"))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(None, "y"), (5, "X"), (2, "a"), (1, "b"), (7, ""), (None, "z"), (3, "y z"), (8, "twice"), (8, "once")], key=repr)
