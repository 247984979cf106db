import re

from accessmine.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, done = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in done]
        if not open_:
            return done
        left, weight = total - sum(done.values()), sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / weight >= 2 * sizes[s]]
        if not over:
            return done | {s: left * w[s] / weight for s in open_}
        done |= {s: 2.0 * sizes[s] for s in over}


def check(docs):
    rows = mixing.mix_report(docs).collect()
    own = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted((repr(r.doc_id), size(r.text)) for r in own) == sorted((repr(r.doc_id), r["size"]) for r in rows)
    totals = {}
    for r in own:
        totals[r.source] = totals.get(r.source, 0) + size(r.text)
    goal = water(totals)
    source = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        source.setdefault((r.source_size, round(r.target, 3)), []).append(r.taken)
    for (n, t), taken in source.items():
        assert any(abs(goal[s] - t) < 1e-2 and totals[s] == n for s in goal)
    return rows, goal


def test_against_brute_force(odd, none):
    rows, goal = check(odd.dropDuplicates())
    by = {}
    for r in rows:
        by.setdefault(round(r.target, 3), []).append(r.taken)
    for t, taken in by.items():
        assert abs(sum(taken) - t) <= 1
    assert sorted(map(str, mixing.mix_report(odd.dropDuplicates()).collect())) == sorted(map(str, rows))
    check(odd)
    assert mixing.mix_report(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixed_rows(odd):
    docs = odd.dropDuplicates()
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    taken = {r.doc_id: r.taken for r in mixing.mix_report(docs).where("doc_id is not null").collect()}
    got = {}
    whole = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        if r.doc_id is not None:
            got[r.doc_id] = got.get(r.doc_id, 0) + len(WORD.findall(r.text))
            assert whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert got == {k: v for k, v in taken.items() if v}


def test_splitting_tree_meets_quotas(spark):
    blocks = spark.range(1000).selectExpr("concat('s', id % 3) _source_key", "id _block", "1L _epoch")
    out = mixing.shards_of(blocks, 7, 5)
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 3 and sum(sizes) == 1000
    share = [r["count"] for r in out.groupBy("shard", "_source_key").count().collect()]
    assert min(share) > 20 and out.select("_block").distinct().count() == 1000


def test_repeated_rows_are_cut_alike(spark):
    """Many copies of few rows, so that cuts fall between copies: reruns agree."""
    rows = [(k % 7, " ".join(f"w{k % 7}{j}" for j in range(9 + k % 7)), "ab"[k % 2]) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = sorted(map(tuple, mixing.mixed(docs.repartition(3), seed=3).collect()))
    assert first == sorted(map(tuple, mixing.mixed(docs.repartition(5, "text"), seed=3).collect()))
    assert len(first) >= 400
