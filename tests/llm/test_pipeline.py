import re

import corpus_pipeline
from accessmine.llm import common
from tests.llm.test_exact_dedup import LOW
from tests.llm.test_near_dedup import brute as near_groups

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_hold_against_brute_force(spark):
    docs = common.documents(spark, SF)
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None

    kept = common.stored(steps["quality_rules"](spark, docs, SF), "t")
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()

    single = common.stored(steps["exact_dedup"](spark, kept, SF), "t")
    last = {}
    for r in kept.collect():
        last[r.text.translate(LOW)] = max(r.doc_id, last.get(r.text.translate(LOW), -1))
    assert {r.doc_id for r in single.collect()} == set(last.values())

    apart = common.stored(steps["near_dedup"](spark, single, SF), "t")
    want = {d for d, _, _, k in near_groups([(r.doc_id, r.text) for r in single.collect()], 5) if k}
    assert {r.doc_id for r in apart.collect()} == want

    mix = common.stored(steps["mixing"](spark, apart, SF), "t")
    assert mix.columns == docs.columns
    words = lambda rows: sum(len(WORD.findall(r.text)) for r in rows)
    assert abs(words(mix.collect()) - 1.5 * words(apart.collect())) <= 20

    packed = steps["packing"](spark, mix, SF).collect()
    per = {}
    for r in packed:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in per.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 4096 or at & (at - 1) == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and "sequence_id" in out.columns


def test_stages_take_odd_rows(spark, odd, none):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns, and no rows at all."""
    texts = {r.text for r in odd.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and stage(spark, none, SF).count() == 0
        got = [r.text for r in out.collect()]
        assert got and (name == "mixing" or set(got) <= texts)
        if name in ("quality_rules", "mixing"):
            assert all(t and WORD.search(t) for t in got)
        if name == "exact_dedup":
            low = [(t or "").translate(LOW) for t in got]
            assert len(set(low)) == len(low) and set(low) == {(t or "").translate(LOW) for t in texts}
    pack = dict(corpus_pipeline.STAGES)["packing"]
    ends = pack(spark, odd, SF).where("start + length = doc_tokens").count()
    assert ends == odd.count() and pack(spark, none, SF).count() == 0
