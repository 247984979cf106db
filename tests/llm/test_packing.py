import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from accessmine.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_tokenizers():
    t = Tokenizer.from_file(PATH)
    texts = ["Hello, World! it's 2024 — can't  stop", "été İstanbul ΣΑΣ ß", "<|endoftext|> x<|startoftext|>y", "", " \n", "a b c\x1cd", "日本語テキスト mixed 中文", "😀😀 ok", "they'll we've I'm x's's", "naïve-café’s", "Foo, bar. Baz.\nqux,. !, _. x._, ...a, b.", "\x1c", "a\x1f,"]
    ids = packing.WordIds(PATH)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for _ in range(2):
        assert [x.tolist() for x in ids(pa.array(texts))] == want
    # a slice, and nulls
    assert [x.tolist() for x in ids(pa.array([None, "É", *texts, None]).slice(2, len(texts) + 1))] == [*want, []]
    assert ids(pa.array([], pa.string())) == []


def test_ids_after_words_are_forgotten(monkeypatch):
    t = Tokenizer.from_file(PATH)
    monkeypatch.setattr(packing, "WORDS_KEPT", 60)
    ids = packing.WordIds(PATH)
    for k in range(30):
        texts = [f"the  word{k} and wörd{'x' * k} o{'a' * (k % 7)} Les élè{'ves' * (k % 5)}!! the the", "the and of " * 3]
        assert [x.tolist() for x in ids(pa.array(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(ids.index) == len(ids.uses) == len(ids.start) - 1
    assert "the" in ids.index and "and" in ids.index and len(ids.index) < 90


@pytest.mark.parametrize("lengths", [[1], [4096], [4097, 1], [100] * 90, [9000, 3000, 3000, 2000, 17, 1, 1], list(range(1, 400))])
def test_assignment(lengths):
    rows = packing.assign(np.array(lengths))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, b, n, s, o in rows:
        by_doc[d].append((b, n))
        by_seq[s].append((o, n))
    for d, n in enumerate(lengths):
        at = 0
        for b, m in sorted(by_doc[d]):
            assert b == at and m > 0
            at += m
        assert at == n
    for pieces in by_seq.values():
        at = 0
        for o, m in sorted(pieces):
            assert o == at
            at += m
        assert at == 4096 or at & (at - 1) == 0


def test_costs_are_balanced():
    r = np.random.default_rng(1)
    rows = packing.assign(r.integers(20, 600, 2000))
    spent = defaultdict(float)
    for _, _, n, s, _ in rows:
        spent[s] += packing.cost(n)
    full = sorted(spent.values())[12:]
    assert max(full) / min(full) < 1.15


def test_round_trip(odd, none):
    t = Tokenizer.from_file(PATH)
    want = sorted((repr(r.doc_id), [*t.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in odd.collect())
    rows = packing.packed(odd, PATH, with_ids=True, block_tokens=3000).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in rows)
    assert sum(r.length for r in rows) == sum(len(x) for _, x in want)
    single = {i: x for i, x in want if sum(i == j for j, _ in want) == 1}
    for i, ids in single.items():
        own = sorted((r.start, r.ids) for r in rows if repr(r.doc_id) == i)
        assert [x for _, p in own for x in p] == ids
    assert packing.packed(none, PATH).count() == 0
