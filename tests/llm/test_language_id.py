import random
from collections import Counter

import numpy as np

from accessmine.llm import language_id as li


def made(spark, n=400):
    r = random.Random(1)
    syl = {"aa": ["ba", "bo", "bi", "da"], "bb": ["ké", "tö", "ñu", "ça"], "cc": ["shr", "ith", "wem", "olk"]}
    rows = []
    for i in range(n):
        lang = r.choice(list(syl))
        words = ["".join(r.choice(syl[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(4, 60))]
        rows.append((i, " ".join(words), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = made(spark)
    filters = li.learned(docs.where("doc_id % 5 > 0").select("text", "lang"))
    out = li.identified(docs.where("doc_id % 5 = 0"), filters)
    assert out.where("lang_pred = lang").count() == out.count() > 50
    assert out.where("score < 0 or score > 1").count() == 0


def test_filters_return_all_languages(spark):
    docs = made(spark)
    filters = li.learned(docs.select("text", "lang"))
    brute = {}
    for r in docs.collect():
        brute.setdefault(r.lang, set()).update(li.trigrams([r.text])[0].tolist())
    for text in (x.text for x in docs.limit(20).collect()):
        grams = li.trigrams([text])[0].tolist()
        n, found = filters.hits([text])
        for k, lang in enumerate(filters.languages):
            assert n[0] == len(grams) and abs(found[0, k] - sum(g in brute[lang] for g in grams)) <= 0.1 * len(grams) + 3


def test_odd_rows(odd, none):
    filters = li.learned(odd.where("lang is not null").select("text", "lang"))
    out = li.identified(odd.select("doc_id", "text", "label"), filters)
    assert out.count() == odd.count() and out.columns == ["doc_id", "text", "label", "lang_pred", "score"]
    assert {r.lang_pred for r in out.where("text is null or trim(text) = ''").collect()} == {"und"}
    assert li.identified(none, filters).count() == 0
    empty = li.learned(none.select("text", "lang"))
    assert li.identified(odd, empty).where("lang_pred <> 'und'").count() == 0


def plain(filters, text):
    """The decision in plain Python, bit by bit."""
    low = " " + "".join(c if c.isalpha() else "\0" for c in text.lower()) + " "
    grams = [low[k - 1 : k + 2] for k in range(1, len(low) - 1) if low[k].isalpha()]
    if not grams or not filters.languages:
        return "und", 0.0
    codes = np.array([sum((ord(c) if c.isalpha() else 0) << s for c, s in zip(g, (42, 21, 0), strict=True)) for g in grams], np.uint64)
    slots = li.slots_of(codes)
    sure = []
    for k in range(len(filters.languages)):
        have = sum(all(int(filters.masks[s[i], k // 63]) >> (k % 63) & 1 for s in slots) for i in range(len(grams)))
        sure.append(max(0.0, (have - len(grams) * filters.false[k]) / (1 - filters.false[k])))
    best = sure.index(max(sure)) if max(sure) > 0 else list(filters.sizes).index(max(filters.sizes))
    return filters.languages[best], max(sure) / sum(sure) if max(sure) > 0 else 0.0


def test_decision_against_plain_python(spark, odd):
    docs = made(spark)
    filters = li.learned(docs.select("text", "lang"))
    texts = [r.text for r in docs.limit(40).collect()] + ["", "123 !?", "zzz qqq", "ba\nké shr", "É", "x" * 50]
    got = li.identified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), filters)
    for r in got.collect():
        lang, score = plain(filters, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9, texts[r.doc_id]


def test_masks_hold_exactly_the_kept_trigrams(spark):
    docs = made(spark, 60)
    filters = li.learned(docs.select("text", "lang"))
    n = Counter()
    for r in docs.collect():
        n.update((r.lang, int(g)) for g in li.trigrams([r.text])[0])
    total = Counter()
    for (lang, _), c in n.items():
        total[lang] += c
    best = Counter()
    for (lang, g), c in n.items():
        best[g] = max(best[g], c / total[lang])
    want = np.zeros_like(filters.masks)
    for (lang, g), c in n.items():
        share = c / total[lang]
        if share >= li.LEAST_SHARE and c >= li.LEAST_COUNT and share >= li.LEAST_RATIO * best[g]:
            for s in li.slots_of(np.array([g], np.uint64)):
                want[s[0], 0] |= np.uint64(1 << filters.languages.index(lang))
    assert (want == filters.masks).all() and want.any()


def test_clashing_names(spark):
    docs = made(spark, 30)
    filters = li.learned(docs.select("text", "lang"))
    clash = docs.selectExpr("doc_id", "text", "1 as _found", "2 as `a.b`", "'mine' as lang_pred", "'own' as Score", "lang as found")
    out = li.identified(clash.unionAll(clash), filters)
    assert out.columns == ["doc_id", "text", "_found", "a.b", "found", "lang_pred", "score"]
    assert out.where("_found = 1 and `a.b` = 2 and lang_pred <> 'mine'").count() == 60 and out.distinct().count() == 30
    both = li.identified(clash, filters, "guess", "share")
    assert both.where("lang_pred = 'mine' and Score = 'own' and guess is not null and share >= 0").count() == 30
