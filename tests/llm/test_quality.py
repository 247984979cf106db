import random
from collections import Counter
from math import comb, exp, fsum, lgamma, log, log1p

from accessmine.llm import quality as q


def brute(text):
    w = q._word.findall(text)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(win)
    hit = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if q._word.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in q.SYMBOLS for c in text), len(lines), dup, len(hit), len(set(w))


def test_measures():
    r = random.Random(3)
    for _ in range(200):
        t = "".join(r.choice(["a", "b", " ", " ", "\n", "é", "|", " "]) for _ in range(r.randint(0, 80)))
        assert q.measured(t) == brute(t), t


def test_exact_bounds():
    for k, n, e in ((0, 50, 0.01), (3, 40, 0.001), (10, 10, 0.1)):
        p = q.upper_bound(k, n, e)
        tail = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert p == 1.0 or abs(tail - e) < 1e-6
    assert q.upper_bound(0, 0, 0.05) == 1.0


def test_bounds_of_large_counts():
    for k, n, e in ((2500, 4000, 0.01), (50_000, 60_000, 0.003), (9, 3_000_000, 0.003)):
        p = q.upper_bound(k, n, e)
        term, total = 1.0, []
        first = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p)
        for i in range(k, -1, -1):
            total.append(term)
            term *= i / (n - i + 1) * (1 - p) / p
        assert abs(exp(first) * fsum(total) / e - 1) < 1e-4


def test_cutoffs_against_plain_python(spark):
    r = random.Random(8)
    docs, marks = [], []
    for i in range(1500):
        w = [f"w{r.randint(0, 9999)}" + "#" * (r.random() < 0.02) for _ in range(r.choice([30, 60]))]
        docs.append((i, " ".join(w + w[: r.choice([0, 0, 0, 6])])))
        marks.append((i, int(r.random() < 0.9)))
    measured = q.with_measures(spark.createDataFrame(docs, "doc_id long, text string"))
    got = q.cutoffs(q.holdout(measured, spark.createDataFrame(marks, "doc_id long, quality int")))
    want, good = {}, {}
    for (_, text), (_, label) in zip(docs, marks, strict=True):
        n, chars, sym, lines, dup, rep, distinct = brute(text)
        if label and n >= 10 and 100 * rep <= 20 * n:
            signals = (sym / chars, rep / n, dup / lines, (n - distinct) / n)
            good.setdefault(sum(n >= x for x in q.STRATA), []).append(signals)
    for stratum, rows in good.items():
        for j, name in enumerate(q.SIGNALS):
            for c in sorted(q.CUTOFFS, reverse=True):
                if q.upper_bound(sum(x[j] > c for x in rows), len(rows), q.ERROR / 16) > q.FALSE_REJECTION / 4:
                    break
                want[stratum, name] = c
    assert got == want and len(want) >= 4


def test_report(spark, odd, none):
    labels = odd.selectExpr("doc_id", "cast(doc_id % 2 as int) quality", "0 toxic").where("doc_id is not null").distinct()
    rows = {(r.doc_id, r.n_words): r for r in q.quality_report(odd, labels).collect()}
    for r in odd.collect():
        n, chars, sym, _, dup, rep, _ = brute(r.text or "") if len(r.text or "") < 9999 else q.measured(r.text)
        got = rows[r.doc_id, n]
        assert (got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (chars, sym, dup, rep)
        assert got.base_failed == (n < 10 or 100 * rep > 20 * n) and not (got.base_failed and got.kept)
    out = q.quality_filtered(odd, labels)
    assert out.columns == odd.columns and 0 < out.count() < odd.count()
    assert q.quality_report(none, labels).count() == 0 and q.quality_report(odd, labels.limit(0)).where("kept = base_failed").count() == 0


def test_cutoffs_keep_their_promise(spark):
    r = random.Random(5)
    docs, marks = [], []
    for i in range(3000):
        bad = i % 5 == 0
        w = [f"w{r.randint(0, 9999)}" + ("###" if bad and r.random() < 0.7 else "") for _ in range(60)]
        docs.append((i, " ".join(w)))
        marks.append((i, 0 if bad else 1))
    docs, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    out = q.judged(docs, marks.where("doc_id < 2500"))
    kept = out.join(marks, "doc_id").groupBy("quality").agg({"*": "count", "kept": "max"})
    good = out.join(marks.where("quality = 1"), "doc_id")
    assert good.where("not kept").count() / good.count() <= q.FALSE_REJECTION
    assert out.join(marks.where("quality = 0"), "doc_id").where("kept").count() == 0
    assert kept.count() == 2
