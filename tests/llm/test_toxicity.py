import math
import random
import re
import zlib

import numpy as np

from accessmine.llm import toxicity as tx


def made(spark, n=900):
    r = random.Random(2)
    bad = ["gruzen", "gruzal", "blarf", "snobbel", "idiot", "scum"]
    fine = [f"w{chr(97 + r.randint(0, 25))}{chr(97 + r.randint(0, 25))}{chr(97 + r.randint(0, 25))}" for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        words = [r.choice(fine) for _ in range(40)]
        if toxic:
            for _ in range(4):
                words[r.randint(0, 39)] = r.choice(bad)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic != (r.random() < 0.02))))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out(spark):
    docs, labels = made(spark)
    out = tx.scored(docs, docs.where("doc_id % 3 <> 1"), labels).where("doc_id % 3 = 1").collect()
    right = sum((r.score >= 0.7) == (r.doc_id % 7 == 0) for r in out)
    assert right / len(out) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_label_model_finds_reliabilities():
    r = np.random.default_rng(1)
    y = r.random(20000) < 0.2
    rates = [(0.9, 0.01), (0.6, 0.05), (0.5, 0.02)]
    votes = np.stack([r.random(20000) < np.where(y, a, b) for a, b in rates], 1).astype(float)
    votes = np.column_stack([votes, votes[:, 1]])  # says the same twice
    model = tx.LabelModel()
    model.fit(votes, np.where(r.random(20000) < 0.1, y, -1).astype(int), np.ones(20000))
    assert abs(model.on1[0] - 0.9) < 0.06 and abs(model.on0[0] - 0.01) < 0.02
    assert model.share[1] < 0.7 < model.share[0]


def test_odd_rows(spark, odd, none):
    labels = odd.where("doc_id is not null").selectExpr("doc_id", "cast(doc_id % 2 as int) toxic").distinct()
    out = tx.scored(odd, odd, labels)
    assert out.count() == odd.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert tx.scored(odd, odd, labels.limit(0)).count() == odd.count()
    assert tx.scored(none, none, labels).count() == 0


# ---- the same in plain Python, one document at a time ----


def voted_by_hand(text, words, stems):
    """(votes by name, terms) of a text."""
    own = set(re.findall(r"[^\W\d_]+", text.lower()))
    begin = {w[:5] for w in own if len(w) > 5}
    flags = dict.fromkeys(tx.VOTERS, False)
    insults, contempt = [w for w in own if w in tx.INSULTS], [w for w in own if w in tx.CONTEMPT]
    hits, tails = [w for w in own if w in words], [b for b in begin if b in stems]
    flags["insults"], flags["contempt"] = bool(insults), bool(contempt)
    for w in hits:
        flags["words_" + "ab"[zlib.crc32(w.encode()) % 2]] = True
    for b in tails:
        flags["stems_" + "ab"[zlib.crc32(b.encode()) % 2]] = True
    flags["dense"] = len({*hits, *insults, *contempt}) > 1
    flags["shouting"] = all(ord(c) < 128 for c in text) and len(re.findall(r"\b[A-Z]{4,}\b", text)) > 2
    flags["exclaiming"], flags["repeated"] = text.count("!") > 2, "!!" in text
    return flags, {*hits, *insults, *contempt, *(b + "*" for b in tails), *("?" + k for k in ("dense", "shouting", "exclaiming") if flags[k])}


def believed_by_hand(rows):
    """The posteriors of (votes, label) rows, a document each, by the same steps in loops."""
    n, k = len(rows), len(rows[0][0])
    post = [0.95 if y == 1 else 0.02 if y == 0 else min(0.95, max(0.02, 2 * sum(v) / k)) for v, y in rows]
    share = [1.0] * k
    for turn in range(60):
        w1, w0 = sum(post), n - sum(post)
        prior = (w1 + 1) / (n + 2)
        on1 = [(sum(p * v[j] for p, (v, _) in zip(post, rows, strict=True)) + 0.5) / (w1 + 1) for j in range(k)]
        on0 = [(sum((1 - p) * v[j] for p, (v, _) in zip(post, rows, strict=True)) + 0.5) / (w0 + 1) for j in range(k)]
        one = [(p, y) for p, (_, y) in zip(post, rows, strict=True) if y >= 0]
        label1 = (sum(p for p, y in one if y == 1) + 4) / (sum(p for p, _ in one) + 5)
        label0 = (sum(1 - p for p, y in one if y == 1) + 0.2) / (sum(1 - p for p, _ in one) + 5)
        if turn % 10 == 9:
            together = [[0.0] * k for _ in range(k)]
            for side, mean in ((post, on1), ([1 - p for p in post], on0)):
                total = max(sum(side), 1e-9)
                cov = [[sum(s * (v[i] - mean[i]) * (v[j] - mean[j]) for s, (v, _) in zip(side, rows, strict=True)) / total for j in range(k)] for i in range(k)]
                for i in range(k):
                    for j in range(k):
                        together[i][j] += sum(side) * min(1, max(0, cov[i][j] / math.sqrt(max(cov[i][i], 1e-9) * max(cov[j][j], 1e-9))))
            share = [1 / (1 + sum(together[i][j] / n for j in range(k) if j != i)) for i in range(k)]
        for x, (v, y) in enumerate(rows):
            odds = math.log(prior / (1 - prior)) + sum(share[j] * (math.log(on1[j] / on0[j]) if v[j] else math.log((1 - on1[j]) / (1 - on0[j]))) for j in range(k))
            odds += math.log(label1 / label0) if y == 1 else math.log((1 - label1) / (1 - label0)) if y == 0 else 0
            post[x] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return post


def fitted_by_hand(rows):
    """A logistic regression's chances for (terms, belief) rows, by Newton steps over single documents."""
    names = sorted({t for terms, _ in rows for t in terms})
    x = np.array([[float(t in terms) for t in names] + [1.0] for terms, _ in rows])
    y, w = np.array([p for _, p in rows]), np.zeros(len(names) + 1)
    ridge = np.full(len(w), 1e-4 * len(rows))
    ridge[-1] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-12), x.T @ (y - p) - ridge * w)
    return 1 / (1 + np.exp(-(x @ w)))


def test_scores_are_those_of_plain_python(spark):
    r = random.Random(5)
    bad, good = [f"grob{c}" for c in "abcdefgh"], [f"wort{a}{b}" for a in "abcdefgh" for b in "xyz"]
    rows = []
    for i in range(300):
        mean = i % 3 == 0
        words = r.sample(good, 8) + (r.sample(bad, 2) if mean and r.random() < 0.9 else []) + (["IDIOT!!"] if mean and r.random() < 0.3 else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), int(mean) if r.random() < 0.7 else None))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, toxic int")
    learn = docs.select("doc_id").where("doc_id % 4 <> 1 and doc_id < 900")
    got = {x.doc_id: x.score for x in tx.scored(docs, learn, labels).collect()}
    used = [(i, t, y) for i, t, y in rows if i % 4 != 1]
    counts = {}
    for _, t, y in used:
        if y is not None:
            own = set(re.findall(r"[^\W\d_]+", t.lower()))
            for term in own | {w[:5] + "*" for w in own if len(w) > 5}:
                counts.setdefault(term, [0, 0])[y] += 1
    mined = {t for t, (n, yes) in counts.items() if yes >= 5 and yes >= 0.7 * (yes + n)}
    words, stems = {t for t in mined if t[-1] != "*"}, {t[:-1] for t in mined if t[-1] == "*"}
    assert len(words) >= 8
    votes = [voted_by_hand(t, words, stems) for _, t, _ in used]
    post = believed_by_hand([([int(f[v]) for v in tx.VOTERS], -1 if y is None else y) for (f, _), (_, _, y) in zip(votes, used, strict=True)])
    chance = dict(zip((i for i, _, _ in used), fitted_by_hand([(terms, p) for (_, terms), p in zip(votes, post, strict=True)]), strict=True))
    assert max(abs(got[i] - p) for i, p in chance.items()) < 0.02
    assert len(got) == 301 and got[900] < 0.3


def test_no_mined_term_is_lost(spark):
    """50,000 words that only toxic documents have: all are mined, and any few of them tell."""
    many = ["q" + "".join("abcdefghij"[int(c)] for c in f"{k:05d}") for k in range(50_000)]
    toxic = [(k, " ".join(many), 1) for k in range(6)]
    clean = [(100 + k, f"plain words about nothing number {'abcdefghij'[k % 10]}", 0) for k in range(60)]
    probes = [(1000 + k, f"here {many[k * 997 % 50_000]} and {many[k * 31 % 50_000]} stand", None) for k in range(40)]
    docs = spark.createDataFrame(toxic + clean + probes, "doc_id long, text string, toxic int")
    words, stems = tx.mined(docs.where("toxic is not null"))
    assert set(words) == set(many) and len(stems) == len({w[:5] for w in many})
    out = {x.doc_id: x.score for x in tx.scored(docs.select("doc_id", "text"), docs.where("toxic is not null").select("doc_id"), docs.where("toxic is not null").select("doc_id", "toxic")).collect()}
    assert min(out[1000 + k] for k in range(40)) > max(out[100 + k] for k in range(60))
