import random

from accessmine.llm import license_scan as ls
from accessmine.llm.queries import QUERIES
from tests.oracle import compared, connected

SF = "/root/testdata/sf0.01"


def test_same_as_sql(spark):
    df = QUERIES["op2_license_scan"](spark, SF)
    assert df.count() > 5 and compared(df, ls.oracle(), connected(SF)) is None


EDGE = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = (text or "").translate(low).translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    return [w.strip(EDGE) for w in cut if w.strip(EDGE)]


def brute(text, least=ls.LEAST):
    w = words(text)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    windows = [set(sh[k : k + 8]) for k in range(0, len(sh), 4)]
    out = set()
    for name, t in ls.TEMPLATES.items():
        tw = words(t)
        own = list(dict.fromkeys(" ".join(tw[i : i + 3]) for i in range(len(tw) - 2)))
        n = -(-len(own) // 5)
        parts = [own[p * len(own) // n : (p + 1) * len(own) // n] for p in range(n)]
        c = sum(max((len(x & set(p)) for x in windows), default=0) for p in parts)
        if c / len(own) >= least:
            out.add((name, c))
    return out


def test_planted(spark, odd, none):
    r = random.Random(6)
    rows = []
    for i in range(120):
        words = [f"w{r.randint(0, 50)}" for _ in range(r.randint(0, 60))]
        if i % 2:
            t = r.choice(list(ls.TEMPLATES.values())).split()
            if i % 4 == 1 and len(t) > 8:
                t[r.randint(0, len(t) - 1)] = "other"
            k = r.randint(0, len(words))
            words[k:k] = t
        rows.append((i, " ".join(words)))
    got = {}
    for x in ls.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(x.doc_id, set()).add((x.template, x.matched))
    assert all(got.get(i, set()) == brute(t) for i, t in rows)
    assert ls.scanned(odd).count() == 0 and ls.scanned(none).count() == 0


def test_statements_inside_sentences(spark):
    texts = ["Released under the MIT License, see LICENSE", "Released under the MIT License", "(released\nunder   the 'MIT' License!)", "# Licensed under CC BY-NC 4.0 *", "Released under an MIT License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.template) for r in ls.scanned(docs).collect()) == [(0, "MIT"), (1, "MIT"), (2, "MIT"), (3, "CC-BY-NC-4.0")]


def test_altered_wrapped_and_cut_headers(spark):
    """Whole headers as they stand in files: commented, wrapped, a word changed, the end cut."""
    r, rows, want = random.Random(3), [], set()
    for k in range(200):
        name = r.choice(["Apache-2.0-header", "MIT-text", "GPL-3.0-header", "BSD-text"])
        w = ls.TEMPLATES[name].split()
        if k % 4 == 1:
            w[r.randint(3, len(w) - 4)] = "other"
        if k % 4 == 2:
            w = w[: int(len(w) * 0.93)]
        if k % 4 == 3:
            w = [x.upper() if r.random() < 0.3 else x for x in w]
        lines = [" * " + " ".join(w[i : i + 9]) for i in range(0, len(w), 9)]
        rows.append((k, "before it\n" + "\r\n".join(lines) + "\nafter it"))
        want.add((k, name))
    rows += [(1000 + k, " ".join(r.sample(" ".join(ls.TEMPLATES.values()).split(), 80))) for k in range(20)]
    got = {(x.doc_id, x.template) for x in ls.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got & want) >= 0.95 * len(want) and not {x for x in got if x[0] >= 1000}
    assert got == {(k, t) for k, x in rows for t, _ in brute(x)}
