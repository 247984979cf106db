import random
import re

import numpy as np

from accessmine.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: "".join(c for c in m.group() if c in "0123456789")

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


def test_base_rules():
    r = random.Random(9)
    parts = ["a", "b.", "@", "x@y.z", "-", ".", "+", "1", "22", "255.1", "4111111111111111", " ", " (", ")", "555-", "0", "é", "@@", "+49 30 1234567", "1.2.3.4.5.6.7.8"]
    for _ in range(20000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(t) == brute(t), t


def test_added_spans(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        t = "some words here "
        if i % 3 == 0:
            t += f"call +1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)} 4524132264652876 and more "
        if i % 3 == 1:
            t += f"mail a{i}@mail.example.com from 10.0.{i % 200}.7 or +1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)} now card 4111111111111111 ok "
        if i % 5 == 0:
            t += f"lot 12-{r.randint(100, 999)} of {r.randint(10, 99)} "
        rows.append((i, t))
    out = {x.doc_id: x for x in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        b = brute(t)
        assert [out[i][f"n_{k}"] for k in pii.KINDS] == [len(b[k]) for k in pii.KINDS]
        for k in pii.KINDS:
            assert all(f"{k}:{x}:{y}" in out[i].spans.split(",") for x, y in b[k])
    assert "card:" in out[0].spans and "phone:" in out[0].spans and "card:" not in out[2].spans


def test_odd_rows(odd, none):
    out = pii.pii_report(odd)
    assert out.count() == odd.count() and pii.pii_report(none).count() == 0
    assert out.where("n_email + n_ip + n_card + n_phone > 0").count() == 0


def test_reliabilities_favour_the_rule():
    bits = np.array([[1, 1, 1, 0, 1, 1, 1, 1], [0, 1, 1, 0, 1, 1, 1, 1], [0, 0, 0, 0, 1, 0, 1, 0]], float)
    post = pii.reliabilities(bits, np.array([500.0, 40.0, 900.0]))
    assert post[0] > 0.9 and post[1] > 0.5 > post[2]
