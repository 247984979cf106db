"""Personal data: base rules, wider candidates judged by labelers, and a span classifier."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accessmine.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
# Patterns of the base rules, fixed values. A match can't begin inside a run of digits
# whose beginning failed, which the look-behinds say so that long runs are read once.
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")

# Wider candidates.
_veiled = re.compile(r"[(\[{]at[)\]}]", re.I)
_wide = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:(?:\+|00)[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)|[0-9]{2,5})[ .-][0-9]{3,4}(?:[ .-][0-9]{3,4}){0,2}(?![0-9])"),
}
LABELERS = ("rule", "checked", "gazetteer", "context", "apart", "even", "varied", "sized")
#: Gazetteers, fixed values: common top-level domains, country calling codes, first digits of cards.
TOP_LEVEL = frozenset("com org net edu gov int info biz io co uk de fr es it nl eu us ca au jp cn in ru br ch se no at be pl".split())
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "62", "64", "65", "7", "81", "82", "86", "90", "91")
CARD_STARTS = ("34", "35", "36", "37", "4", "51", "52", "53", "54", "55", "6")
CONTEXT = {
    "email": re.compile(r"mail|contact|write|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|addr|login", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta|pay", re.I),
    "phone": re.compile(r"tel|phone|call|mobile|fax|cell|ruf", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in re.findall(r"[0-9]+", text))


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _local:
            a -= 1
        m = _domain.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Matches of the base rules by kind, leftmost and not overlapping; failing ones are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if not _digit.search(text):
        return out
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    out["ip"] = [m.span() for m in _ip.finditer(text) if _octets(m.group())]
    out["card"] = [m.span() for m in _card.finditer(text) if 13 <= len(d := digits(m)) <= 19 and luhn(d)]
    if "+" in text:
        out["phone"] = [m.span() for m in _phone.finditer(text) if 9 <= len(digits(m)) <= 15]
    return out


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def votes(kind: str, text: str, a: int, b: int, rule: bool) -> int:
    """What the labelers say of text[a:b], as bits in the order of LABELERS."""
    span = text[a:b]
    d = re.sub(r"[^0-9]", "", span)
    seps = set(re.findall(r"[ .-]", re.sub(r"^\+?[0-9]*[ .-]?\([0-9]*\)[ .-]?", "", span)))
    checked = {"email": "." in span or "dot" in span.lower(), "ip": _octets(span), "card": luhn(d), "phone": 9 <= len(d) <= 15}[kind]
    listed = {
        "email": span.rpartition(".")[2].strip().lower() in TOP_LEVEL,
        "ip": d[:1] != "0" and not span.startswith(("0.", "255.")),
        "card": d.startswith(CARD_STARTS),
        "phone": span.startswith("+") and d.startswith(CALLING) or "555" in d,
    }[kind]
    sized = {"email": len(span) <= 80, "ip": len(re.findall(r"[0-9]+", span)) == 4, "card": len(d) in (15, 16), "phone": 10 <= len(d) <= 13}[kind]
    apart = not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())
    says = {
        "rule": rule,
        "checked": checked,
        "gazetteer": listed,
        "context": bool(CONTEXT[kind].search(text, max(0, a - 30), a)),
        "apart": apart,
        "even": len(seps) <= 1,
        "varied": len(set(d)) > 2 or kind == "email",
        "sized": sized,
    }
    return sum(1 << k for k, x in enumerate(LABELERS) if says[x])


def candidates(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, votes): base spans, and wider ones of a kind that overlap no base span of any kind."""
    base = base_spans(text)
    out = [(k, a, b, votes(k, text, a, b, True)) for k in KINDS for a, b in base[k]]
    digits = bool(_digit.search(text))
    taken = [s for k in KINDS for s in base[k]]
    for kind in ("email", "card", "ip", "phone"):
        if not (_veiled.search(text) if kind == "email" else digits):
            continue
        more, blocks = [], _disjoint(taken)
        begins = [x for x, _ in blocks]
        for m in _wide[kind].finditer(text):
            a, b = m.span()
            k = bisect_left(begins, b) - 1
            if k < 0 or blocks[k][1] <= a:
                more.append((a, b))
                out.append((kind, a, b, votes(kind, text, a, b, False)))
        # a longer number isn't also a shorter one of another kind
        taken += [s for s in more if kind != "phone" and votes(kind, text, *s, False) & 2]
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


_found = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("votes", T.LongType())]))


@F.arrow_udf(_found)
def _candidates(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("votes", pa.int64())]))
    rows = ([dict(zip(("kind", "a", "b", "votes"), c, strict=True)) for c in candidates(x.as_py() or "")] for x in texts)
    return pa.array(rows, kind)


def reliabilities(bits: np.ndarray, n: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Posterior that a span is real for each row of votes, n times seen, by expectation-maximisation."""
    post = np.clip(bits @ np.linspace(1.5, 0.5, bits.shape[1]) / np.linspace(1.5, 0.5, bits.shape[1]).sum(), 0.05, 0.95) ** 2
    post = np.where(bits[:, 0] > 0, 0.98, post)
    for _ in range(rounds):
        w1, w0 = n * post, n * (1 - post)
        prior = (w1.sum() + 1) / (n.sum() + 2)
        # a labeler is taken to be better than chance, which keeps the two sides from changing places
        p1 = (w1 @ bits + 1.8) / (w1.sum() + 2)
        p0 = np.minimum((w0 @ bits + 0.6) / (w0.sum() + 2), p1)
        # where the base rule is silent it abstains: what it drops in full may still hold a span
        against = np.log((1 - p1) / (1 - p0)) * (np.arange(bits.shape[1]) > 0)
        odds = np.log(prior / (1 - prior)) + bits @ np.log(p1 / p0) + (1 - bits) @ against
        post = np.where(bits[:, 0] > 0, 0.99, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    return post


def classifier(bits: np.ndarray, target: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights (the constant last) of a logistic regression on the votes, by Newton steps."""
    x = np.column_stack([bits, np.ones(len(bits))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (target - p)) - ridge * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hess, grad)
    return w


def accepted(found: DataFrame, least: float = 0.5) -> dict[str, list[int]]:
    """By kind the vote patterns of spans that the final classifier takes for real.

    What reaches the driver is a count for each kind and pattern, 1,024 rows at most.
    """
    rows = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes").collect()
    out: dict[str, list[int]] = {}
    for kind in KINDS:
        own = [r for r in rows if r["kind"] == kind]
        if own:
            bits = np.array([[r["votes"] >> k & 1 for k in range(len(LABELERS))] for r in own], float)
            n = np.array([r["n"] for r in own], float)
            # the classifier sees what any span has, not whether the base rule took it
            w = classifier(bits[:, 1:], reliabilities(bits, n), n)
            out[kind] = [r["votes"] for r, s in zip(own, bits[:, 1:] @ w[:-1] + w[-1], strict=True) if s > np.log(least / (1 - least)) and r["votes"] & 2]
    return out


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["a"].cast("string"), c["b"].cast("string"))), ",")


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, base and all: the spans of base rules, and those with what the classifier adds.

    Spans are structs (kind, a, b, votes) in code points, end exclusive, ordered by kind
    and place. Null and empty texts have none; repeated rows have the same; an empty table
    gives an empty result. Texts are read once; candidates are kept in a table.
    """
    found = stored(docs.select("doc_id", _candidates("text").alias("found")), "candidates")
    take = accepted(found)
    good = lambda c: sum((((c["kind"] == k) & c["votes"].isin(v)).cast("int") for k, v in take.items() if v), F.lit(0)) > 0
    rule = lambda c: c["votes"].bitwiseAND(F.lit(1)) == 1
    return found.select("doc_id", F.filter("found", rule).alias("base"), F.filter("found", lambda c: rule(c) | good(c)).alias("all"))


def pii_report(docs: DataFrame) -> DataFrame:
    spans = detected(docs)
    count = lambda kind: F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))
