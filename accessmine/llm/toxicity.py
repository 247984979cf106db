"""Toxicity scores by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accessmine.llm.common import stored

#: Seed words, fixed values: two lexicons of common English insults.
INSULTS = "idiot moron stupid dumb imbecile fool clown loser pathetic retard jerk".split()
CONTEMPT = "scum trash garbage vermin filth worthless disgusting subhuman parasite scumbag".split()
#: Letters of a word beginning.
STEM = 5
#: Places of the classifier's features; terms go to them by a hash, however many there are.
FEATURES = 1 << 16
LEAST_DOCS, LEAST_PRECISION = 5, 0.7
#: Labelled documents to learn from, about, if there are more: those whose ids have the lowest hashes.
LABELLED = 100_000
VOTERS = ("insults", "contempt", "words_a", "words_b", "stems_a", "stems_b", "dense", "shouting", "exclaiming", "repeated")

_word = re.compile(r"[^\W\d_]+")
_shout = re.compile(r"\b[A-Z]{4,}\b")


def terms(text: str) -> tuple[set[str], set[str]]:
    """Lower-cased words, and beginnings of the longer ones."""
    words = set(_word.findall(text.lower()))
    return words, {w[:STEM] for w in words if len(w) > STEM}


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (term, t, n): toxic and other documents with each term, summed within a batch."""
    for batch in batches:
        counts = Counter(), Counter()
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            words, stems = terms(text.as_py() or "")
            counts[toxic == 1].update(words)
            counts[toxic == 1].update(f"{s}*" for s in stems)
        names = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][x] for x in names], pa.int64()), pa.array([counts[0][x] for x in names], pa.int64())], names=["term", "t", "n"])


def mined(train: DataFrame) -> tuple[list[str], list[str]]:
    """Words and word beginnings that labelled toxic documents of train (text, toxic) have and others hardly.

    All of them: as each is in LEAST_DOCS toxic documents, there are no more than a fifth of
    the words that the labelled sample's toxic documents have.
    """
    counts = train.select("text", "toxic").mapInArrow(_mine, "term string, t bigint, n bigint").groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    good = counts.where((F.col("t") >= LEAST_DOCS) & (F.col("t") >= LEAST_PRECISION * (F.col("t") + F.col("n"))))
    found = sorted(good.select("term").toArrow()["term"].to_pylist())
    return [x for x in found if not x.endswith("*")], [x[:-1] for x in found if x.endswith("*")]


def _voting(words: list[str], stems: list[str], spark):
    half = lambda x: "ab"[zlib.crc32(x.encode()) % 2]
    shared = spark.sparkContext.broadcast((frozenset(words), frozenset(stems), frozenset(INSULTS), frozenset(CONTEMPT)))
    kind = T.StructType([T.StructField("votes", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType()))])

    @F.arrow_udf(kind)
    def vote(texts: pa.Array) -> pa.Array:
        known, beginnings, insults, contempt = shared.value
        votes, found = [], []
        for x in texts:
            text = x.as_py() or ""
            own, begin = terms(text)
            hit, stem = own & known, begin & beginnings
            seeds = own & insults, own & contempt
            shouts = text.isascii() and len(_shout.findall(text)) > 2
            loud = text.count("!") > 2
            many = len(hit | seeds[0] | seeds[1]) > 1
            flags = {"insults": seeds[0], "contempt": seeds[1], "dense": many, "shouting": shouts, "exclaiming": loud, "repeated": "!!" in text}
            for part in "ab":
                flags[f"words_{part}"] = any(half(w) == part for w in hit)
                flags[f"stems_{part}"] = any(half(w) == part for w in stem)
            votes.append(sum(1 << k for k, v in enumerate(VOTERS) if flags[v]))
            found.append(sorted({*hit, *seeds[0], *seeds[1], *(f"{s}*" for s in stem), *(f"?{k}" for k in ("dense", "shouting", "exclaiming") if flags[k])}))
        return pa.StructArray.from_arrays([pa.array(votes, pa.int64()), pa.array(found, pa.list_(pa.string()))], names=["votes", "terms"])

    return vote


class LabelModel:
    """How the hidden label makes the voters vote, by expectation-maximisation.

    Voters are taken as independent given the label at first; what correlation remains
    within a label then lowers the weight of voters that say the same thing twice. A known
    label is one more voter, of its own estimated reliability.
    """

    def __init__(self, rounds: int = 60):
        self.rounds = rounds

    def fit(self, votes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Posterior of label 1 for each row: votes (0/1), label (-1 unknown, 0, 1), weight (documents)."""
        known = label >= 0
        post = np.where(known, np.where(label == 1, 0.95, 0.02), np.clip(votes.mean(axis=1) * 2, 0.02, 0.95))
        self.share = np.ones(votes.shape[1])
        for turn in range(self.rounds):
            w1, w0 = weight * post, weight * (1 - post)
            self.prior = (w1.sum() + 1) / (weight.sum() + 2)
            self.on1 = ((w1[:, None] * votes).sum(axis=0) + 0.5) / (w1.sum() + 1)
            self.on0 = ((w0[:, None] * votes).sum(axis=0) + 0.5) / (w0.sum() + 1)
            self.label1 = ((w1 * (label == 1)).sum() + 4) / ((w1 * known).sum() + 5)
            self.label0 = ((w0 * (label == 1)).sum() + 0.2) / ((w0 * known).sum() + 5)
            if turn % 10 == 9:
                self._correlate(votes, w1, w0)
            post = self.posterior(votes, label)
        return post

    def _correlate(self, votes: np.ndarray, w1: np.ndarray, w0: np.ndarray) -> None:
        total = np.zeros((votes.shape[1],) * 2)
        for w, mean in ((w1, self.on1), (w0, self.on0)):
            dev = votes - mean
            cov = (dev * w[:, None]).T @ dev / max(w.sum(), 1e-9)
            sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
            total += w.sum() * np.clip(cov / np.outer(sd, sd), 0, 1)
        self.correlation = total / max(w1.sum() + w0.sum(), 1e-9)
        np.fill_diagonal(self.correlation, 0)
        self.share = 1 / (1 + self.correlation.sum(axis=1))

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        say = np.where(votes > 0, np.log(self.on1 / self.on0), np.log((1 - self.on1) / (1 - self.on0)))
        odds = np.log(self.prior / (1 - self.prior)) + say @ self.share
        odds = odds + np.where(label == 1, np.log(self.label1 / self.label0), 0) + np.where(label == 0, np.log((1 - self.label1) / (1 - self.label0)), 0)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def scored(docs: DataFrame, learn: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and ``score`` for every row of docs (doc_id, text).

    learn: (doc_id) of the documents to learn from; labels: (doc_id, toxic), of which only
    those in learn are used, and of these about LABELLED if there are more. A null or empty
    text has no term and gets the score of such a text; repeated rows are scored alike; a
    very long text counts whole; an empty table gives an empty result. Other columns,
    whatever their names, are not read. Without labels the seed lexicons and patterns vote
    alone.

    What reaches the driver: the mined lexicons (bounded by the labelled sample), and a count
    for each vote pattern and label (1,024 times 3 at most).
    """
    spark = docs.sparkSession
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.join(learn.select("doc_id").distinct(), "doc_id", "left_semi")
    marks = stored(marks, "labels")
    known = marks.count()
    if known > LABELLED:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int((1 << 32) * LABELLED / known))
    # few enough to go to the texts, which then aren't shuffled
    words, stems = mined(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id"))
    voted = stored(docs.select("doc_id", _voting(words, stems, spark)("text").alias("_v")).select("doc_id", "_v.*"), "votes")
    pool = voted.join(learn.select("doc_id").distinct(), "doc_id", "left_semi").join(marks, "doc_id", "left").withColumn("label", F.coalesce("toxic", F.lit(-1)))
    pool = stored(pool.groupBy("terms", "votes", "label").agg(F.count(F.lit(1)).alias("n")), "pool")
    table = pool.groupBy("votes", "label").agg(F.sum("n").alias("n")).orderBy("votes", "label").collect()
    if not table:
        return voted.select("doc_id", F.lit(0.0).alias("score"))
    votes = np.array([[r["votes"] >> k & 1 for k in range(len(VOTERS))] for r in table], float)
    post = LabelModel().fit(votes, np.array([r["label"] for r in table]), np.array([r["n"] for r in table], float))
    beliefs = spark.createDataFrame([(r["votes"], r["label"], float(p)) for r, p in zip(table, post, strict=True)], "votes long, label int, p double")
    train = pool.join(F.broadcast(beliefs), ["votes", "label"])
    train = train.groupBy("terms").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
    sides = F.array(F.struct(F.lit(1.0).alias("label"), F.col("yes").alias("weight")), F.struct(F.lit(0.0).alias("label"), F.col("no").alias("weight")))
    train = train.select("terms", F.explode(sides).alias("s")).select("terms", "s.*").where("weight > 0")
    turn = HashingTF(numFeatures=FEATURES, binary=True, inputCol="terms", outputCol="features")
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=40, standardization=False).fit(turn.transform(train))
    out = model.transform(turn.transform(voted.select("doc_id", "terms")))
    return out.select("doc_id", vector_to_array("probability")[1].alias("score"))
