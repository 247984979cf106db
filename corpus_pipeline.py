"""From raw documents to packed training sequences: five stages, each a Spark job.

Every stage but the last returns the columns of documents; each is written as Parquet and
read again by the next, so a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from accessmine.llm import common, exact_dedup, mixing, near_dedup, packing, quality

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, those without words (null texts too) among them.

    Texts are measured whole; rows that repeat share a verdict; other columns go along,
    whatever their names; an empty table stays empty.
    """
    return quality.quality_filtered(docs, common.labels(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays, of the largest doc_id; null counts as empty.

    Rows with null or repeated ids are judged by their texts; texts of any length are
    compared whole; other columns go along, whatever their names; an empty table stays empty.
    """
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, Jaccard 0.8) one stays.

    Texts without words are like nothing and stay; rows with null or repeated ids are judged
    by their texts; texts of any length count whole; other columns go along, whatever their
    names; an empty table stays empty.
    """
    return near_dedup.near_deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken up to their targets, some documents twice.

    Documents without words are never taken; null sources are one, the last; rows that
    repeat are taken alike; long texts are cut at words only; other columns go along,
    whatever their names; an empty table stays empty.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens.

    A null or empty text is the end token alone; rows that repeat are each packed; long
    texts go on in further sequences; other columns aren't read; an empty table gives none.
    """
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: Thresholds, MinHash groups and tokens can't be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder."""
    docs = common.documents(spark, sf_dir)
    base = f"{common.shared_dir(spark)}/accessmine/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
