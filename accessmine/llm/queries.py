"""The queries of these operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from accessmine.llm import common, exact_dedup, language_id, lexical, license_scan, mixing, near_dedup, packing, periodic, pii, quality, sharding, suffix_dedup, toxicity

TOKENIZER = "word_bpe_49k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(common.documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(common.documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(common.documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).withColumn("held_out", F.coalesce(common.fold(F.col("doc_id"), 5) == 0, F.lit(False)))
    filters = language_id.learned(docs.where("not held_out and lang is not null").select("text", "lang"))
    return language_id.identified(docs.select("doc_id", "held_out", "text"), filters).select("doc_id", "held_out", "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(common.documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    learn = docs.select("doc_id").where(common.fold(F.col("doc_id"), 3) != 1)
    out = toxicity.scored(docs.select("doc_id", "text"), learn, common.labels(spark, sf_dir))
    held_out = F.coalesce(common.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(common.documents(spark, sf_dir), common.labels(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_report(common.documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(common.documents(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(common.documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical.ranked(lexical.indexed(common.documents(spark, sf_dir)), items)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(common.documents(spark, sf_dir))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(common.documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_packing, op2_license_scan, op3_exact_dedup, op4_language_id, op5_mixing, op6_toxicity, op7_quality_rules, op8_suffix_dedup, op9_pii, op10_near_dedup, op11_lexical_search, op12_periodic_runs, op13_sharding, pipeline)
}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE: dict[str, str] = {
    "op2_license_scan": license_scan.oracle(),
    "op11_lexical_search": lexical.oracle(),
    "op3_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_NORM} AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g USING (norm)""",
}
