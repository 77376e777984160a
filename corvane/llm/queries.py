"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import additive, decontamination, linededup, lm, packing, pii, quality, simhash, tokencounts, toxicity
from corvane.llm.storage import table


def op1_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencounts.count(table(spark, sf_dir, "documents"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return counted.select("doc_id", "doc_tokens", F.size("section").cast("long").alias("n_sections"), total("n_crossing").alias("n_crossing"), "n_tokens")


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_lines", "n_removed")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), toxicity.remainder(4) == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), toxicity.remainder(5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = toxicity.remainder(7) == 2
    scored = lm.score(table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("version")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES = (op1_tokencounts, op2_linededup, op3_pii, op4_quality, op5_toxicity, op6_additive, op7_simhash, op8_lm, op9_decontamination, op10_packing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_linededup": linededup.ORACLE}
