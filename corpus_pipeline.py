"""From raw documents to packed sequences, as stages that each read what the one before wrote.

Defined cases: null texts are empty documents and null ids documents of their own, told apart by their texts; repeated
rows are one document; an empty table gives an empty result; other columns, also ones named as operators name theirs, go
through all stages but the last; without labels of both kinds nothing is toxic. A table without ``n_chars`` is taken too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontamination, linededup, neardup, packing, toxicity
from corvane.llm.storage import discard, fresh, materialise, scratch, table

#: Documents with this toxicity or more go.
TOXIC = 0.5
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic. The model learns from labelled rows outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").filter(toxicity.remainder(5) != 0)
    model = toxicity.fit(docs, labels)
    score = fresh(docs, "score")
    return toxicity.annotate(docs, model, score_col=score).filter(F.col(score) < TOXIC).drop(score)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without boilerplate lines; one whose every line stands elsewhere goes. ``n_chars`` follows the text."""
    total, removed = fresh(docs, "n_lines"), fresh(docs, "n_removed")
    done = linededup.dedup_lines(docs, lines_col=total, removed_col=removed)
    left = done.filter((F.col(removed) == 0) | F.col("text").rlike(r"[^\s]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard 0.8 or more): that of the smallest id."""
    return neardup.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("line dedup", line_stage), ("near-dedup", neardup_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages. Of the tables that they write, only the last one stays."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch():
            done = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(docs)
        docs = done
    return docs
