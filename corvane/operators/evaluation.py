"""Measures of ranked results and of answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import numbers as N

#: The ranks at which recall is measured.
RANKS = (1, 3, 5, 10)


def measures(runs: DataFrame, wanted: DataFrame, *, case: str, item: str, most: int) -> DataFrame:
    """Of each case: recall at ranks, the first rank of a wanted item, its reciprocal, and binary NDCG.

    ``runs`` has each case's items with their ``rank``; ``wanted`` has the items that count. A wanted item that is
    listed twice counts once, at its first rank. Cases without a wanted item are left out.
    """
    expected = wanted.select(case, item).distinct().groupBy(case).agg(F.count("*").cast("double").alias("expected"))
    listed = runs.filter(F.col("rank") <= most).groupBy(case, item).agg(F.min("rank").alias("rank"))
    hits = listed.join(wanted.select(case, item).distinct().withColumn("rel", F.lit(1)), [case, item], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    recalls = [F.round(F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)) / F.first("expected"), 3).alias(f"recall_at_{k}") for k in RANKS if k <= most]
    first, gain = F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.sum(F.col("rel") / F.log2(F.col("rank") + 1))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("expected").cast("int"), F.col("n").cast("int")), F.lit(1))), F.lit(0.0), lambda s, k: s + 1 / F.log2(k + 1))
    per = hits.join(expected, case).groupBy(case).agg(*recalls, first.alias("first_rank"), gain.alias("gain"), F.first("expected").alias("expected"), F.count("*").alias("n"))
    kept = [f"recall_at_{k}" for k in RANKS if k <= most]
    return per.select(case, *kept, "first_rank", F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 3).alias("mrr"), F.round(F.col("gain") / ideal, 3).alias("ndcg"))


def coverage(text: Column, terms: Sequence[str]) -> Column:
    """The share of terms that a text holds."""
    return N.overlap(F.array(*map(F.lit, terms)), text) / F.lit(float(len(terms)))


def _weighed(*parts: tuple[float, Column]) -> Column:
    return F.round(sum((w * c.cast("double") for w, c in parts), F.lit(0.0)), 3)


def answer_quality(path: Column, name: Column, terms: Column, top: Column) -> Column:
    return _weighed((0.35, path), (0.35, name), (0.2, terms), (0.1, top))


def bundle_score(path: Column, name: Column, terms: Column, provenance: Column, graph: Column, statement: Column) -> Column:
    return _weighed((0.3, path), (0.2, name), (0.2, terms), (0.1, provenance), (0.1, graph), (0.1, statement))


def external_score(path: Column, name: Column, symbol: Column, terms: Column) -> Column:
    return _weighed((0.35, path), (0.25, name), (0.2, symbol), (0.2, terms))


def prepared(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, prepared_tokens``: the words of all texts of a key, divided at white space."""
    return rows.groupBy(key).agg(F.sum(F.size(F.split(F.trim(text), r"\s+"))).alias("prepared_tokens"))


def normalised_cases(raw: DataFrame) -> DataFrame:
    """Cases with a query, trimmed, a name of their own and whether anything is expected of them."""
    query, expected = F.trim("query"), F.coalesce("expected_path", F.lit(""))
    return raw.filter(query != "").withColumns({
        "query": query, "name": F.concat(F.lit("case-"), F.col("item_id").cast("string")), "scored": expected != "", "expected_path": F.when(expected == "", "-").otherwise(expected),
    })
