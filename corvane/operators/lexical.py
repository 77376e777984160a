"""A lexical index over several fields, BM25 on it, query variants and feature ranking."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.tables import spread

#: Weights of kinds and of kinds of symbols, the order of kinds, and what a token scores by its first field.
KIND_WEIGHTS = {"symbol": 30.0, "type_body": 16.0, "function_body": 12.0, "file": 8.0, "doc": 8.0, "directory": 2.0, "package": 1.0, "statement": -35.0, "module_ref": -25.0, "symbol_ref": -25.0, "type_ref": -25.0}
SYMBOL_WEIGHTS = {
    "trait": 24.0, "struct": 22.0, "enum": 20.0, "type": 18.0, "impl": 14.0, "module": 9.0, "associated_function": 7.0, "method": 6.0,
    "function": 5.0, "const": -8.0, "static": -8.0, "field": -18.0, "local": -24.0, "parameter": -20.0, "variable": -20.0,
}
KIND_ORDER = ("symbol", "type_body", "function_body", "file", "directory", "package", "doc")
FIELD_SCORES = (16.0, 14.0, 10.0, 8.0, 7.0, 4.0)
STATEMENT_WORDS = ("statement", "statements", "line", "lines", "expr", "let", "local", "locals")
K1, B = 1.2, 0.75


def words(query: str) -> list[str]:
    """``tokens`` of a query text."""
    plain = re.sub(r"[^\w\s]", "", re.sub(r"::|[/\-.]", " ", query.lower()))
    return plain.split()


def variants(query: str, sizes: Sequence[int] = (2, 3), least: int = 3) -> list[list[str]]:
    """The query's words and, of three words or more, each run of two and of three; distinct."""
    base = words(query)
    runs = [base[k : k + n] for n in sizes if len(base) >= max(least, n) for k in range(len(base) - n + 1)]
    return [list(v) for v in dict.fromkeys(tuple(r) for r in [base, *runs] if r)]


def index(docs: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """Postings ``doc, field, term, tf, len``, to be written as a table; a row's words are counted within the row."""
    sorted_ = docs.select(F.col(id_col).alias("doc"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.array_sort(T.tokens(F.col(f))).alias("t")) for f in fields])).alias("f"))
    counted = sorted_.select("doc", "f.field", F.size("f.t").alias("len"), F.explode(F.col("f.t")).alias("term"))
    return counted.groupBy("doc", "field", "len", "term").agg(F.count("*").alias("tf"))


def matches(docs: DataFrame, id_col: str, fields: Sequence[str], terms: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The postings of ``terms`` alone, and of each field the number of rows and their mean length."""
    toks = spread(docs.select(id_col, *fields)).select(F.col(id_col).alias("doc"), *[T.tokens(F.col(f)).alias(f"t_{k}") for k, f in enumerate(fields)])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(f"t_{k}").alias("len"), F.col(f"t_{k}").alias("words")) for k, f in enumerate(fields)]))
    rows = toks.select("doc", each.alias("f")).select("doc", "f.field", "f.len", "f.words")
    stats = rows.groupBy("field").agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("mean"))
    tf = rows.select("doc", "field", "len", F.explode("words").alias("term")).filter(F.col("term").isin(*terms)).groupBy("doc", "field", "len", "term").agg(F.count("*").cast("double").alias("tf"))
    return tf, stats


def weights(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """``doc, field, term, weight``: BM25 of each posting. ``stats`` has a row for each field, of which there are few."""
    df = postings.groupBy("field", "term").agg(F.count("*").cast("double").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    # df has a row for each query term and field: bounded by the query
    return postings.join(df.join(stats, "field"), ["field", "term"]).select("doc", "field", "term", (idf * share).alias("weight"))


def bm25(docs: DataFrame, terms: Sequence[str], *, id_col: str, fields: Sequence[str]) -> DataFrame:
    """``doc, score`` of every row that holds any of the terms in any field."""
    return weights(*matches(docs, id_col, fields, terms)).groupBy("doc").agg(F.sum("weight").alias("score"))


def variant_search(docs: DataFrame, query: str, *, id_col: str, fields: Sequence[str], limit: int) -> DataFrame:
    """``doc, score, variant_hits``: the best score over the query's variants, of those that rank it high enough."""
    asked = variants(query)
    weighted = weights(*matches(docs, id_col, fields, sorted({t for v in asked for t in v})))
    listed = docs.sparkSession.createDataFrame([(k, t) for k, v in enumerate(asked) for t in v], "variant int, term string")
    scored = weighted.join(F.broadcast(listed), "term").groupBy("variant", "doc").agg(F.sum("weight").alias("score"))
    place = F.row_number().over(Window.partitionBy("variant").orderBy(F.desc(F.round("score", 9)), "doc"))
    kept = scored.withColumn("place", place).filter(F.col("place") <= max(12 * limit, 120))
    return kept.groupBy("doc").agg(F.max("score").alias("score"), F.count("*").alias("variant_hits"))


def by_weight(table: dict[str, float], value: Column) -> Column:
    listed = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(listed, value), F.lit(0.0))


def kind_rank(kind: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.coalesce(kind, F.lit("")))
    return F.when(place > 0, place.cast("int") - 1).otherwise(99)


def feature_score(
    query: str, *, native: Column, kind: Column, symbol_kind: Column, name: Column, qualified: Column, title: Column, preview: Column, path: Column,
    searchable: Column, visibility: Column, activity: Column, variant_hits: Column,
) -> Column:
    """What a candidate scores by where the query and its words stand in it, by its kind and by its activity."""
    asked, toks = query.strip().lower(), words(query)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    fields = [low(qualified), low(name), low(title), low(preview), low(path)]
    hay = F.concat_ws(" ", *fields, low(searchable))
    score = native
    if asked:
        whole = [(fields[0] == asked, 180.0), (fields[1] == asked, 150.0), (fields[0].endswith("::" + asked), 110.0)]
        part = [(fields[2].contains(asked), 18.0), (fields[3].contains(asked), 12.0), (fields[4].contains(asked), 16.0)]
        for holds, gain in whole + part:
            score = score + F.when(holds, gain).otherwise(0.0)
    hits = F.lit(0)
    for t in toks:
        first = F.lit(0.0)
        for field, gain in reversed(list(zip([*fields, hay], FIELD_SCORES))):
            first = F.when(field.contains(t), gain).otherwise(first)
        score, hits = score + first, hits + F.when(hay.contains(t), 1).otherwise(0)
    if toks:
        score = score + F.when(hits == len(toks), 24.0).when(hits == 0, -18.0).otherwise(0.0)
    statement = "@l" in asked or bool(set(toks) & set(STATEMENT_WORDS))
    score = score + by_weight(KIND_WEIGHTS, kind) + by_weight(SYMBOL_WEIGHTS, symbol_kind) + F.when(visibility == "pub", 8.0).otherwise(0.0)
    share = F.when(symbol_kind.isin("struct", "enum", "trait", "type"), 0.08).when(symbol_kind == "impl", 0.1).when(symbol_kind.isin("function", "method", "associated_function"), 0.14).otherwise(0.0)
    score = score + F.when(kind == "symbol", activity * share).otherwise(0.0) + F.least(F.greatest(variant_hits - 1, F.lit(0)), F.lit(3)) * 4.0
    if not statement:
        score = score + F.when(kind == "statement", -70.0).otherwise(0.0) + F.when(symbol_kind.isin("field", "local", "parameter", "variable"), -30.0).otherwise(0.0)
    return score + F.when(kind.isin("module_ref", "symbol_ref", "type_ref"), -30.0).otherwise(0.0)


def merge_candidates(stages: DataFrame) -> DataFrame:
    """``kind, identity, score, reasons, title``: one row of each kind and identity of ``stages``.

    Of each it has the highest score, all reasons in the order of stages, and the first title that is there.
    """
    rows = F.array_sort(F.collect_list(F.struct("stage", "reason", "title")))
    merged = stages.groupBy("kind", "identity").agg(F.max("score").alias("score"), rows.alias("rows"))
    titles = F.filter(F.transform("rows", lambda r: r["title"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return merged.select("kind", "identity", "score", F.array_distinct(F.transform("rows", lambda r: r["reason"])).alias("reasons"), F.get(titles, 0).alias("title"))


