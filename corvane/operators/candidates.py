"""Scores of candidates, seeds that queries name, and rows of the graph that symbols, statements and references give."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import graph, lexical

#: What a token scores by its first field, priorities of kinds, and what an edge adds to a neighbour.
RERANK_FIELDS, SYMBOL_FIELDS = (16.0, 14.0, 9.0, 7.0, 6.0), (18.0, 15.0, 10.0, 8.0, 6.0)
PRIORITY = {"symbol": 6, "type_body": 5, "function_body": 4, "file": 3, "doc": 3, "directory": 2, "package": 1, "repo": 0, "statement": -2, "module_ref": -3, "symbol_ref": -3, "type_ref": -3}
EDGE_BONUS = {"SUMMARIZED_BY": 2.1, "DECLARES": 1.9, "CONTAINS": 1.6, "IMPLEMENTS": 1.5, "INHERITS": 1.4, "CALLS": 1.2, "READS": 0.9, "WRITES": 0.9, "REFERENCES": 0.8, "REFS": 0.8, "IMPORTS": 0.7}
NOMINAL, CALLABLE = ("struct", "enum", "trait", "type"), ("function", "method", "associated_function")


def _first(token: str, fields: Sequence[Column], gains: Sequence[float]) -> Column:
    out = F.lit(0.0)
    for field, gain in reversed(list(zip(fields, gains))):
        out = F.when(field.contains(token), gain).otherwise(out)
    return out


def rerank_score(
    toks: Sequence[str], *, exploratory: bool, base: Column, kind: Column, symbol_kind: Column, name: Column, qualified: Column, title: Column, preview: Column, path: Column,
    visibility: Column, activity: Column, distance: Column, containment: Column, relevance: Column, statement: bool = False, docs: bool = False,
) -> Column:
    """A candidate's score in the last ranking: where the words stand, what it is, how near the graph and scopes put it."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    fields = [low(qualified), low(name), low(title), low(preview), low(path)]
    hay, asked = F.concat_ws(" ", fields[0], fields[1], fields[4], fields[2], fields[3]), " ".join(toks).strip().lower()
    score = base
    if asked:
        for holds, gain in ((fields[0] == asked, 180.0), (fields[1] == asked, 150.0), (fields[0].endswith("::" + asked), 110.0)):
            score = score + F.when(holds, gain).otherwise(0.0)
    parts = F.array_union(T.identifier_terms(name), T.identifier_terms(F.substring_index(qualified, "::", -1)))
    hits = F.lit(0)
    for t in toks:
        score = score + _first(t, fields, RERANK_FIELDS) + F.when(F.array_contains(parts, t), 5.0).otherwise(0.0)
        hits = hits + F.when(hay.contains(t), 1).otherwise(0)
    if toks:
        score = score + F.when(hits == len(toks), 26.0).when(hits == 0, -18.0).otherwise(0.0)
    score = score + lexical.by_weight(lexical.KIND_WEIGHTS, kind) + lexical.by_weight(lexical.SYMBOL_WEIGHTS, symbol_kind) + 0.5 * lexical.by_weight({k: float(v) for k, v in PRIORITY.items()}, kind)
    score = score + F.coalesce(F.greatest(20.0 - (distance - 1) * 6.0, F.lit(2.0)), F.lit(0.0)) + F.coalesce(F.greatest(18.0 - containment * 4.0, F.lit(4.0)), F.lit(0.0))
    score = score + F.when(visibility == "pub", 8.0).when((visibility == "private") & (kind == "symbol"), -2.0).otherwise(0.0)
    shares = (0.12, 0.16, 0.34) if exploratory else (0.08, 0.1, 0.14)
    share = F.when(symbol_kind.isin(*NOMINAL), shares[0]).when(symbol_kind == "impl", shares[1]).when(symbol_kind.isin(*CALLABLE), shares[2]).otherwise(0.0)
    score = score + F.when(kind == "symbol", activity * share).otherwise(0.0) + 28.0 * F.coalesce(relevance, F.lit(0.0))
    score = score - F.when(kind.isin("module_ref", "symbol_ref", "type_ref"), 30.0).otherwise(0.0)
    if not statement:
        score = score - F.when(kind == "statement", 60.0).otherwise(0.0) - F.when(symbol_kind.isin("field", "local", "parameter", "variable"), 28.0).otherwise(0.0)
    score = score - F.when(kind.isin("function_body", "type_body") & ~symbol_kind.isin("", "trait", "struct", "enum", "type", "impl"), 6.0).otherwise(0.0)
    if not docs:
        score = score - F.when(fields[4].endswith(".md") & ~kind.isin("file", "doc"), 4.0).otherwise(0.0)
    return score


def symbol_score(
    query: str, *, name: Column, qualified: Column, container: Column, path: Column, kind: Column, visibility: Column, activity: Column, container_kind: Column | None = None,
    base: Column | None = None, locals_: Sequence[str] = ("local", "field", "parameter", "variable"),
) -> Column:
    """What a symbol scores for a query that names one: by whole names, segments and words, then by what it is."""
    asked, toks = query.strip().lower(), lexical.words(query)
    segments = [s for s in asked.split("::") if s]
    low = [F.lower(F.coalesce(c, F.lit(""))) for c in (qualified, name, container, path)]
    q, n, c, p = low
    score = base if base is not None else F.lit(0.0)
    for holds, gain in ((q == asked, 400.0), (n == asked, 250.0), ((q == asked) | q.endswith("::" + asked), 180.0), (q.contains(asked), 80.0), (c.contains(asked), 24.0), (p.contains(asked), 30.0)):
        score = score + F.when(holds & F.lit(bool(asked)), gain).otherwise(0.0)
    if len(segments) >= 2:
        run = lambda hay, parts: F.concat(F.lit("::"), hay, F.lit("::")).contains("::" + "::".join(parts) + "::")
        tail = n == segments[-1]
        score = score + F.when(tail, 35.0).otherwise(0.0) + F.when(run(q, segments), 180.0).when(run(q, segments[:-1]) & tail, 120.0).when(run(c, segments[:-1]) & tail, 100.0).when(tail, -20.0).otherwise(0.0)
    hay, hits = F.concat_ws(" ", q, n, c, p, F.lower(kind)), F.lit(0)
    for t in toks:
        score, hits = score + _first(t, [*low, hay], SYMBOL_FIELDS), hits + F.when(hay.contains(t), 1).otherwise(0)
    if toks:
        score = score + F.when(hits == len(toks), 40.0).otherwise(-8.0 * (len(toks) - hits))
    if len(toks) == 1 and len(segments) <= 1:
        if query[:1].isupper():
            score = score + F.when((name == query) & kind.isin(*NOMINAL), 180.0).when((n == asked) & kind.isin(*NOMINAL), 120.0).when(kind.isin(*CALLABLE), -110.0).otherwise(0.0) - F.when(name.rlike("^[a-z]"), 50.0).otherwise(0.0)
        score = score + activity + F.when(visibility == "pub", 18.0).otherwise(0.0) + F.when(p.rlike("^(examples|tests)/"), -80.0).when(p.startswith("metrics/"), -45.0).otherwise(0.0) + F.when(kind.isin(*CALLABLE), 10.0).otherwise(0.0)
        if container_kind is not None:
            score = score + F.when(container_kind == "trait", -60.0).when(container_kind == "impl", 14.0).otherwise(0.0)
    local = "@l" in asked or bool(set(toks) & {"local", "locals", "let"})
    return score if local else score - F.when(kind.isin(*locals_), 150.0).otherwise(0.0)


def disambiguate(symbols: DataFrame, asked: Sequence[str]) -> DataFrame:
    """``asked, status, symbol_id``: of each name the one symbol whose id or qualified name, else name, else suffix it is.

    A tier that has several symbols decides nothing; without any that has one, the name is ambiguous.
    """
    q = symbols.sparkSession.createDataFrame([(a, a.lower()) for a in asked], "asked string, low string")
    low = F.lower("qualified_name")
    parts = F.split(low, "::")
    # each symbol meets queries by equality of one of its keys
    keys = F.array(F.struct(F.lit(0).alias("tier"), F.col("symbol_id").alias("key")), F.struct(F.lit(0).alias("tier"), low.alias("key")), F.struct(F.lit(1).alias("tier"), F.lower("name").alias("key")))
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.lit(2).alias("tier"), F.array_join(F.slice(parts, k, F.size(parts)), "::").alias("key")))
    met = symbols.select("symbol_id", F.inline(F.concat(keys, ends))).join(F.broadcast(q), F.col("key") == F.col("low")).groupBy("asked", "symbol_id").agg(F.min("tier").alias("tier"))
    tiers = met.groupBy("asked", "tier").agg(F.count("*").alias("n"), F.min("symbol_id").alias("one"))
    best = tiers.groupBy("asked").agg(F.min(F.when(F.col("n") == 1, F.struct("tier", "one"))).alias("best"))
    status = F.when(F.col("best").isNotNull(), "resolved").when(F.col("found").isNotNull(), "ambiguous").otherwise("missing")
    return q.join(best.withColumn("found", F.lit(True)), "asked", "left").select("asked", status.alias("status"), F.col("best.one").alias("symbol_id"))


def expand(links: DataFrame, seeds: DataFrame, *, base: float, depth: int = 1, direction: str = "both") -> DataFrame:
    """``neighbor, score``: what the graph has around seeds, by edge and distance; the best of several ways."""
    met = graph.neighbors(links, seeds, direction=direction, depth=depth)
    bonus = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in EDGE_BONUS.items() for x in pair]), F.col("edge_type")), F.lit(0.5))
    return met.groupBy("neighbor").agg(F.max(base + bonus - 0.35 * (F.col("depth") - 1)).alias("score"))


def field_edges(rows: DataFrame, source: Column, fields: dict[str, Column], most: int = 50) -> DataFrame:
    """An edge of each type to each of at most ``most`` targets of its field (an array; null for none)."""
    typed = [F.transform(F.slice(F.coalesce(targets, F.array().cast("array<string>")), 1, most), (lambda name: lambda t: F.struct(t.alias("dst"), F.lit(name).alias("edge_type")))(name)) for name, targets in fields.items()]
    return rows.select(source.alias("src"), F.inline(F.concat(*typed))).toDF("src", "dst", "edge_type")


def reference_edges(refs: DataFrame) -> DataFrame:
    """CALLS of calls, USES of all else, USES_TYPE of uses besides, and TESTS where the reference stands in a test."""
    types = F.array(F.when(F.col("kind") == "call", "CALLS").otherwise("USES"), F.when(F.col("kind") == "use", "USES_TYPE"), F.when(F.col("test"), "TESTS"))
    return refs.select("src", "dst", F.explode(F.filter(types, lambda t: t.isNotNull())).alias("edge_type"))


def nesting(rows: DataFrame, *, by: Sequence[str], order: Sequence[str], step: str) -> DataFrame:
    """``rows`` with ``depth``: how many blocks are open after each, where a closing one without an opening counts nothing."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("run", F.sum(step).over(w))
    return run.withColumn("depth", F.col("run") - F.least(F.min("run").over(w), F.lit(0))).drop("run")


def nodes(symbols: DataFrame, repo: str) -> DataFrame:
    """``node_id, kind, name`` of a repository, its folders, packages, files, symbols and tests; of one id, one row."""
    spark = symbols.sparkSession
    named = lambda prefix, kind, c: symbols.select(F.concat(F.lit(prefix + ":"), F.col(c)).alias("node_id"), F.lit(kind).alias("kind"), F.col(c).alias("name")).distinct()
    up = symbols.select(F.explode(T.path_prefixes(F.col("path"))).alias("name")).distinct()
    parts = [
        spark.createDataFrame([(f"repo:{repo}", "repo", repo)], "node_id string, kind string, name string"),
        up.select(F.concat(F.lit("dir:"), "name").alias("node_id"), F.lit("directory").alias("kind"), "name"),
        named("pkg", "package", "package"), named("file", "file", "path"), symbols.select(F.col("symbol_id").alias("node_id"), "kind", "name"),
        symbols.filter(F.col("path").startswith("tests/")).select(F.concat(F.lit("test:"), "symbol_id").alias("node_id"), F.lit("test").alias("kind"), "name"),
    ]
    return reduce(DataFrame.unionAll, parts)


def merge_providers(rows: DataFrame) -> DataFrame:
    """One symbol of each qualified name: the first provider's, with the span that holds all of theirs."""
    first = F.min_by("symbol_id", F.struct("provider", "symbol_id"))
    return rows.groupBy("qualified_name").agg(first.alias("symbol_id"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.countDistinct("provider").alias("providers"))
