"""Vector ranking, and what retrieval does with candidates: scopes, scores, gates, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import numbers as N
from corvane.functions import text as T
from corvane.operators import lexical

#: Words that tell what a query asks for, and endings that make it a path.
DOC_WORDS = ("doc", "docs", "documentation", "guide", "guides", "overview", "readme", "summary")
GRAPH_WORDS = ("callers", "caller", "callees", "callee", "references", "reference", "refs", "implements", "implementations", "imports", "neighbors", "dependency", "dependencies", "path")
BODY_WORDS = ("body", "implementation", "code", "logic", "source")
SUFFIXES = ("c", "cc", "cpp", "go", "java", "js", "json", "md", "py", "rb", "rs", "toml", "ts", "tsx", "txt", "yaml", "yml")


def bm25(docs: DataFrame, terms: Sequence[str], *, id_col: str, text_col: str) -> DataFrame:
    """``id_col, score``: BM25 of every row with any of ``terms`` in one field."""
    scored = lexical.bm25(docs, terms, id_col=id_col, fields=[text_col])
    return scored.select(F.col("doc").alias(id_col), F.round("score", 6).alias("score"))


def top(df: DataFrame, n: int, *order: Column, by: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows, of each ``by`` group if given, with their place."""
    if by:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """``limit`` rows in their order, after the first ``offset``."""
    return df.orderBy(*order).offset(offset).limit(limit)


def vector_of(vectors: DataFrame, id_col: str, vector_col: str, wanted: int) -> list[float]:
    """One row's vector, which the driver fetches; none if there is no such row. Of repeated ids, the least vector."""
    row = vectors.filter(F.col(id_col) == wanted).agg(F.min(vector_col)).first()
    return [float(x) for x in row[0]] if row[0] is not None else []


def similar(vectors: DataFrame, id_col: str, vector_col: str, asked: list[float]) -> DataFrame:
    """``vectors`` with their inner product with one vector, ``sim``: a scan, without a join."""
    v = F.array(*[F.lit(x) for x in asked]).cast("array<double>")
    return vectors.withColumn("sim", N.dot(v, F.col(vector_col)))


def best_units(scored: DataFrame, key: str, id_col: str, most: int) -> DataFrame:
    """``key, score, units, best``: of each key the best score, the number of units, and the ids of the ``most`` best.

    The best are cut in each task's part first: a key's units are never in one array.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), id_col))
    listed = scored.withColumn("place", place).filter(F.col("place") <= most).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", F.col(id_col).cast("string").alias("unit")))).alias("rows"))
    totals = scored.groupBy(key).agg(F.max("score").alias("score"), F.count("*").alias("units"))
    return totals.join(listed, key).select(key, "score", "units", F.transform("rows", lambda r: r["unit"]).alias("best"))


def cascade(df: DataFrame, path: Column, *, exact: str, prefix: str, part: str) -> DataFrame:
    """``df`` with a ``tier``: rows with the exact path; without any, those below the prefix; without any, those that hold the part."""
    tier = F.when(path == exact, 0).when(T.within(path, F.lit(prefix.rstrip("*").rstrip("/"))), 1).when(F.lower(path).contains(part.lower().replace("*", "")), 2)
    tiered = df.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    least = tiered.agg(F.min("tier")).first()[0]
    return tiered.filter(F.col("tier") == F.lit(least))


def scope_listing(docs: DataFrame, scopes: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows of ``docs`` below each of a few ``scopes`` (``prefix, score``), and ``decayed``, their score by place."""
    met = docs.join(F.broadcast(scopes), T.within(F.col("path"), F.col("prefix")))
    placed = met.withColumn("place", F.row_number().over(Window.partitionBy("prefix").orderBy(*order)) - 1).filter(F.col("place") < most)
    return placed.withColumn("decayed", F.col("score") + 12.0 - F.col("place") * 0.35)


def nearest_scope(docs: DataFrame, scopes: DataFrame, id_col: str, path_col: str) -> DataFrame:
    """``id_col, depth, scope_prefix``: the closest of the scopes (``prefix``) that hold a row's path.

    A path meets scopes by its own prefixes, so the join is by equality at any number of scopes.
    """
    path = F.col(path_col)
    parts = docs.select(id_col, path.alias("at"), F.explode(F.concat(T.path_prefixes(path), F.array(path))).alias("prefix"))
    slashes = lambda c: F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
    depth = F.when(F.col("at") == F.col("prefix"), 0).otherwise(F.greatest(slashes(F.col("at")) - slashes(F.col("prefix")), F.lit(1)))
    met = parts.join(scopes.select("prefix").distinct(), "prefix").select(id_col, depth.alias("depth"), "prefix")
    return met.groupBy(id_col).agg(F.min(F.struct("depth", "prefix")).alias("best")).select(id_col, "best.depth", F.col("best.prefix").alias("scope_prefix"))


def scopes(ranked: DataFrame, *order: Column, most: int) -> DataFrame:
    """``prefix, scope``: the first distinct prefixes of results by ``order``, least first; a file stands for its folder."""
    prefix = F.when(F.col("kind").isin("file", "doc"), T.parent(F.col("path"))).otherwise(F.col("path"))
    prefix = F.when(prefix == ".", F.col("path")).otherwise(prefix)
    place = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])
    cut = ranked.groupBy(prefix.alias("prefix")).agg(F.min(place).alias("place")).orderBy("place").limit(most)
    return cut.select("prefix", F.row_number().over(Window.orderBy("place")).alias("scope"))


def visible(kind: Column, visibility: Column) -> Column:
    """Whether a symbol is shown: no local, field or variant, and no method that is not public."""
    public = visibility.startswith("pub")
    return ~kind.isin("local", "field", "variant") & ~((kind == "method") & ~public)


def cache_score(query: str, toks: Sequence[str], *, hay: Column, name: Column, qualified: Column, path: Column, tags: Column, visibility: Column) -> Column:
    """What an entry of the compact search table scores for a query and its words."""
    low, n, q, p = query.lower(), F.lower(name), F.lower(qualified), F.lower(path)
    terms = [(qualified == query, 120.0), (name == query, 100.0), (q == low, 90.0), (n == low, 75.0), (p.contains(low) if low else F.lit(False), 30.0)]
    every = F.lit(bool(toks))
    for t in toks:
        terms += [(hay.contains(t), 8.0), ((n == t) | (q == t), 12.0), (p.contains(t), 6.0), (F.array_contains(tags, t), 6.0)]
        every = every & hay.contains(t)
    return sum((F.when(holds, gain).otherwise(0.0) for holds, gain in [*terms, (every, 20.0), (visibility.startswith("pub"), 5.0)]), F.lit(0.0))


def prerank(toks: Sequence[str], *, lexical: Column, similarity: Column, hay: Column, fields: list[Column], unit_hit: Column, path: Column, rank: Column) -> Column:
    """A unit's score before reranking."""
    asked = F.array(*map(F.lit, toks))
    boost = N.exact_boost(F.lit(" ".join(toks).lower()), fields)
    return lexical + 40.0 * similarity + 3.0 * N.overlap(asked, hay) + boost + F.when(unit_hit, 2.0).otherwise(0.0) + N.path_penalty(path, asked) - 0.002 * rank


def classify(query: Column, toks: Column) -> Column:
    """A struct of what a query asks for: ``intent`` and the explicit flags."""
    x = F.trim(query)
    low, distinct = F.lower(x), F.size(F.array_distinct(toks))
    of = lambda words: F.arrays_overlap(toks, F.array(*map(F.lit, words)))
    docs, graph, body = of(DOC_WORDS), of(GRAPH_WORDS), of(BODY_WORDS)
    stmt = of(lexical.STATEMENT_WORDS) | low.contains("@l")
    path = x.contains("/") | low.rlike(r"\.(" + "|".join(SUFFIXES) + ")$")
    sym = x.startswith("sym:") | x.contains("::") | ((distinct <= 2) & ~docs & ~path & ~stmt & ~graph)
    intent = F.when(docs | path, "docs").when(sym, "symbol").otherwise("exploration")
    flags = {"explicit_docs": docs, "explicit_graph": graph, "explicit_body": body, "explicit_statement": stmt, "explicit_path": path, "explicit_symbol": sym}
    return F.struct(intent.alias("intent"), *[c.alias(n) for n, c in flags.items()])


def gate(profile: dict[str, Column], *, exact_symbol: Column, exact_path: Column, tokens: Column, summaries: Column, selective: bool = True, few: int = 3) -> dict[str, Column]:
    """Which stages a query needs, and why: ``reason, use_global, use_graph, use_body``; the first rule that holds."""
    if not selective:
        return {"reason": F.lit("disabled"), "use_global": F.lit(True), "use_graph": F.lit(True), "use_body": F.lit(True)}
    docs, exact, stmt = profile["explicit_docs"] | exact_path, exact_symbol & (tokens <= few), profile["explicit_statement"]
    explore = profile["intent"] == "exploration"
    pick = lambda a, b, c, d: F.when(docs, a).when(exact, b).when(stmt, c).otherwise(d)
    return {
        "reason": pick(F.lit("path-or-docs"), F.lit("exact-symbol"), F.lit("statement-query"), F.when(explore, "exploration").otherwise("generic")),
        "use_global": pick(F.lit(False), F.lit(False), F.lit(True), ~summaries | profile["explicit_symbol"]),
        "use_graph": pick(F.lit(False), profile["explicit_graph"], F.lit(True), explore | profile["explicit_graph"] | exact_symbol),
        "use_body": pick(F.lit(False), profile["explicit_body"], F.lit(True), explore | profile["explicit_body"] | exact_symbol),
    }
