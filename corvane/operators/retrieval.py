"""Staged retrieval over a store: summaries, scopes, symbols, the graph around them, bodies, and one ranking of it all.

What decides about later stages (what a query asks for, the first few scopes and seeds) is a handful of rows, which the
driver fetches; everything that is searched or ranked stays distributed until the last limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import candidates, evaluation, lexical, ranking
from corvane.sources.store import Store

#: Kinds that stages search, and how many of what they go on with.
SUMMARY_KINDS, BODY_KINDS = ("repo", "package", "directory", "file", "doc"), ("function_body", "type_body")
SCOPES, SEEDS, BODIES, FANOUT = 3, 4, 3, 32
RECIPES = {"docs": ("summary_rollups", "symbol_localization", "answer_bundle")}
WHOLE_RECIPE = ("summary_rollups", "symbol_localization", "graph_neighbors", "body_hydration", "answer_bundle")
SEED_TYPES = {"docs": ("summary", "file", "doc"), "symbol": ("summary", "symbol", "body"), "exploration": ("summary", "symbol", "graph")}
EDGE_TYPES = {"symbol": ("CALLS", "READS", "WRITES", "REFS", "USES"), "docs": ("CONTAINS", "IMPORTS"), "exploration": ("CALLS", "IMPORTS", "IMPLEMENTS", "USES", "CONTAINS")}
FIELDS = ("doc_id", "kind", "path", "name", "qualified_name", "symbol_id", "title")


def profile(store: Store, query: str) -> dict:
    """What a query asks for."""
    one = store.spark.range(1).select(F.lit(query).alias("q"))
    return one.select(ranking.classify(F.col("q"), T.tokens(F.col("q"))).alias("p")).first()["p"].asDict()


def _gate(store: Store, asked: dict, **known) -> dict:
    selective = known.pop("selective")
    made = ranking.gate({k: F.lit(v) for k, v in asked.items()}, **{k: F.lit(v) for k, v in known.items()}, selective=selective)
    return store.spark.range(1).select(*[c.alias(k) for k, c in made.items()]).first().asDict()


def _stage(rows: DataFrame, number: int, reason: str, score) -> DataFrame:
    return rows.select(*FIELDS, score.cast("double").alias("score"), F.lit(number).alias("stage"), F.lit(reason).alias("reason"))


def retrieve(store: Store, query: str, *, limit: int = 10, depth: int = 1, graph: bool = True, selective: bool = True) -> DataFrame:
    """The best candidates with their reasons and scores. The store has documents, postings and, for the graph, edges."""
    words, asked, docs = lexical.words(query), profile(store, query), store.table("documents")
    low = query.strip().lower()
    # 1: summaries and the few scopes that they point to
    summaries = store.search(query, 3 * limit, kinds=SUMMARY_KINDS)
    first = summaries.select("path", "kind", "score").limit(3 * limit).collect()
    scopes: list[tuple[str, float]] = []
    for r in first:
        prefix = r["path"] or ""
        if r["kind"] in ("file", "doc") and prefix.lower() != low and "/" in prefix:
            prefix = prefix.rsplit("/", 1)[0]
        if prefix and prefix not in (s for s, _ in scopes) and len(scopes) < SCOPES:
            scopes.append((prefix, r["score"]))
    stages = [_stage(summaries, 0, "summary", F.col("score"))]
    # 2: symbols that are the query
    qualified = F.lower(F.coalesce("qualified_name", F.lit("")))
    exact = docs.filter((F.col("kind") == "symbol") & ((F.lower("name") == low) | (qualified == low) | qualified.endswith("::" + low))).orderBy("symbol_id").limit(2 * SEEDS)
    held = [r["symbol_id"] for r in exact.select("symbol_id").collect()]
    order = {s: 420.0 - 20.0 * k for k, s in enumerate(held)}
    gate = _gate(store, asked, exact_symbol=bool(held), exact_path=any((r["path"] or "").lower() == low for r in first[:3]), tokens=len(words), summaries=bool(first), selective=selective)
    if order:
        score = F.try_element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("symbol_id"))
        stages.append(_stage(exact, 1, "exact", score))
    # 3: symbols by words, everywhere or below the scopes, and what a scope lists
    if gate["use_global"]:
        stages.append(_stage(store.search(query, 4 * limit, kinds=("symbol",)), 2, "lexical", F.col("score")))
    if scopes:
        stages += [_stage(store.search(query, 4 * limit, kinds=("symbol",), prefix=prefix), 3, "scope", F.col("score")) for prefix, _ in scopes]
        listed = ranking.scope_listing(docs.filter("kind = 'symbol'"), store.spark.createDataFrame(scopes, "prefix string, score double"), max(limit, 12), F.col("path"), F.col("qualified_name"), F.col("doc_id"))
        stages.append(_stage(listed.withColumn("score", F.col("decayed")), 4, "scope", F.col("score")))
    found = reduce(DataFrame.unionAll, stages)
    best = found.filter("kind = 'symbol'").groupBy("symbol_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "symbol_id").limit(SEEDS).collect()
    seeds = [r["symbol_id"] for r in best if r["symbol_id"]]
    # 4: what the graph has around the best of them, and their bodies
    if graph and gate["use_graph"] and seeds and store.has("edges"):
        near = candidates.expand(store.table("edges").select("src", "dst", "edge_type"), store.spark.createDataFrame([(s,) for s in seeds], "node string"), base=best[0]["score"], depth=depth)
        near = near.orderBy(F.desc("score"), "neighbor").limit(FANOUT)
        stages.append(_stage(docs.join(near, F.col("symbol_id") == F.col("neighbor")), 5, "graph", F.col("score")))
    if gate["use_body"] and seeds:
        score = F.lit(float(best[0]["score"]) - 1.0)
        stages.append(_stage(docs.filter(F.col("kind").isin(*BODY_KINDS) & F.col("symbol_id").isin(*seeds[:BODIES])), 6, "body", score))
    # 5: one row of each candidate, ranked
    every = reduce(DataFrame.unionAll, stages).withColumn("identity", F.coalesce("symbol_id", "path", "doc_id"))
    merged = lexical.merge_candidates(every)
    one = every.groupBy("kind", "identity").agg(F.min(F.struct(*FIELDS)).alias("d")).select("kind", "identity", "d.doc_id", "d.path", "d.name", "d.qualified_name", "d.symbol_id")
    both = merged.join(one, ["kind", "identity"])
    nearest = F.array_max(F.transform(F.array(*[F.struct(T.within(F.col("path"), F.lit(p)).alias("in"), F.lit(p).alias("p")) for p, _ in scopes]), lambda s: F.when(s["in"], F.length(s["p"])))) if scopes else F.lit(None).cast("int")
    depth_in = F.when(nearest.isNotNull(), F.size(F.split("path", "/")) - F.size(F.split(F.left("path", nearest), "/")))
    final = candidates.rerank_score(
        words, exploratory=asked["intent"] == "exploration", base=F.col("score"), kind=F.col("kind"), symbol_kind=F.lit(""), name=F.col("name"), qualified=F.col("qualified_name"), title=F.col("title"), preview=F.lit(""), path=F.col("path"),
        visibility=F.lit(""), activity=F.lit(0.0), distance=F.lit(None).cast("double"), containment=depth_in, relevance=F.lit(0.0), statement=asked["explicit_statement"], docs=asked["explicit_docs"],
    )
    ranked = both.withColumn("score", F.round(final, 6))
    return ranked.orderBy(F.desc("score"), F.coalesce("path", F.lit("")), F.coalesce("qualified_name", "title", F.lit("")), "identity").limit(limit).select("kind", "identity", "doc_id", "path", "name", "qualified_name", "symbol_id", "title", "score", "reasons")


def plan(store: Store, task: str, *, limit: int = 8) -> dict:
    """How a task would be answered: what it asks for, the stages, what they start from and when they stop."""
    asked = profile(store, task)
    intent = asked["intent"]
    stop = {"max_selected_context": limit, "stop_on_exact_symbol_hit": intent == "symbol", "stop_on_path_hit": intent == "docs", "max_graph_expansions": 16 if intent == "symbol" else 32}
    return {"task": task, "profile": asked, "recipe": RECIPES.get(intent, WHOLE_RECIPE), "seed_types": SEED_TYPES[intent], "edge_types": EDGE_TYPES[intent], "stopping": stop}


def bundle(store: Store, task: str, *, limit: int = 8, hints: Sequence[str] = ()) -> dict:
    """What an answer needs: the context, neighbours and statements of its first symbols, and evidence without repeats."""
    whole = " ".join([task, *(h.strip() for h in hints if h.strip())])
    context = [r.asDict() for r in retrieve(store, whole, limit=limit).collect()]
    for c in context:
        c["explanation"] = f"Included because of {', '.join(c['reasons'])}." if c["reasons"] else "Included as a high-ranking retrieval candidate."
    top = [c for c in context if c["symbol_id"]][:3]
    ids, around, bodies = [c["symbol_id"] for c in top], [], []
    if ids and store.has("edges"):
        types = EDGE_TYPES[profile(store, whole)["intent"]]
        near = store.table("edges").filter(F.col("edge_type").isin(*types) & (F.col("src").isin(*ids) | F.col("dst").isin(*ids)))
        around = [r.asDict() for r in near.select("src", "dst", "edge_type").distinct().orderBy("edge_type", "src", "dst").limit(8 * len(ids)).collect()]
    if ids and store.has("bodies"):
        bodies = [r.asDict() for r in store.get("bodies", "symbol_id", ids).select("symbol_id", F.slice("statements", 1, 8).alias("statements")).orderBy("symbol_id").collect()]
    evidence = list({(c["path"], c["symbol_id"], c["qualified_name"], c["kind"]): {k: c[k] for k in ("path", "symbol_id", "qualified_name", "kind")} for c in context}.values())
    return {"task": task, "plan": plan(store, whole, limit=limit), "context": context, "neighbours": around, "slices": bodies, "evidence": evidence, "top_symbols": top, "summary": {"selected_context": len(context), "graph_neighborhoods": len(around), "statement_slices": len(bodies), "evidence_items": len(evidence)}}


def hints_of(prior: dict | None) -> list[str]:
    """The names of an earlier bundle's first two symbols, each once."""
    named = [c.get("qualified_name") or c.get("name") for c in (prior or {}).get("top_symbols", [])[:2]]
    return list(dict.fromkeys(n for n in named if n))


def refine(store: Store, task: str, prior: dict | None = None, *, limit: int = 8) -> dict:
    """A bundle for the task and what an earlier one found first."""
    return bundle(store, task, limit=limit, hints=hints_of(prior))


def benchmark(store: Store, cases: DataFrame, *, limit: int = 10, modes: Sequence[str] = ("lexical", "staged")) -> DataFrame:
    """``case_id, mode`` and the measures of each case and mode; cases (``name, query, expected_paths, expected_symbols``) are few."""
    runs = []
    for c in cases.select("name", "query").collect():
        for mode in modes:
            found = retrieve(store, c["query"], limit=limit) if mode == "staged" else store.search(c["query"], limit)
            rows = [(f"{c['name']}\t{mode}", k, r["path"], r["symbol_id"], r["qualified_name"]) for k, r in enumerate(found.select("path", "symbol_id", "qualified_name").collect(), 1)]
            runs += [(case, k, unit) for case, k, path, *names in rows for unit in (f"path:{path}", *(f"symbol:{n.lower()}" for n in names if n))]
    table = store.spark.createDataFrame(runs, "case_id string, rank int, unit string")
    wanted = cases.select("name", F.explode(F.concat(F.transform("expected_paths", lambda p: F.concat(F.lit("path:"), p)), F.transform("expected_symbols", lambda s: F.concat(F.lit("symbol:"), F.lower(s))))).alias("unit"))
    wanted = reduce(DataFrame.unionAll, [wanted.select(F.concat(F.col("name"), F.lit("\t" + m)).alias("case_id"), "unit") for m in modes])
    got = evaluation.measures(table, wanted, case="case_id", item="unit", most=limit)
    return got.withColumns({"mode": F.substring_index("case_id", "\t", -1), "case_id": F.substring_index("case_id", "\t", 1)})
