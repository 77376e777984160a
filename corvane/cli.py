"""Commands over a store: ``python -m corvane.cli COMMAND --store PATH ...``; each prints JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import build
from corvane.functions import text as T
from corvane.operators import candidates, graph, ranking, retrieval
from corvane.sources import providers
from corvane.sources.store import Store


def rows(df: DataFrame, limit: int) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


def links(store: Store) -> DataFrame:
    return store.table("edges").select("src", "dst", "edge_type")


def one(store: Store, name: str) -> DataFrame:
    """The node of a symbol's id or name; an ambiguous or unknown name is an error."""
    found = candidates.disambiguate(store.table("symbols"), [name]).first()
    if found["status"] != "resolved":
        raise SystemExit(f"{name}: {found['status']}")
    return store.spark.createDataFrame([(found["symbol_id"],)], "node string")


def described(store: Store, met: DataFrame, key: str = "neighbor") -> DataFrame:
    nodes = store.table("nodes")
    clean = met.join(nodes, F.col(key) == F.col("node_id"), "left").drop("metadata", "node_id")
    return clean.filter(~F.coalesce(graph.noise(F.col(key), F.coalesce("kind", F.lit(""))), F.lit(False)))


def named(operation: str):
    types, direction = graph.OPERATIONS[operation]

    def run(store: Store, a) -> list[dict]:
        met = graph.neighbors(links(store), one(store, a.name), types=types, direction=direction)
        return rows(described(store, met).orderBy("depth", "edge_type", "path", "qualified_name"), a.limit)

    return run


def trace(store: Store, a) -> dict:
    return {"callers": named("callers_of")(store, a), "callees": named("callees_of")(store, a)}


def adjacent(store: Store, a) -> list[dict]:
    met = graph.neighbors(links(store), one(store, a.name), types=a.types or (), direction=a.direction, depth=a.depth)
    return rows(described(store, met).orderBy("depth", "edge_type", "path", "qualified_name"), a.limit)


def between(store: Store, a) -> list[dict]:
    return rows(graph.shortest_paths(links(store), one(store, a.name), one(store, a.other), direction=a.direction, types=a.types or (), most=8), a.limit)


def defined(store: Store, a) -> list[dict]:
    low = a.name.lower()
    s = store.table("symbols")
    hit = (F.lower("qualified_name") == low) | (F.lower("name") == low) | F.lower("qualified_name").endswith("::" + low)
    return rows(s.filter(hit).select("symbol_id", "kind", "qualified_name", "path", "start_line", "end_line").orderBy("qualified_name", "symbol_id"), a.limit)


def find_file(store: Store, a) -> list[dict]:
    files = store.spark.read.parquet(f"{store.root}/inventory/files")
    return rows(ranking.cascade(files, F.col("path"), exact=a.name, prefix=a.name, part=a.name).select("path", "size", "language").orderBy("path"), a.limit)


def overview(store: Store, a) -> dict:
    at = f"{store.root}/inventory"
    read = store.spark.read.parquet
    return {"languages": rows(read(f"{at}/languages").orderBy(F.desc("files"), "language"), 50), "largest": rows(read(f"{at}/largest").orderBy(F.desc("size"), "path"), a.limit), "kinds": rows(store.table("symbols").groupBy("kind").count().orderBy("kind"), 50), "edges": rows(store.table("edges").groupBy("edge_type").count().orderBy("edge_type"), 50)}


def body(store: Store, a) -> list[dict]:
    ids = [r["node"] for r in one(store, a.name).collect()]
    return rows(store.get("bodies", "symbol_id", ids), a.limit)


def signature(store: Store, a) -> list[dict]:
    ids = [r["node"] for r in one(store, a.name).collect()]
    return rows(store.get("symbols", "symbol_id", ids).select("symbol_id", "qualified_name", "signature", "visibility", "path"), a.limit)


def context(store: Store, a) -> list[dict]:
    """What encloses a line of a file (``path:line``), the innermost first."""
    path, _, line = a.name.rpartition(":")
    held = store.table("symbols").filter((F.col("path") == path) & F.lit(int(line)).between(F.col("start_line"), F.col("end_line")))
    return rows(held.select("symbol_id", "kind", "qualified_name", "start_line", "end_line").orderBy(F.col("end_line") - F.col("start_line"), "symbol_id"), a.limit)


def below(store: Store, a) -> list[dict]:
    s = store.table("symbols").filter(T.within(F.col("path"), F.lit(a.name.rstrip("/"))))
    return rows(s.groupBy("path").agg(F.count("*").alias("symbols"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")).orderBy("path"), a.limit)


COMMANDS = {
    "find-symbol": lambda s, a: rows(s.search(a.name, a.limit, kinds=("symbol",)), a.limit),
    "search-lexical": lambda s, a: rows(s.search(a.name, a.limit, prefix=a.prefix), a.limit),
    "find-file": find_file, "where-defined": defined, "repo-overview": overview, "summarize-path": below, "get-summary": lambda s, a: rows(s.summaries(path=a.name), a.limit),
    "get-symbol-signature": signature, "get-symbol-body": body, "get-enclosing-context": context, "statement-slice": body,
    "adjacent-symbols": adjacent, "expand-subgraph": adjacent, "graph-query": adjacent, "path-between": between, "trace-calls": trace,
    **{operation.replace("_", "-"): named(operation) for operation in graph.OPERATIONS},
    "plan-query": lambda s, a: retrieval.plan(s, a.name, limit=a.limit), "prepare-context": lambda s, a: rows(retrieval.retrieve(s, a.name, limit=a.limit), a.limit),
    "prepare-answer-bundle": lambda s, a: retrieval.bundle(s, a.name, limit=a.limit), "retrieve-iterative": lambda s, a: retrieval.refine(s, a.name, retrieval.bundle(s, a.name, limit=a.limit), limit=a.limit),
    "run-benchmarks": lambda s, a: rows(retrieval.benchmark(s, providers.cases(s.spark, a.name), limit=a.limit), 10_000),
    "build-embeddings": lambda s, a: s.add_vectors(s.table("documents").select("doc_id", "content"), a.name),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corvane", description=__doc__)
    parser.add_argument("command", choices=["build-index", *COMMANDS])
    parser.add_argument("name", nargs="?", default="", help="a symbol, query, path or file, as the command has it")
    parser.add_argument("other", nargs="?", default="", help="the second symbol of path-between; the tree of build-index")
    parser.add_argument("--store", required=True)
    parser.add_argument("--limit", type=int, default=10)
    parser.add_argument("--depth", type=int, default=1)
    parser.add_argument("--direction", choices=("in", "out", "both"), default="both")
    parser.add_argument("--types", nargs="*")
    parser.add_argument("--prefix")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("corvane").getOrCreate()
    if a.command == "build-index":
        store = build.build(spark, a.other, a.store, a.name)
        out = {"repo": a.name, "symbols": store.table("symbols").count(), "edges": store.table("edges").count()}
    else:
        out = COMMANDS[a.command](Store(spark, a.store), a)
    json.dump(out, sys.stdout, default=str)
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
