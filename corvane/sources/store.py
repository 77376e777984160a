"""Tables of a code base on disk: symbols, bodies, indexes, graph, search documents, vectors and build state.

Each table is Parquet below one folder. What is replaced is written beside its predecessor and put in its place, so a
reader never sees half of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import lexical, units


def _move(spark: SparkSession, source: str, target: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = b.getFileSystem(conf)
    fs.mkdirs(b.getParent())
    fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"could not put {target} in its place")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def replace(df: DataFrame, target: str, *, by: Sequence[str] = ()) -> None:
    """Write a table, which may be derived from the one it replaces. ``by`` sorts files, for lookups that skip them."""
    beside = f"{target}.{uuid.uuid4().hex}"
    (df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df).write.parquet(beside)
    _move(df.sparkSession, beside, target)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        return exists(self.spark, f"{self.root}/{name}")

    # --- symbols, bodies and their indexes
    def write_bundle(self, symbols: DataFrame, statements: DataFrame, summaries: DataFrame | None = None) -> None:
        """Symbols, their bodies (ordered statements) and indexes by name; keys are in order, so lookups skip files."""
        replace(symbols, f"{self.root}/symbols", by=["symbol_id"])
        rows = F.sort_array(F.collect_list(F.struct("ord", "text")))
        bodies = statements.groupBy("symbol_id").agg(F.transform(rows, lambda r: r["text"]).alias("statements"))
        replace(bodies, f"{self.root}/bodies", by=["symbol_id"])
        for key in ("qualified_name", "name"):
            replace(symbols.select(key, "symbol_id").distinct(), f"{self.root}/by_{key}", by=[key, "symbol_id"])
        if summaries is not None:
            replace(summaries, f"{self.root}/summaries", by=["summary_id"])

    def get(self, name: str, key: str, values: Sequence[str]) -> DataFrame:
        """Rows of some keys; the filter is one that Parquet's statistics answer. Missing keys have no row."""
        return self.table(name).filter(F.col(key).isin(*values))

    def resolve(self, key: str, value: str) -> DataFrame:
        """The ids that a name stands for, in order."""
        return self.table(f"by_{key}").filter(F.col(key) == value).select("symbol_id").orderBy("symbol_id")

    def with_prefix(self, name: str, key: str, prefix: str, limit: int) -> DataFrame:
        return self.table(name).filter(F.col(key).startswith(prefix)).orderBy(key).limit(limit)

    def summaries(self, *, summary_id: str | None = None, path: str | None = None, symbol_id: str | None = None) -> DataFrame:
        found = self.table("summaries")
        for key, value in (("summary_id", summary_id), ("path", path), ("symbol_id", symbol_id)):
            if value is not None:
                found = found.filter(F.col(key) == value)
        return found

    # --- values by key: metadata of artifacts, evaluation cases, state of builds
    def put(self, name: str, rows: DataFrame, key: str) -> None:
        """Upsert: rows replace those of the same key. Of rows that share one, the least stays."""
        new = rows.groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("r")).select(key, "r.*")
        if self.has(name):
            old = self.table(name)
            new = new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)
        replace(new, f"{self.root}/{name}")

    def put_case(self, case: str, fingerprint: str, payload: str) -> None:
        rows = [(f"case:{case}:{fingerprint}", payload), (f"latest:{case}", payload)]
        self.put("cases", self.spark.createDataFrame(rows, "key string, payload string"), "key")

    def get_case(self, case: str, fingerprint: str) -> str | None:
        """The payload of exactly this fingerprint; another one's is stale and is not given."""
        found = self.table("cases").filter(F.col("key") == f"case:{case}:{fingerprint}").first() if self.has("cases") else None
        return found["payload"] if found else None

    def mark(self, repo: str, status: str) -> None:
        """Set a repository's state; every start counts as an attempt."""
        before = self.table("builds").filter(F.col("repo") == repo).first() if self.has("builds") else None
        tried = (before["attempts"] if before else 0) + (status == "running")
        self.put("builds", self.spark.createDataFrame([(repo, status, tried)], "repo string, status string, attempts long"), "repo")

    def pending(self, repos: DataFrame) -> DataFrame:
        """The repositories that are not completed."""
        if not self.has("builds"):
            return repos
        return repos.join(self.table("builds").filter("status = 'completed'").select("repo"), "repo", "left_anti")

    # --- graph
    def write_graph(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Nodes by id and edges by type and id; columns beside the known ones become JSON. Of one id, the least row."""
        for rows, key, known, name in ((nodes, "node_id", ("node_id", "kind", "name", "qualified_name", "path"), "nodes"), (edges, "edge_id", ("edge_id", "edge_type", "src", "dst"), "edges")):
            rest = sorted(c for c in rows.columns if c not in known)
            flat = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in known], (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("metadata"))
            one = flat.groupBy(key).agg(F.min(F.struct(*[c for c in flat.columns if c != key])).alias("r")).select(key, "r.*")
            beside = f"{self.root}/{name}.{uuid.uuid4().hex}"
            writer = one.write.partitionBy("edge_type") if name == "edges" else one.write
            writer.parquet(beside)
            _move(self.spark, beside, f"{self.root}/{name}")

    def edge_types(self) -> DataFrame:
        return self.table("edges").select("edge_type").distinct()

    # --- search documents and vectors
    def write_search(self, docs: DataFrame, fields: Sequence[str] = ("searchable", "title", "path", "name", "qualified_name")) -> None:
        """Documents, postings and the fields' statistics. What is searchable is all of a document's texts together."""
        whole = docs.withColumn("searchable", F.concat_ws(" ", "kind", "path", "name", "qualified_name", "title", "content"))
        replace(whole, f"{self.root}/documents", by=["doc_id"])
        back = self.table("documents")
        replace(lexical.index(back, "doc_id", fields), f"{self.root}/postings", by=["term"])
        sizes = back.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(T.tokens(F.col(f))).alias("len")) for f in fields])).alias("s")).select("s.*")
        replace(sizes.groupBy("field").agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("mean")), f"{self.root}/fields")

    def search(self, query: str, limit: int, *, kinds: Sequence[str] = (), prefix: str | None = None) -> DataFrame:
        """The best documents by BM25, of some kinds and below a path; all documents for a query without words.

        Only the postings of the query's words are read. The kind and path are asked before the best are cut off.
        """
        docs = self.table("documents")
        if kinds:
            docs = docs.filter(F.col("kind").isin(*kinds))
        if prefix:
            docs = docs.filter(T.within(F.col("path"), F.lit(prefix.rstrip("/"))))
        words = sorted(set(lexical.words(query)))
        if not words:
            return docs.withColumn("score", F.lit(1.0)).orderBy("doc_id").limit(limit)
        held = self.table("postings").filter(F.col("term").isin(*words))
        scored = lexical.weights(held, self.table("fields")).groupBy("doc").agg(F.sum("weight").alias("score"))
        return docs.join(scored, F.col("doc_id") == F.col("doc")).drop("doc").orderBy(F.desc("score"), "path", "doc_id").limit(limit)

    def page(self, offset: int, limit: int) -> tuple[DataFrame, int, int | None]:
        """A page of documents by id, their number, and the next page's offset if there is one."""
        total = self.table("documents").count()
        return self.table("documents").orderBy("doc_id").offset(offset).limit(limit), total, offset + limit if offset + limit < total else None

    def add_vectors(self, docs: DataFrame, model: str) -> int:
        """Vectors of the documents that have none by this model yet; those that an earlier run has written stay."""
        if self.has("vectors"):
            done = self.table("vectors").filter(F.col("model") == model).select("doc_id")
            docs = docs.join(done, "doc_id", "left_anti")
        made = units.hashed_vectors(docs, "doc_id", "content").withColumn("model", F.lit(model))
        made.write.mode("append").parquet(f"{self.root}/vectors")
        return made.count()
