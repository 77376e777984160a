"""Readers of what other tools write, one JSON object a line, as tables of symbols, references and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import numbers as N

TAG = "_type string, name string, path string, input string, language string, kind string, kindName string, scope string, scopeKind string, line long, end long, pattern string"
RELATION = "struct<symbol:string,is_implementation:boolean,is_reference:boolean,is_type_definition:boolean,is_definition:boolean>"
SCIP = f"documents array<struct<relative_path:string,language:string,occurrences:array<struct<symbol:string,symbol_roles:int,`range`:array<int>,enclosing_range:array<int>>>,symbols:array<struct<symbol:string,kind:string,display_name:string,relationships:array<{RELATION}>>>>>"
MATCH = "FileName string, Repository string, Language string, Score double, LineMatches array<struct<LineNumber:long,Line:string,Score:double,FileName:boolean>>"
CASE = "name string, repo string, query string, task_type string, expected_path string, expected_paths array<string>, expected_name string, expected_symbol string, expected_symbols array<string>, expected_terms array<string>"


def rows(lines: DataFrame, schema: str) -> DataFrame:
    """``line, row`` of the non-empty lines (``value``) that are JSON objects, and ``broken`` of the others."""
    kept = lines.filter(F.trim("value") != "").withColumn("row", F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return kept.select("value", "row", F.col("row._corrupt").isNotNull().alias("broken"))


def tags(lines: DataFrame, repo: str) -> DataFrame:
    """Symbols of a tag listing; rows of other types, broken lines and repeated symbols are left out."""
    r = rows(lines, TAG).filter("not broken").select("row.*").filter("_type = 'tag'")
    line = F.when(F.col("line") > 0, F.col("line")).otherwise(1)
    path, kind, name = F.coalesce("path", "input", F.lit("")), F.coalesce("kind", "kindName", F.lit("symbol")), F.coalesce("name", F.lit(""))
    scope = F.coalesce("scope", F.lit(""))
    out = r.select(path.alias("path"), kind.alias("kind"), name.alias("name"), F.coalesce("language", F.lit("Unknown")).alias("language"), F.when(scope != "", F.concat(scope, F.lit("::"), name)).otherwise(name).alias("qualified_name"), line.alias("start_line"), F.when(F.col("end") > 0, F.col("end")).otherwise(line).alias("end_line"), signature(F.coalesce("pattern", F.lit(""))).alias("signature"))
    parts = F.concat_ws("\x1f", F.lit(repo), F.lit("ctags"), "path", "kind", "qualified_name", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    made = out.select(F.concat(F.lit("sym:"), F.substring(F.sha1(parts), 1, 16)).alias("symbol_id"), F.lit(repo).alias("repo"), "*", F.lit("ctags").alias("provider"), F.lit(0.65).alias("confidence"))
    return made.dropDuplicates(["symbol_id"])


def signature(pattern: Column) -> Column:
    """The line that a tag's search pattern stands for."""
    return F.trim(F.replace(F.regexp_replace(F.trim(pattern), r'^/\^|\$/(;")?$', ""), F.lit("\\/"), F.lit("/")))


def span(r: Column) -> Column:
    """A range of three or four numbers from 0 as lines and columns from 1."""
    far = F.size(r) >= 4
    return F.struct((F.get(r, 0) + 1).alias("start_line"), (F.get(r, 1) + 1).alias("start_column"), (F.when(far, F.get(r, 2)).otherwise(F.get(r, 0)) + 1).alias("end_line"), (F.when(far, F.get(r, 3)).otherwise(F.get(r, 2)) + 1).alias("end_column"))


def scip(payload: DataFrame, repo: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, references and relations of an index (``documents``, as in ``SCIP``).

    A symbol is described where its first description stands and placed where its first definition does. A reference
    belongs to the smallest definition around it.
    """
    docs = payload.select(F.inline("documents")).filter("relative_path is not null")
    seen = docs.select(F.col("relative_path").alias("path"), "language", F.inline("occurrences")).filter("symbol is not null")
    places = seen.select("path", "language", "symbol", span(F.col("range")).alias("at"), F.when(F.size("enclosing_range") >= 3, span(F.col("enclosing_range"))).alias("around"), ((F.coalesce("symbol_roles", F.lit(0)) % 2) == 1).alias("defines"))
    told = docs.select(F.col("relative_path").alias("path"), F.inline("symbols")).filter("symbol is not null")
    first = told.groupBy("symbol").agg(F.min_by(F.struct("path", "kind", "display_name", "relationships"), "path").alias("d"))
    defined = places.filter("defines").groupBy("symbol").agg(F.min(F.struct("path", "at", "around", "language")).alias("p"))
    both = first.join(defined, "symbol", "full_outer")
    name = F.coalesce("d.display_name", F.regexp_extract("symbol", r"([A-Za-z0-9_]+)[^A-Za-z0-9_]*$", 1))
    ident = F.concat(F.lit("sym:"), F.substring(F.sha1(F.concat_ws("|", F.lit(repo), F.lit("scip"), "symbol")), 1, 16))
    at = F.coalesce("p.around", "p.at")
    symbols = both.select(ident.alias("symbol_id"), F.col("symbol").alias("qualified_name"), name.alias("name"), F.lower(F.coalesce("d.kind", F.lit("symbol"))).alias("kind"), F.coalesce("p.path", "d.path").alias("path"), at["start_line"].alias("start_line"), at["end_line"].alias("end_line"), F.lit("scip").alias("provider"), F.lit(0.95).alias("confidence"))
    uses = places.filter("not defines").select("path", "symbol", F.col("at.start_line").alias("line"), F.col("at.start_column").alias("column"))
    refs = uses.select(N.stable_id("ref", F.lit(repo), "path", "symbol", F.col("line").cast("string"), F.col("column").cast("string")).alias("ref_id"), "*").join(symbols.select(F.col("qualified_name").alias("symbol"), F.col("symbol_id").alias("target_id")), "symbol", "left")
    relations = first.select(F.col("symbol").alias("src"), F.explode("d.relationships").alias("r"))
    types = F.filter(F.array(F.when(F.col("r.is_implementation"), "IMPLEMENTS"), F.when(F.col("r.is_reference"), "REFERENCES"), F.when(F.col("r.is_type_definition"), "USES_TYPE"), F.when(F.col("r.is_definition"), "DEFINES")), lambda t: t.isNotNull())
    return symbols, refs, relations.select("src", F.col("r.symbol").alias("dst"), F.explode(types).alias("edge_type"))


def matches(lines: DataFrame, limit: int = 10) -> DataFrame:
    """``path, repository, language, score, line_number, preview`` of trigram-search results; a line's text is decoded."""
    r = rows(lines, MATCH).filter("not broken").select("row.*").limit(limit)
    one = r.select(F.coalesce("FileName", F.lit("")).alias("path"), F.coalesce("Repository", F.lit("")).alias("repository"), F.coalesce("Language", F.lit("")).alias("language"), F.coalesce("Score", F.lit(0.0)).alias("score"), F.explode_outer("LineMatches").alias("m"))
    text = F.coalesce(F.decode(F.expr("try_to_binary(m.Line, 'base64')"), "utf-8"), F.col("m.Line"), F.lit(""))
    return one.select("path", "repository", "language", "score", F.col("m.LineNumber").alias("line_number"), text.alias("preview"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a ``.jsonl`` file (blank lines and comments skipped) or of a ``.json`` one, which may wrap them.

    A case without name, repository or query, or of which nothing is expected, is an error.
    """
    if path.endswith(".jsonl"):
        lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
        raw = lines.select(F.from_json("value", CASE, {"mode": "FAILFAST"}).alias("c")).select("c.*")
    else:
        whole = spark.read.text(path, wholetext=True)
        inner = F.coalesce(F.get_json_object("value", "$.benchmarks"), F.get_json_object("value", "$.cases"), F.col("value"))
        listed = F.when(F.ltrim(inner).startswith("["), inner).otherwise(F.concat(F.lit("["), inner, F.lit("]")))
        raw = whole.select(F.inline(F.from_json(listed, f"array<struct<{CASE.replace(' string', ':string').replace(' array<', ':array<')}>>")))
    listed = lambda many, *ones: F.when(F.size(many) > 0, F.col(many)).otherwise(F.coalesce(*[F.when(F.coalesce(o, F.lit("")) != "", F.array(o)) for o in ones], F.array().cast("array<string>")))
    made = raw.select("name", "repo", "query", F.coalesce("task_type", F.lit("retrieval")).alias("task_type"), listed("expected_paths", "expected_path").alias("expected_paths"), listed("expected_symbols", "expected_name", "expected_symbol").alias("expected_symbols"), F.coalesce("expected_terms", F.array().cast("array<string>")).alias("expected_terms"))
    lacking = F.concat_ws("", F.when(F.coalesce("name", F.lit("")) == "", "name "), F.when(F.coalesce("repo", F.lit("")) == "", "repo "), F.when(F.coalesce("query", F.lit("")) == "", "query "), F.when((F.size("expected_paths") == 0) & (F.size("expected_symbols") == 0), "expected"))
    return made.withColumn("name", F.when(lacking == "", F.col("name")).otherwise(F.raise_error(F.concat(F.lit("a case lacks: "), lacking))))
