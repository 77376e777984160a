"""From a source tree to a store: inventory, symbols, resolved references, graph, search documents and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import numbers as N
from corvane.functions import text as T
from corvane.operators import graph, resolve
from corvane.sources import inventory, rust
from corvane.sources.store import Store, replace

#: Most bytes of a file whose text is searched, and edges of a field of one statement.
TEXT_BYTES, MOST = 256_000, 50
TYPES = ("struct", "enum", "trait", "impl", "type")
CALLABLE = ("function", "method", "associated_function")


def sources(files: DataFrame, packages: DataFrame, repo: str) -> DataFrame:
    """``path, package, module, source`` of Rust files, each in the deepest package that holds it."""
    kept = inventory.selected(files).select("path", F.decode("content", "utf-8").alias("source"))
    roots = packages.filter("kind in ('cargo-package', 'cargo-workspace') and name <> ''").select("root", F.col("name").alias("package"))
    up = kept.select("path", F.explode(T.path_prefixes(F.col("path"))).alias("root")).join(roots, "root").groupBy("path").agg(F.max_by(F.struct("root", "package"), F.length("root")).alias("p"))
    both = kept.join(up, "path", "left").select("path", "source", F.coalesce("p.root", F.lit(".")).alias("root"), F.coalesce("p.package", F.lit(repo)).alias("package"))
    crate = F.replace("package", F.lit("-"), F.lit("_"))
    return both.select("path", "package", inventory.module_path(F.col("path"), F.col("root"), crate).alias("module"), "source")


def symbol_table(parsed: DataFrame, repo: str) -> DataFrame:
    """Parsed symbols with stable ids, their containers' ids, and an order."""
    made = parsed.withColumnRenamed("symbol_id", "local_id").withColumn("symbol_id", N.stable_id("sym", F.lit(repo), "path", F.col("local_id").cast("string"), "kind", "qualified_name", F.col("start_line").cast("string"), F.col("end_line").cast("string"), T.collapse(F.col("signature")), "visibility"))
    up = made.select(F.col("path").alias("p"), F.col("local_id").alias("c"), F.col("symbol_id").alias("container_id"), F.col("kind").alias("container_kind"))
    return made.join(up, (F.col("path") == F.col("p")) & (F.col("container") == F.col("c")), "left").drop("p", "c").withColumn("ord", F.concat_ws(":", "path", F.lpad(F.col("local_id").cast("string"), 9, "0")))


def calls(statements: DataFrame, symbols: DataFrame) -> DataFrame:
    """``src, dst, name, line``: calls, resolved by whole names as written, in the caller's module and owner, then by the one best symbol of the last name."""
    held = statements.join(symbols.select("path", F.col("local_id").alias("symbol_id"), F.col("symbol_id").alias("caller"), F.col("qualified_name").alias("from"), "package"), ["path", "symbol_id"])
    refs = held.select("caller", "from", "package", "line", F.explode(F.slice("calls", 1, MOST)).alias("expr")).withColumn("ref_id", F.xxhash64("caller", "line", "expr"))
    owner = F.regexp_replace("from", "::[^:]*$", "")
    module = F.regexp_replace(owner, "::[^:]*$", "")
    refs = refs.select("*", F.regexp_replace("expr", r"^Self::", F.concat(owner, F.lit("::"))).alias("written")).dropDuplicates(["ref_id"])
    callable_ = symbols.filter(F.col("kind").isin(*CALLABLE))
    index = resolve.first_wins(callable_, "qualified_name", "ord")
    tried = [F.col("written"), F.concat_ws("::", owner, "written"), F.concat_ws("::", module, "written"), F.concat(F.replace("package", F.lit("-"), F.lit("_")), F.regexp_replace("written", "^crate", "")).alias("c")]
    first = resolve.in_order(refs, index, tried, key="qualified_name", value="symbol_id")
    last = F.regexp_extract("expr", r"([A-Za-z_]\w*)$", 1)
    rest = first.filter("symbol_id is null").select("ref_id", last.alias("name"), "package").withColumnRenamed("package", "home")
    classes = callable_.groupBy("name", "package").agg(F.count("*").alias("n"), F.min("symbol_id").alias("least"))
    score = resolve.AGREEMENT["callable"] + F.when(F.col("package") == F.col("home"), resolve.AGREEMENT["scope"]).otherwise(0.0)
    guessed = resolve.best_or_none(rest, classes, score, key="name").withColumnRenamed("symbol_id", "guess")
    both = first.join(guessed, "ref_id", "left")
    named = F.coalesce("symbol_id", "guess", N.stable_id("ref", F.col("expr")))
    return both.select(F.col("caller").alias("src"), named.alias("dst"), F.col("expr").alias("name"), "line")


def overriding(symbols: DataFrame) -> DataFrame:
    """OVERRIDES edges from methods of a trait's implementations to the trait's methods of their names."""
    up = symbols.filter("kind in ('impl', 'trait')").select(F.col("symbol_id").alias("container_id"), F.col("kind").alias("held"), F.when(F.col("kind") == "impl", F.col("impl_trait")).otherwise(F.col("name")).alias("owner"))
    inside = symbols.filter(F.col("kind").isin("method", "associated_function")).join(up, "container_id")
    src = inside.filter("held = 'impl' and owner is not null").select(F.col("symbol_id").alias("src"), "owner", "name")
    dst = inside.filter("held = 'trait'").groupBy("owner", "name").agg(F.min_by("symbol_id", "ord").alias("dst"))
    return src.join(dst, ["owner", "name"]).select("src", "dst", F.lit("OVERRIDES").alias("edge_type"))


def edges(symbols: DataFrame, imports: DataFrame, statements: DataFrame, called: DataFrame, files: DataFrame, repo: str) -> DataFrame:
    """All edges, with a hashed id; of equal ones, one."""
    link = lambda df, kind, a, b: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("edge_type")).filter("src is not null and dst is not null")
    file, col = F.concat(F.lit("file:"), "path"), F.col
    named = symbols.groupBy("name").agg(F.min_by("symbol_id", "ord").alias("known"))
    type_of = lambda df, target: df.join(named, col(target) == col("name"), "left").withColumn("to", F.coalesce("known", F.concat(F.lit("ref:"), target)))
    impls = symbols.filter("kind = 'impl'").select("symbol_id", "impl_target", "impl_trait")
    traits = symbols.filter("kind = 'trait'").select("symbol_id", F.explode("super_traits").alias("super"))
    stmt = F.concat(F.lit("stmt:"), "path", F.lit(":"), F.col("symbol_id").cast("string"), F.lit(":"), F.col("ord").cast("string"))
    placed = statements.select("*", stmt.alias("stmt"), F.concat_ws(":", "path", F.col("symbol_id").cast("string")).alias("body"))
    keys = F.explode(F.array_union(F.slice("reads", 1, MOST), F.array_union("writes", "defines")))
    flows = placed.select("stmt", "body", "line", "ord", "reads", F.array_union("writes", "defines").alias("made"), keys.alias("key"))
    writes, reads = F.array_contains("made", F.col("key")), F.array_contains("reads", F.col("key"))
    before = F.last(F.when(writes, F.col("stmt")), ignorenulls=True).over(Window.partitionBy("body", "key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    parts = [
        graph.hierarchy(files, "path", repo),
        link(symbols.filter("container_id is null"), "DEFINES", file, col("symbol_id")), link(symbols.filter("container_id is null"), "DECLARES", file, col("symbol_id")),
        link(symbols, "CONTAINS", col("container_id"), col("symbol_id")), link(symbols.filter("is_test"), "DECLARES", col("symbol_id"), F.concat(F.lit("test:"), "symbol_id")),
        link(type_of(impls.filter("impl_trait is not null"), "impl_trait"), "IMPLEMENTS", col("symbol_id"), col("to")), link(type_of(impls, "impl_target"), "REFERENCES", col("symbol_id"), col("to")),
        link(type_of(traits, "super"), "INHERITS", col("symbol_id"), col("to")),
        link(imports, "IMPORTS", file, F.concat(F.lit("dep:"), F.substring_index("target", "::", 1))), link(called, "CALLS", col("src"), col("dst")),
        link(called.join(symbols.filter("is_test").select(col("symbol_id").alias("src")), "src", "left_semi"), "TESTS", col("src"), col("dst")),
        overriding(symbols),
        graph.neighbor_edges(symbols, by=["path", "container_id"], order=["start_line", "symbol_id"], id_col="symbol_id").select("src", "dst", "edge_type"),
        link(graph.control_flow(placed, by=["body"], order=["ord"], id_col="stmt"), "CONTROL_FLOW", col("src"), col("dst")),
        link(flows.withColumn("before", before).filter(reads), "DATA_FLOW", col("before"), col("stmt")),
    ]
    every = reduce(DataFrame.unionByName, parts)
    return graph.identified(every, F.struct(F.lit(repo).alias("repo"))).select("edge_id", "edge_type", "src", "dst", "metadata")


def documents(symbols: DataFrame, files: DataFrame, bodies: DataFrame, repo: str) -> DataFrame:
    """Search documents: the repository, folders, packages, files, symbols and their bodies, and prose."""
    null = F.lit(None).cast("string")
    made = lambda df, kind, path, name, qualified, symbol, title, content: df.select(F.concat_ws(":", F.lit(kind), F.coalesce(symbol, path)).alias("doc_id"), F.lit(kind).alias("kind"), path.alias("path"), name.alias("name"), qualified.alias("qualified_name"), symbol.alias("symbol_id"), title.alias("title"), content.alias("content"))
    path, last, text = F.col("path"), F.substring_index("path", "/", -1), F.when((F.col("size") <= TEXT_BYTES) & ~F.col("generated"), F.decode("content", "utf-8"))
    prose = path.rlike(r"\.(md|txt)$")
    up = files.select(F.explode(T.path_prefixes(path)).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    whole = files.groupBy().agg(F.count("*").alias("n")).withColumn("path", F.lit("."))
    packages = symbols.groupBy("package").agg(F.count("*").alias("n")).withColumn("path", F.col("package"))
    held = symbols.join(bodies, "symbol_id", "left")
    body = F.array_join("statements", "\n")
    return reduce(DataFrame.unionAll, [
        made(whole, "repo", path, F.lit(repo), null, null, F.lit(f"repository {repo}"), F.format_string("%d files", "n")),
        made(up.filter("path <> '.'"), "directory", path, last, null, null, F.concat(F.lit("folder "), "path"), F.format_string("%d files", "n")),
        made(packages, "package", path, F.col("package"), null, null, F.concat(F.lit("package "), "package"), F.format_string("%d symbols", "n")),
        made(files.filter(~prose), "file", path, last, null, null, F.concat(F.lit("file "), "path"), F.coalesce(text, F.lit(""))),
        made(files.filter(prose), "doc", path, last, null, null, F.concat(F.lit("document "), "path"), F.coalesce(text, F.lit(""))),
        made(symbols, "symbol", path, F.col("name"), F.col("qualified_name"), F.col("symbol_id"), F.concat_ws(" ", "kind", "qualified_name"), F.col("signature")),
        made(held.filter(F.col("kind").isin(*CALLABLE) & F.col("statements").isNotNull()), "function_body", path, F.col("name"), F.col("qualified_name"), F.col("symbol_id"), F.concat(F.lit("body of "), "qualified_name"), body),
        made(symbols.filter(F.col("kind").isin(*TYPES)), "type_body", path, F.col("name"), F.col("qualified_name"), F.col("symbol_id"), F.concat(F.lit("type "), "qualified_name"), F.col("signature")),
    ])


def build(spark: SparkSession, root: str, target: str, repo: str) -> Store:
    """Everything below ``target``. Each table is written before the next one reads it."""
    store = Store(spark, target)
    store.mark(repo, "running")
    files = inventory.scan(spark, root)
    inventory.write(files, f"{target}/inventory")
    rows = sources(files, inventory.manifests(files), repo)
    replace(rows, f"{target}/sources")
    rows = store.table("sources")
    packages = rows.select("path", "package")
    for name, table in (("parsed", rust.symbols(rows)), ("imports", rust.imports(rows)), ("statements", rust.all_statements(rows))):
        replace(table, f"{target}/{name}")
    symbols = symbol_table(store.table("parsed"), repo).join(packages, "path")
    ids = symbols.select("path", F.col("local_id").alias("symbol_id"), F.col("symbol_id").alias("id"))
    bodies = store.table("statements").join(ids, ["path", "symbol_id"]).select(F.col("id").alias("symbol_id"), "ord", "text")
    counted = symbols.groupBy("path").agg(F.count("*").alias("n"))
    summaries = counted.select(N.stable_id("summary", F.lit(repo), "path").alias("summary_id"), "path", F.lit(None).cast("string").alias("symbol_id"), F.format_string("File %s has %d symbols.", "path", "n").alias("summary"))
    store.write_bundle(symbols, bodies, summaries)
    symbols = store.table("symbols")
    replace(calls(store.table("statements"), symbols), f"{target}/calls")
    listed = inventory.read(spark, f"{target}/inventory")
    links = edges(symbols, store.table("imports"), store.table("statements"), store.table("calls"), listed, repo)
    nodes = symbols.select(F.col("symbol_id").alias("node_id"), "kind", "name", "qualified_name", "path").unionByName(listed.select(F.concat(F.lit("file:"), "path").alias("node_id"), F.lit("file").alias("kind"), F.substring_index("path", "/", -1).alias("name"), F.lit(None).cast("string").alias("qualified_name"), "path"))
    store.write_graph(nodes, links)
    store.write_search(documents(symbols, files, store.table("bodies"), repo))
    store.mark(repo, "completed")
    return store
