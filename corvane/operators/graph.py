"""Edges between rows of tables, and bounded traversal. Edges are ``src, dst, edge_type``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.tables import written

#: What named neighbour queries follow, and node kinds and ids that are noise in their results.
OPERATIONS = {
    "who_imports": (("IMPORTS",), "in"), "callers_of": (("CALLS",), "in"), "callees_of": (("CALLS",), "out"), "implements_of": (("IMPLEMENTS",), "in"),
    "inherits_of": (("INHERITS",), "in"), "reads_of": (("READS",), "out"), "writes_of": (("WRITES",), "out"), "refs_of": (("REFS", "REFERENCES"), "out"),
}
NOISE_KINDS = ("statement", "symbol_ref", "module_ref", "type_ref", "trait_ref")


def node(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind + ":"), key.cast("string"))


def edges(df: DataFrame, kind: str, source: Column, target: Column) -> DataFrame:
    return df.select(source.alias("src"), target.alias("dst"), F.lit(kind).alias("edge_type")).filter("src is not null and dst is not null")


def identified(links: DataFrame, metadata: Column) -> DataFrame:
    """``links`` with ``edge_id``, a hash of ends, type and metadata as JSON with sorted keys; of one id, one edge."""
    made = links.withColumn("metadata", F.to_json(metadata))
    made = made.withColumn("edge_id", F.concat(F.lit("edge:"), F.substring(F.sha1(F.concat_ws("|", "edge_type", "src", "dst", "metadata")), 1, 16)))
    return made.dropDuplicates(["edge_id"])


def degree(links: DataFrame) -> DataFrame:
    """``node, edge_type, out_degree, in_degree``."""
    ends = links.select(F.col("src").alias("node"), "edge_type", F.lit(1).alias("o"), F.lit(0).alias("i"))
    ends = ends.unionAll(links.select(F.col("dst").alias("node"), "edge_type", F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node", "edge_type").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def degree_maps(links: DataFrame) -> DataFrame:
    """``node, outgoing, incoming``: of each node, maps from edge type to number; there are few types."""
    entry = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(c) > 0, F.struct("edge_type", c)))))
    return degree(links).groupBy("node").agg(entry("out_degree").alias("outgoing"), entry("in_degree").alias("incoming"))


def adjacency(links: DataFrame, direction: str = "both", types: Sequence[str] = ()) -> DataFrame:
    """``node, neighbor, edge_type, direction``: one row for each edge and direction; no types are all types."""
    if types:
        links = links.filter(F.col("edge_type").isin(*types))
    out = links.select(F.col("src").alias("node"), F.col("dst").alias("neighbor"), "edge_type", F.lit("out").alias("direction"))
    into = links.select(F.col("dst").alias("node"), F.col("src").alias("neighbor"), "edge_type", F.lit("in").alias("direction"))
    return out if direction == "out" else into if direction == "in" else out.unionAll(into)


def neighbors(links: DataFrame, seeds: DataFrame, *, direction: str = "both", types: Sequence[str] = (), kinds: Sequence[str] = (), depth: int = 1) -> DataFrame:
    """``neighbor, edge_type, direction, depth``: what is met from any of ``seeds`` (``node``), hop by hop.

    A node is gone on from once, at its least depth, but stands in the result for every type, direction and depth at
    which it is met. Of other ``kinds`` (the part of an id before the colon) nodes are neither met nor gone on from.
    Each frontier is a table, so a hop's plan reads the one before and no more.
    """
    around = adjacency(links, direction, types)
    if kinds:
        around = around.filter(F.substring_index("neighbor", ":", 1).isin(*kinds))
    seen = frontier = seeds.select("node").distinct()
    met = []
    for hop in range(1, max(depth, 1) + 1):
        met.append(written(around.join(frontier, "node", "left_semi").select("neighbor", "edge_type", "direction").distinct().withColumn("depth", F.lit(hop)), "met"))
        if hop < depth:
            frontier = written(met[-1].select(F.col("neighbor").alias("node")).distinct().join(seen, "node", "left_anti"), "frontier")
            if frontier.isEmpty():
                break
            seen = seen.unionAll(frontier)
    return reduce(DataFrame.unionAll, met)


def hops(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``node, depth``: the fewest undirected links from any of ``seeds`` (``node``), up to ``depth``."""
    both = adjacency(links).select("node", "neighbor")
    seen = frontier = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    for k in range(1, depth + 1):
        reached = both.join(frontier.select("node"), "node", "left_semi").select(F.col("neighbor").alias("node")).distinct()
        frontier = written(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(k)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def shortest_paths(links: DataFrame, seeds: DataFrame, targets: DataFrame, *, direction: str = "both", types: Sequence[str] = (), most: int = 8) -> DataFrame:
    """``seed, target, hop_count, path``: of each seed the path of fewest links to any target, as far as ``most`` links.

    Of equal ones it is that of the least target, then the least path. Nodes of a path stand with ``>`` between them.
    """
    around = adjacency(links, direction, types).select("node", "neighbor").distinct()
    frontier = seeds.select(F.col("node").alias("seed"), "node", F.col("node").alias("path")).distinct()
    seen, found = frontier.select("seed", "node"), []
    for hop in range(1, most + 1):
        step = frontier.join(around, "node").select("seed", F.col("neighbor").alias("node"), F.concat_ws(">", "path", "neighbor").alias("path"))
        reached = written(step.groupBy("seed", "node").agg(F.min("path").alias("path")).join(seen, ["seed", "node"], "left_anti"), "reached")
        hit = reached.join(targets.select("node").distinct(), "node", "left_semi")
        found.append(hit.groupBy("seed").agg(F.min(F.struct("node", "path")).alias("best")).select("seed", F.col("best.node").alias("target"), F.lit(hop).alias("hop_count"), "best.path"))
        frontier = reached.join(hit.select("seed").distinct(), "seed", "left_anti")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(reached.select("seed", "node"))
    return reduce(DataFrame.unionAll, found)


def closure(calls: DataFrame, depth: int = 2, targets: int = 50, frontier: int = 100) -> DataFrame:
    """``src, dst, depth``: what a source's direct targets (``src, dst``) call, and theirs, up to ``depth`` calls on.

    Each source keeps at most ``targets`` of them, by depth and id, and goes on from at most ``frontier`` new ones.
    """
    direct = calls.select("src", "dst").distinct()
    nested = direct.select(F.col("src").alias("via"), F.col("dst").alias("next"))
    now, gone, met = direct, None, None
    for k in range(1, depth + 1):
        reached = now.join(nested, F.col("dst") == F.col("via")).select("src", F.col("next").alias("dst")).distinct()
        fresh = reached if met is None else reached.join(met, ["src", "dst"], "left_anti")
        fresh = written(fresh.withColumn("depth", F.lit(k)), "called")
        gone = now if gone is None else gone.unionAll(now)
        met = fresh if met is None else met.unionAll(fresh)
        place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
        ahead = fresh.select("src", "dst").join(gone, ["src", "dst"], "left_anti")
        now = ahead.withColumn("place", place).filter(F.col("place") <= frontier).select("src", "dst")
    place = F.row_number().over(Window.partitionBy("src").orderBy("depth", "dst"))
    return met.withColumn("place", place).filter(F.col("place") <= targets).select("src", "dst", "depth")


def reached_fields(calls: DataFrame, fields: DataFrame, depth: int = 3, targets: int = 50) -> DataFrame:
    """``src, field, depth``: the fields (``symbol, field``) of what a source calls, directly or on, at the least depth."""
    through = calls.select("src", "dst").distinct()
    if depth > 1:
        through = through.withColumn("depth", F.lit(1)).unionAll(closure(calls, depth - 1, 1 << 30).select("src", "dst", F.col("depth") + 1))
    else:
        through = through.withColumn("depth", F.lit(1))
    met = through.join(fields, F.col("dst") == F.col("symbol")).groupBy("src", "field").agg(F.min("depth").alias("depth"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("depth", "field"))
    return met.withColumn("place", place).filter(F.col("place") <= targets).select("src", "field", "depth")


def data_flow(df: DataFrame, *, by: Sequence[str], order: Sequence[str], id_col: str, writes: Column) -> DataFrame:
    """``src, dst``: each row of a group (container and key) and the last row before it that ``writes``; none without one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(F.when(writes, F.col(id_col)), ignorenulls=True).over(w)
    return df.select(found.alias("src"), F.col(id_col).alias("dst")).filter("src is not null")


def control_flow(df: DataFrame, *, by: Sequence[str], order: Sequence[str], id_col: str) -> DataFrame:
    """``src, dst``: each row and the next one of its group."""
    return df.select(F.lag(id_col).over(Window.partitionBy(*by).orderBy(*order)).alias("src"), F.col(id_col).alias("dst")).filter("src is not null")


def neighbor_edges(df: DataFrame, *, by: Sequence[str], order: Sequence[str], id_col: str) -> DataFrame:
    """NEIGHBOR edges both ways between rows that follow each other in a group."""
    pairs = control_flow(df, by=by, order=order, id_col=id_col)
    return pairs.unionAll(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("edge_type", F.lit("NEIGHBOR"))


def hierarchy(paths: DataFrame, path_col: str, repo: str) -> DataFrame:
    """CONTAINS edges repository → folders → files, each once."""
    path = F.col(path_col)
    chain = F.concat(F.array(F.lit("repo:" + repo)), F.transform(F.filter(T.path_prefixes(path), lambda p: p != "."), lambda p: F.concat(F.lit("dir:"), p)), F.array(F.concat(F.lit("file:"), path)))
    steps = F.transform(F.sequence(F.lit(1), F.size("chain") - 1), lambda k: F.struct(F.element_at("chain", k).alias("src"), F.element_at("chain", k + 1).alias("dst")))
    found = paths.select(path_col).distinct().select(chain.alias("chain")).select(F.inline(steps)).distinct()
    return found.withColumn("edge_type", F.lit("CONTAINS"))


def overrides(symbols: DataFrame) -> DataFrame:
    """``src, dst``: methods (``symbol_id, kind, owner, name``) and the traits of their owner that declare the name."""
    methods = symbols.filter("kind = 'method'").select(F.col("symbol_id").alias("src"), "owner", "name")
    traits = symbols.filter("kind = 'trait'").groupBy("owner", "name").agg(F.min_by("symbol_id", "ord").alias("dst"))
    return methods.join(traits, ["owner", "name"]).select("src", "dst").withColumn("edge_type", F.lit("OVERRIDES"))


def noise(node_id: Column, kind: Column) -> Column:
    return kind.isin(*NOISE_KINDS) | node_id.startswith("stmt:") | node_id.startswith("ref:")


def slices(statements: DataFrame, seeds: DataFrame, *, by: str, order: Sequence[str], id_col: str, window: int = 8) -> DataFrame:
    """``seed, id_col, offset``: of each seed statement the ones around it in its container, ``window`` at most."""
    placed = statements.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    back = window // 2
    asked = placed.join(seeds.select(F.col("node").alias(id_col)), id_col, "left_semi").select(by, F.col(id_col).alias("seed"), F.explode(F.sequence(F.lit(-back), F.lit(window - back - 1))).alias("offset"), "place")
    asked = asked.select(by, "seed", "offset", (F.col("place") + F.col("offset")).alias("place"))
    return asked.join(placed.select(by, "place", id_col), [by, "place"]).select("seed", id_col, "offset")


def resolve_seeds(nodes: DataFrame, asked: str, most: int = 10) -> DataFrame:
    """Rows of ``nodes`` whose id, qualified name, name or path is ``asked``; without any, those that are it but for case."""
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("node_id", "qualified_name", "name", "path")]
    same = lambda f, x: reduce(lambda a, b: a | b, [f(c) == x for c in fields])
    tier = F.when(same(lambda c: c, asked), 0).when(same(F.lower, asked.lower()), 1)
    tiered = nodes.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    least = tiered.agg(F.min("tier")).first()[0]
    return tiered.filter(F.col("tier") == F.lit(least)).orderBy("node_id").limit(most)
