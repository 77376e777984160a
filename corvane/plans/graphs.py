"""Queries of graph construction and traversal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import graph
from corvane.plans.registry import FILES, STATEMENTS, SYMBOLS, files, query, read, statements, symbols


def relational_edges(spark, sf_dir) -> DataFrame:
    """The tables as a graph, region to nation to customer to order to part and supplier."""
    n = graph.node
    nation, customer, supplier, orders, lineitem = (read(spark, sf_dir, t) for t in ("nation", "customer", "supplier", "orders", "lineitem"))
    parts = [
        graph.edges(nation, "CONTAINS", n("region", F.col("n_regionkey")), n("nation", F.col("n_nationkey"))),
        graph.edges(customer, "CONTAINS", n("nation", F.col("c_nationkey")), n("customer", F.col("c_custkey"))),
        graph.edges(supplier, "CONTAINS", n("nation", F.col("s_nationkey")), n("supplier", F.col("s_suppkey"))),
        graph.edges(orders, "PLACES", n("customer", F.col("o_custkey")), n("order", F.col("o_orderkey"))),
        graph.edges(lineitem, "REFERENCES", n("order", F.col("l_orderkey")), n("part", F.col("l_partkey"))),
        graph.edges(lineitem, "CALLS", n("part", F.col("l_partkey")), n("supplier", F.col("l_suppkey"))),
    ]
    return reduce(DataFrame.unionAll, parts)


EDGES = """select 'region:' || n_regionkey src, 'nation:' || n_nationkey dst, 'CONTAINS' edge_type from nation
union all select 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS' from customer
union all select 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'CONTAINS' from supplier
union all select 'customer:' || o_custkey, 'order:' || o_orderkey, 'PLACES' from orders
union all select 'order:' || l_orderkey, 'part:' || l_partkey, 'REFERENCES' from lineitem
union all select 'part:' || l_partkey, 'supplier:' || l_suppkey, 'CALLS' from lineitem"""
AROUND = f"a as (select src node, dst neighbor, edge_type, 'out' direction from ({EDGES}) union all select dst, src, edge_type, 'in' from ({EDGES}))"


def seeds(spark, *ids: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ids], "node string")


@query(f"select src, dst, edge_type, count(*) n from ({EDGES}) group by all")
def edges_contains(spark, sf_dir):
    return relational_edges(spark, sf_dir).groupBy("src", "dst", "edge_type").agg(F.count("*").alias("n"))


@query(f"""select node, edge_type, sum(o)::bigint out_degree, sum(i)::bigint in_degree from
(select src node, edge_type, 1 o, 0 i from ({EDGES}) union all select dst, edge_type, 0, 1 from ({EDGES})) group by all""")
def degree_by_edge_type(spark, sf_dir):
    return graph.degree(relational_edges(spark, sf_dir))


@query(f"""with d as (select node, edge_type, sum(o)::bigint o, sum(i)::bigint i from (select src node, edge_type, 1 o, 0 i from ({EDGES}) union all select dst, edge_type, 0, 1 from ({EDGES})) group by all)
select node, coalesce(string_agg(edge_type || '=' || o, ',' order by edge_type) filter (o > 0), '') outgoing, coalesce(string_agg(edge_type || '=' || i, ',' order by edge_type) filter (i > 0), '') incoming from d group by 1""")
def degree_maps(spark, sf_dir):
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    maps = graph.degree_maps(relational_edges(spark, sf_dir))
    return maps.select("node", shown("outgoing").alias("outgoing"), shown("incoming").alias("incoming"))


@query(f"""select distinct edge_id, src, dst, edge_type from (select 'edge:' || substr(sha1(edge_type || '|' || src || '|' || dst || '|' || metadata), 1, 16) edge_id, * from
(select 'order:' || l_orderkey src, 'part:' || l_partkey dst, 'REFERENCES' edge_type, '{{"flag":"' || l_returnflag || '","line":' || l_linenumber || '}}' metadata from lineitem))""")
def edge_ids(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    made = lines.select(graph.node("order", F.col("l_orderkey")).alias("src"), graph.node("part", F.col("l_partkey")).alias("dst"), F.lit("REFERENCES").alias("edge_type"), F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line")).alias("m"))
    return graph.identified(made, F.col("m")).select("edge_id", "src", "dst", "edge_type")


@query(f"with {AROUND} select node, neighbor, edge_type, direction, count(*) n from a where node in ('customer:5', 'nation:3') and direction = 'out' group by all")
def adjacency_outgoing(spark, sf_dir):
    around = graph.adjacency(relational_edges(spark, sf_dir), "out").filter(F.col("node").isin("customer:5", "nation:3"))
    return around.groupBy("node", "neighbor", "edge_type", "direction").agg(F.count("*").alias("n"))


@query(f"with {AROUND} select node, neighbor, edge_type, direction, count(*) n from a where node in ('part:7', 'supplier:3') and direction = 'in' and edge_type in ('REFERENCES', 'CALLS') group by all")
def adjacency_incoming(spark, sf_dir):
    around = graph.adjacency(relational_edges(spark, sf_dir), "in", ["REFERENCES", "CALLS"]).filter(F.col("node").isin("part:7", "supplier:3"))
    return around.groupBy("node", "neighbor", "edge_type", "direction").agg(F.count("*").alias("n"))


def sql_two_hops(kinds: str = "true", types: str = "true") -> str:
    return f"""with {AROUND}, b as (select * from a where {kinds} and {types}), h1 as (select distinct neighbor, edge_type, direction, 1 depth from b where node in ('nation:3', 'part:7')),
h2 as (select distinct neighbor, edge_type, direction, 2 depth from b where node in (select neighbor from h1) and node not in ('nation:3', 'part:7')) select * from h1 union all select * from h2"""


@query(sql_two_hops())
def neighbors_2hop(spark, sf_dir):
    return graph.neighbors(relational_edges(spark, sf_dir), seeds(spark, "nation:3", "part:7"), depth=2)


@query(sql_two_hops("split_part(neighbor, ':', 1) in ('supplier', 'part', 'customer')"))
def neighbors_kind_filter(spark, sf_dir):
    return graph.neighbors(relational_edges(spark, sf_dir), seeds(spark, "nation:3", "part:7"), kinds=["supplier", "part", "customer"], depth=2)


@query(f"""with {AROUND} select distinct 'callers_of' operation, neighbor, edge_type, direction, 1 depth from a where node = 'supplier:3' and edge_type = 'CALLS' and direction = 'in'
union all select distinct 'callees_of', neighbor, edge_type, direction, 1 from a where node = 'part:7' and edge_type = 'CALLS' and direction = 'out'
union all select distinct 'refs_of', neighbor, edge_type, direction, 1 from a where node = 'order:11' and edge_type = 'REFERENCES' and direction = 'out'""")
def named_neighbors(spark, sf_dir):
    links, out = relational_edges(spark, sf_dir), []
    for operation, seed in (("callers_of", "supplier:3"), ("callees_of", "part:7"), ("refs_of", "order:11")):
        types, direction = graph.OPERATIONS[operation]
        met = graph.neighbors(links, seeds(spark, seed), direction=direction, types=types)
        out.append(met.select(F.lit(operation).alias("operation"), "*"))
    return reduce(DataFrame.unionAll, out)


@query(f"""with {AROUND}, t as (select neighbor, edge_type, direction from a where node = 'part:7' and edge_type = 'CALLS') select neighbor, direction, count(*) n from t group by all""")
def trace_calls(spark, sf_dir):
    around = graph.adjacency(relational_edges(spark, sf_dir), "both", ["CALLS"]).filter(F.col("node") == "part:7")
    return around.groupBy("neighbor", "direction").agg(F.count("*").alias("n"))


@query(f"""with recursive e as ({EDGES}), b as (select src, dst from e where edge_type in ('CONTAINS', 'PLACES') union all select dst, src from e where edge_type in ('CONTAINS', 'PLACES')),
w as (select 'region:0' node, 0 depth union select dst, depth + 1 from w join b on src = node where depth < 3)
select node, min(depth) depth from w group by 1""")
def shortest_path_hops(spark, sf_dir):
    links = relational_edges(spark, sf_dir).filter(F.col("edge_type").isin("CONTAINS", "PLACES"))
    return graph.hops(links, seeds(spark, "region:0"), 3)


@query(f"""with recursive e as (select distinct src, dst from ({EDGES})),
w as (select node seed, node, node path, 0 hop_count from (values ('region:0'), ('region:1'), ('customer:8'), ('part:7')) v(node)
union all select seed, dst, path || '>' || dst, hop_count + 1 from w join e on src = node where hop_count < 4 and not contains('>' || path || '>', '>' || dst || '>')),
f as (select seed, hop_count, node target, min(path) path from w where hop_count > 0 and node in ('order:7', 'order:100', 'part:3', 'supplier:4') group by all)
select seed, target, hop_count::int hop_count, path from (select *, row_number() over (partition by seed order by hop_count, target, path) k from f) where k = 1""")
def path_between(spark, sf_dir):
    return graph.shortest_paths(relational_edges(spark, sf_dir), seeds(spark, "region:0", "region:1", "customer:8", "part:7"), seeds(spark, "order:7", "order:100", "part:3", "supplier:4"), direction="out", most=4)


CALLS = "select distinct 'part:' || l_partkey src, 'part:' || ((l_partkey * 7 + l_suppkey) % 150) dst from lineitem where l_linenumber <= 2"


def calls(spark, sf_dir) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").filter("l_linenumber <= 2")
    return graph.edges(lines, "CALLS", graph.node("part", F.col("l_partkey")), graph.node("part", (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 150)).select("src", "dst").distinct()


@query(f"""with c as ({CALLS}), l1 as (select distinct c.src, d.dst from c join c d on d.src = c.dst),
f1 as (select src, dst from (select l1.*, row_number() over (partition by l1.src order by l1.dst) k from l1 anti join c on c.src = l1.src and c.dst = l1.dst) where k <= 100),
l2 as (select distinct f1.src, d.dst from f1 join c d on d.src = f1.dst),
m as (select src, dst, 1 depth from l1 union all select l2.src, l2.dst, 2 from l2 anti join l1 on l1.src = l2.src and l1.dst = l2.dst)
select src, dst, depth from (select *, row_number() over (partition by src order by depth, dst) k from m) where k <= 50""")
def transitive_targets_capped(spark, sf_dir):
    return graph.closure(calls(spark, sf_dir))


@query(f"""with c as ({CALLS}), l1 as (select distinct c.src, d.dst from c join c d on d.src = c.dst),
t as (select src, dst, 1 depth from c union all select src, dst, 2 from l1), f as (select distinct 'part:' || l_partkey symbol, l_suppkey field from lineitem where l_linenumber = 3),
m as (select src, field, min(depth) depth from t join f on dst = symbol group by all)
select src, field, depth from (select *, row_number() over (partition by src order by depth, field) k from m) where k <= 50""")
def interprocedural_reads(spark, sf_dir):
    fields = read(spark, sf_dir, "lineitem").filter("l_linenumber = 3").select(graph.node("part", F.col("l_partkey")).alias("symbol"), F.col("l_suppkey").alias("field")).distinct()
    return graph.reached_fields(calls(spark, sf_dir), fields, depth=2)


@query(f"""with w as (select *, last_value(case when writes then statement end ignore nulls) over (partition by container, key order by ts, statement rows between unbounded preceding and 1 preceding) src from ({STATEMENTS}))
select src, statement dst from w where src is not null""")
def edges_data_flow(spark, sf_dir):
    return graph.data_flow(statements(spark, sf_dir), by=["container", "key"], order=["ts", "statement"], id_col="statement", writes=F.col("writes"))


@query(f"select * from (select lag(statement) over (partition by container order by ts, statement) src, statement dst from ({STATEMENTS})) where src is not null")
def edges_control_flow(spark, sf_dir):
    return graph.control_flow(statements(spark, sf_dir), by=["container"], order=["ts", "statement"], id_col="statement")


@query(f"""with p as (select lag(symbol_id) over (partition by path, package order by start_line, symbol_id) src, symbol_id dst from ({SYMBOLS}))
select src, dst, 'NEIGHBOR' edge_type from p where src is not null union all select dst, src, 'NEIGHBOR' from p where src is not null""")
def edges_neighbor(spark, sf_dir):
    return graph.neighbor_edges(symbols(spark, sf_dir), by=["path", "package"], order=["start_line", "symbol_id"], id_col="symbol_id")


@query(f"""with t as (select package, name, arg_min(symbol_id, ord) dst from ({SYMBOLS}) where kind = 'trait' group by all)
select symbol_id src, dst, 'OVERRIDES' edge_type from ({SYMBOLS}) s join t using (package, name) where s.kind = 'method'""")
def edges_overrides(spark, sf_dir):
    return graph.overrides(symbols(spark, sf_dir).withColumnRenamed("package", "owner"))


@query(f"""with p as (select distinct path from ({SYMBOLS})), parts as (select path, string_split(path, '/') x from p),
e as (select 'repo:code' src, case when len(x) = 1 then 'file:' || path else 'dir:' || x[1] end dst from parts
union select 'dir:' || array_to_string(x[1:k], '/'), case when k + 1 = len(x) then 'file:' || path else 'dir:' || array_to_string(x[1:k + 1], '/') end from parts, generate_series(1, 10) g(k) where k < len(x))
select src, dst, 'CONTAINS' edge_type from e""")
def edges_hierarchy(spark, sf_dir):
    return graph.hierarchy(symbols(spark, sf_dir), "path", "code")


@query(f"""select 'file:' || path src, symbol_id dst, t edge_type from ({SYMBOLS}), (values ('DEFINES'), ('DECLARES')) v(t) where kind <> 'method'
union all select c.dst, s.symbol_id, 'CONTAINS' from ({SYMBOLS}) s join (select path, min(symbol_id) dst from ({SYMBOLS}) where kind = 'impl' group by 1) c using (path) where s.kind = 'method'
union all select symbol_id, 'test:' || symbol_id, 'DECLARES' from ({SYMBOLS}) where starts_with(path, 'tests/')""")
def edges_symbols(spark, sf_dir):
    s = symbols(spark, sf_dir)
    plain = s.filter("kind <> 'method'").select(F.concat(F.lit("file:"), "path").alias("src"), F.col("symbol_id").alias("dst"), F.explode(F.array(F.lit("DEFINES"), F.lit("DECLARES"))).alias("edge_type"))
    impls = s.filter("kind = 'impl'").groupBy("path").agg(F.min("symbol_id").alias("src"))
    held = s.filter("kind = 'method'").join(impls, "path").select("src", F.col("symbol_id").alias("dst"), F.lit("CONTAINS").alias("edge_type"))
    tests = s.filter(F.col("path").startswith("tests/")).select(F.col("symbol_id").alias("src"), F.concat(F.lit("test:"), "symbol_id").alias("dst"), F.lit("DECLARES").alias("edge_type"))
    return plain.unionAll(held).unionAll(tests)


@query(f"""with n as (select distinct 'file:' || path node from ({SYMBOLS})), s as (select 'file:' || path node, 'summary:' || file_id dst from ({FILES}) union all select 'file:' || path, 'summary:' || symbol_id from ({SYMBOLS}))
select node src, dst, 'SUMMARIZED_BY' edge_type from s where node in (select node from n)""")
def edges_summarized_by(spark, sf_dir):
    s, node = symbols(spark, sf_dir), F.concat(F.lit("file:"), "path").alias("src")
    pages = files(spark, sf_dir).select(node, F.concat(F.lit("summary:"), F.col("file_id").cast("string")).alias("dst"))
    made = pages.unionAll(s.select(node, F.concat(F.lit("summary:"), "symbol_id").alias("dst")))
    return made.join(s.select(node).distinct(), "src", "left_semi").withColumn("edge_type", F.lit("SUMMARIZED_BY"))


@query(f"""with p as (select *, row_number() over (partition by container order by ts, statement) place from ({STATEMENTS})),
s as (select container, statement seed, place from p where statement % 250 = 0)
select seed, p.statement, (p.place - s.place)::int "offset" from s join p using (container) where p.place - s.place between -4 and 3""")
def statement_slice(spark, sf_dir):
    rows = statements(spark, sf_dir)
    return graph.slices(rows, rows.filter("statement % 250 = 0").select(F.col("statement").alias("node")), by="container", order=["ts", "statement"], id_col="statement")


@query(f"""with {AROUND}, s(node) as (values ('nation:3'), ('part:7'), ('supplier:3'), ('order:11'))
select node, direction, edge_type, count(*) n, count(distinct neighbor) targets from a join s using (node) group by all""")
def symbol_summary(spark, sf_dir):
    asked = F.col("node").isin("nation:3", "part:7", "supplier:3", "order:11")
    around = graph.adjacency(relational_edges(spark, sf_dir)).filter(asked)
    return around.groupBy("node", "direction", "edge_type").agg(F.count("*").alias("n"), F.countDistinct("neighbor").alias("targets"))


@query(f"""select node_id, tier from (select symbol_id node_id, case when 'SMALL_ring' in (symbol_id, qualified_name, name, path) then 0 when 'small_ring' in (lower(symbol_id), lower(qualified_name), lower(name), lower(path)) then 1 end tier from ({SYMBOLS}))
where tier is not null order by tier, node_id limit 10""")
def seed_resolution(spark, sf_dir):
    nodes = symbols(spark, sf_dir).withColumnRenamed("symbol_id", "node_id")
    return graph.resolve_seeds(nodes, "SMALL_ring").select("node_id", "tier")


@query(f"""with {AROUND}, k as (select neighbor, split_part(neighbor, ':', 1) kind from a where node = 'order:11' union all select 'stmt:' || event_id, 'statement' from events where event_id < 5)
select distinct neighbor, kind from k where kind not in ('statement', 'symbol_ref', 'module_ref', 'type_ref', 'trait_ref') and not starts_with(neighbor, 'stmt:') and not starts_with(neighbor, 'ref:') and kind in ('part', 'customer')""")
def clean_neighbors(spark, sf_dir):
    met = graph.adjacency(relational_edges(spark, sf_dir)).filter(F.col("node") == "order:11").select("neighbor", F.substring_index("neighbor", ":", 1).alias("kind"))
    met = met.unionAll(read(spark, sf_dir, "events").filter("event_id < 5").select(F.concat(F.lit("stmt:"), F.col("event_id").cast("string")), F.lit("statement")))
    return met.filter(~graph.noise(F.col("neighbor"), F.col("kind")) & F.col("kind").isin("part", "customer")).distinct()
