"""Queries of the symbol table, of candidates' scores and of edges from statements and references."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import numbers as N
from corvane.functions import text as T
from corvane.operators import candidates, ranking
from corvane.plans.graphs import AROUND, relational_edges, seeds
from corvane.plans.registry import STATEMENTS, SYMBOLS, query, read, statements, symbols
from corvane.plans.resolution import REFERENCES, references

_SQL_KIND = "case kind when 'trait' then 24 when 'struct' then 22 when 'enum' then 20 when 'impl' then 14 when 'method' then 6 when 'function' then 5 when 'field' then -18 when 'local' then -24 else 0 end"
_ACT = "least((ord % 5) * 4.0::double + (ord % 3) * 1.25::double, 240) * 0.7::double"
_TOKEN = lambda t: f"case when contains(q, '{t}') then 16 when contains(n, '{t}') then 14 when contains(ti, '{t}') then 9 when contains(pr, '{t}') then 7 when contains(pa, '{t}') then 6 else 0 end + case when list_contains(ids, '{t}') then 5 else 0 end"


@query(rf"""with c as (select *, lower(qualified_name) q, lower(name) n, lower(kind || ' of ' || package) ti, 'holds ' || lower(name) pr, lower(path) pa, string_split_regex(lower(name), '[^a-z0-9]+') ids from ({SYMBOLS})),
h as (select *, contains(q || ' ' || n || ' ' || pa || ' ' || ti || ' ' || pr, 'small')::int + contains(q || ' ' || n || ' ' || pa || ' ' || ti || ' ' || pr, 'ring')::int hits from c)
select symbol_id, round((ord % 9)::double + {_TOKEN('small')} + {_TOKEN('ring')} + case hits when 2 then 26 when 0 then -18 else 0 end + 30 + {_SQL_KIND} + 3.0::double + greatest(20 - (ord % 4) * 6, 2) + greatest(18 - (ord % 6) * 4, 4)
 + case when visibility = 'pub' then 8 else -2 end + {_ACT} * case when kind in ('struct', 'enum', 'trait') then 0.12::double when kind = 'impl' then 0.16::double when kind in ('function', 'method') then 0.34::double else 0 end
 + 28 * ((ord % 3) / 2.0::double) - case when kind in ('field', 'local') then 28 else 0 end, 6)::double score from h""")
def rerank_heuristic(spark, sf_dir):
    o = F.col("ord")
    score = candidates.rerank_score(
        ["small", "ring"], exploratory=True, base=(o % 9).cast("double"), kind=F.lit("symbol"), symbol_kind=F.col("kind"), name=F.col("name"), qualified=F.col("qualified_name"), title=F.concat_ws(" of ", "kind", "package"), preview=F.concat(F.lit("holds "), F.col("name")), path=F.col("path"),
        visibility=F.col("visibility"), activity=N.activity({"direct_calls": o % 5, "reads": o % 3}), distance=o % 4 + 1, containment=o % 6, relevance=(o % 3) / F.lit(2.0),
    )
    return symbols(spark, sf_dir).select("symbol_id", F.round(score, 6).alias("score"))


_SYM = f"""with c as (select *, lower(qualified_name) q, lower(name) n, lower(package) co, lower(path) pa from ({SYMBOLS})),
s as (select *, (case when q = 'ring' then 400 else 0 end + case when n = 'ring' then 250 else 0 end + case when q = 'ring' or q like '%::ring' then 180 else 0 end + case when contains(q, 'ring') then 80 else 0 end + case when contains(co, 'ring') then 24 else 0 end + case when contains(pa, 'ring') then 30 else 0 end
 + case when contains(q, 'ring') then 18 when contains(n, 'ring') then 15 when contains(co, 'ring') then 10 when contains(pa, 'ring') then 8 when contains(kind, 'ring') then 6 else 0 end + case when contains(q || ' ' || n || ' ' || co || ' ' || pa || ' ' || kind, 'ring') then 40 else -8 end
 + {_ACT} + case when visibility = 'pub' then 18 else 0 end + case when starts_with(path, 'tests/') then -80 else 0 end + case when kind in ('function', 'method') then 10 else 0 end - case when kind in ('local', 'field') then 150 else 0 end)::double score from c)"""


@query(f"{_SYM} select symbol_id, round(score, 6) score, row_number() over (order by round(score, 6) desc, path, qualified_name, symbol_id)::int place from s qualify place <= 25")
def symbol_candidates(spark, sf_dir):
    o = F.col("ord")
    score = candidates.symbol_score("ring", name=F.col("name"), qualified=F.col("qualified_name"), container=F.col("package"), path=F.col("path"), kind=F.col("kind"), visibility=F.col("visibility"), activity=N.activity({"direct_calls": o % 5, "reads": o % 3}), locals_=("local", "field"))
    best = symbols(spark, sf_dir).select("symbol_id", "path", "qualified_name", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "path", "qualified_name", "symbol_id").limit(25)
    return best.select("symbol_id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "path", "qualified_name", "symbol_id")).alias("place"))


@query(f"""with q(asked) as (values ('sym:3'), ('small_ring'), ('economy::brand2::small_ring'), ('no_such')),
m as (select asked, symbol_id, case when symbol_id = asked or lower(qualified_name) = asked then 0 when lower(name) = asked then 1 when lower(qualified_name) like '%::' || replace(asked, '_', '!_') escape '!' then 2 end tier from q join ({SYMBOLS}) on symbol_id = asked or lower(qualified_name) = asked or lower(name) = asked or lower(qualified_name) like '%::' || replace(asked, '_', '!_') escape '!'),
t as (select asked, tier, count(*) n, min(symbol_id) one from m group by all), u as (select asked, min(tier) tier from t where n = 1 group by 1), e as (select distinct asked from m)
select q.asked, case when u.asked is not null then 'resolved' when e.asked is not null then 'ambiguous' else 'missing' end status, t.one symbol_id from q left join u on u.asked = q.asked left join e on e.asked = q.asked left join t on t.asked = q.asked and t.tier = u.tier""")
def seed_disambiguation(spark, sf_dir):
    return candidates.disambiguate(symbols(spark, sf_dir), ["sym:3", "small_ring", "economy::brand2::small_ring", "no_such"])


@query(f"""with {AROUND}, h1 as (select distinct neighbor, edge_type from a where node in ('nation:3', 'part:7')), h2 as (select distinct neighbor, edge_type from a where node in (select neighbor from h1) and node not in ('nation:3', 'part:7')),
s as (select neighbor, 100.0::double + case edge_type when 'CONTAINS' then 1.6::double when 'CALLS' then 1.2::double when 'REFERENCES' then 0.8::double else 0.5::double end score from h1
union all select neighbor, 100.0::double + case edge_type when 'CONTAINS' then 1.6::double when 'CALLS' then 1.2::double when 'REFERENCES' then 0.8::double else 0.5::double end - 0.35::double from h2)
select neighbor, round(max(score), 6) score from s group by 1""")
def graph_expansion(spark, sf_dir):
    found = candidates.expand(relational_edges(spark, sf_dir), seeds(spark, "nation:3", "part:7"), base=100.0, depth=2)
    return found.select("neighbor", F.round("score", 6).alias("score"))


@query(f"""with s as (select statement, container, key, writes, row_number() over (partition by container, key order by ts, statement) k from ({STATEMENTS}))
select 'stmt:' || statement src, 'key:' || container || ':' || key dst, t edge_type from s, (values ('READS'), ('REFS'), ('WRITES'), ('DEFINES')) v(t)
where case t when 'WRITES' then writes and k > 1 when 'DEFINES' then writes and k = 1 else true end union all select 'user:' || container, 'stmt:' || statement, 'CONTAINS' from s""")
def edges_statements(spark, sf_dir):
    rows = statements(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("container", "key").orderBy("ts", "statement"))
    held = rows.withColumn("k", first)
    target = F.array(F.concat_ws(":", F.lit("key"), F.col("container").cast("string"), F.col("key").cast("string")))
    fields = {"READS": target, "REFS": target, "WRITES": F.when(F.col("writes") & (F.col("k") > 1), target), "DEFINES": F.when(F.col("writes") & (F.col("k") == 1), target)}
    out = candidates.field_edges(held, F.concat(F.lit("stmt:"), F.col("statement").cast("string")), fields)
    inside = rows.select(F.concat(F.lit("user:"), F.col("container").cast("string")).alias("src"), F.concat(F.lit("stmt:"), F.col("statement").cast("string")).alias("dst"), F.lit("CONTAINS").alias("edge_type"))
    return out.unionAll(inside)


@query(f"""with u as (select container, key, min(ts) first_ts, min(statement) s from ({STATEMENTS}) group by all), w as (select distinct container, key from ({STATEMENTS}) where writes)
select container, string_agg(key::varchar, ',' order by key) refs, (select coalesce(string_agg(key::varchar, ',' order by key), '') from w where w.container = u.container) writes, count(*) n_refs from u group by container""")
def semantic_targets(spark, sf_dir):
    rows = statements(spark, sf_dir)
    sets = rows.groupBy("container").agg(F.array_sort(F.collect_set("key")).alias("refs"), F.array_sort(F.collect_set(F.when(F.col("writes"), F.col("key")))).alias("writes"))
    shown = lambda c: F.array_join(F.transform(c, lambda k: k.cast("string")), ",")
    return sets.select("container", shown("refs").alias("refs"), shown("writes").alias("writes"), F.size("refs").cast("long").alias("n_refs"))


@query(f"""with d as (select *, case kind when 'signup' then 1 when 'error' then -1 else 0 end step from ({STATEMENTS})),
r as (select *, sum(step) over (partition by container order by ts, statement)::bigint run from d)
select statement, container, greatest(run - least(0, min(run) over (partition by container order by ts, statement)), 0)::bigint depth from r""")
def nesting_depth(spark, sf_dir):
    step = F.when(F.col("kind") == "signup", 1).when(F.col("kind") == "error", -1).otherwise(0)
    return candidates.nesting(statements(spark, sf_dir).withColumn("step", step), by=["container"], order=["ts", "statement"], step="step").select("statement", "container", "depth")


@query(f"""select 'repo:code' node_id, 'repo' kind, 'code' as name union all select 'dir:.', 'directory', '.' union all select distinct 'dir:' || array_to_string(string_split(path, '/')[1:k], '/'), 'directory', array_to_string(string_split(path, '/')[1:k], '/') from ({SYMBOLS}), generate_series(1, 5) g(k) where k < len(string_split(path, '/'))
union all select distinct 'pkg:' || package, 'package', package from ({SYMBOLS}) union all select distinct 'file:' || path, 'file', path from ({SYMBOLS}) union all select symbol_id, kind, name from ({SYMBOLS})
union all select 'test:' || symbol_id, 'test', name from ({SYMBOLS}) where starts_with(path, 'tests/')""")
def graph_nodes(spark, sf_dir):
    return candidates.nodes(symbols(spark, sf_dir), "code")


@query(f"""with r as ({REFERENCES}), e as (select 'order:' || ref_id src, expr, case form when 0 then 'call' when 1 then 'use' else 'path' end kind, ref_id % 10 = 0 test from r)
select src, 'ref:' || expr dst, t edge_type from e, (values ('CALLS'), ('USES'), ('USES_TYPE'), ('TESTS')) v(t) where case t when 'CALLS' then kind = 'call' when 'USES' then kind <> 'call' when 'USES_TYPE' then kind = 'use' else test end""")
def edges_references(spark, sf_dir):
    kind = F.when(F.col("form") == 0, "call").when(F.col("form") == 1, "use").otherwise("path")
    refs = references(spark, sf_dir).select(F.concat(F.lit("order:"), F.col("ref_id").cast("string")).alias("src"), F.concat(F.lit("ref:"), "expr").alias("dst"), kind.alias("kind"), (F.col("ref_id") % 10 == 0).alias("test"))
    return candidates.reference_edges(refs)


@query(r"""select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('&''a mut ' || p_type || '<Vec<' || p_brand || '>, u' || p_size || '>', '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), '^[&\s]+(''\w+\s+)?', ''), '^(mut|dyn)\s+', '')) plain from part""")
def type_names(spark, sf_dir):
    text = F.concat(F.lit("&'a mut "), F.col("p_type"), F.lit("<Vec<"), F.col("p_brand"), F.lit(">, u"), F.col("p_size").cast("string"), F.lit(">"))
    return read(spark, sf_dir, "part").select("p_partkey", T.plain_type(text).alias("plain"))


@query(f"""with a as (select qualified_name, symbol_id, kind, start_line, end_line, 0 provider from ({SYMBOLS}) where ord % 3 <> 0 union all select qualified_name, 'ts:' || ord, kind, start_line - 1, end_line + 4, 1 from ({SYMBOLS}) where ord % 2 = 0)
select qualified_name, arg_min(symbol_id, (provider, symbol_id)) symbol_id, min(start_line)::int start_line, max(end_line)::int end_line, count(distinct provider) providers from a group by 1""")
def merged_providers(spark, sf_dir):
    s = symbols(spark, sf_dir)
    one = s.filter("ord % 3 <> 0").select("qualified_name", "symbol_id", "kind", "start_line", "end_line", F.lit(0).alias("provider"))
    two = s.filter("ord % 2 = 0").select("qualified_name", F.concat(F.lit("ts:"), F.col("ord").cast("string")).alias("symbol_id"), "kind", (F.col("start_line") - 1).alias("start_line"), (F.col("end_line") + 4).alias("end_line"), F.lit(1).alias("provider"))
    return candidates.merge_providers(one.unionByName(two, allowMissingColumns=True))


@query(f"""with c as (select symbol_id, path, (ord % 50) - 0.002::double * ord score from ({SYMBOLS}) where ord < 1000), r as (select *, row_number() over (partition by path order by score desc, symbol_id) k from c)
select symbol_id, path, round(score, 6) score from r where k <= 4 order by round(score, 6) desc, symbol_id limit 50""")
def diverse_units(spark, sf_dir):
    o = F.col("ord")
    c = symbols(spark, sf_dir).filter("ord < 1000").select("symbol_id", "path", (o % 50 - 0.002 * o).alias("score"))
    capped = ranking.top(c, 4, F.desc("score"), F.asc("symbol_id"), by=["path"]).select("symbol_id", "path", F.round("score", 6).alias("score"))
    return ranking.top(capped, 50, F.desc("score"), F.asc("symbol_id"))


