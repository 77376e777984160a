"""Queries of lexical and vector ranking, and of what retrieval does with candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import numbers as N
from corvane.functions import text as T
from corvane.operators import lexical, ranking
from corvane.plans.registry import FILES, SYMBOLS, files, query, read, sql_tokens, symbols

FIELDS = ("searchable", "title", "path", "name", "qualified_name")


def search_docs(spark, sf_dir):
    """Symbols as search documents."""
    s = symbols(spark, sf_dir)
    title = F.concat_ws(" ", "kind", "qualified_name")
    return s.withColumn("title", title).withColumn("searchable", F.concat_ws(" ", F.lit("symbol"), "path", "name", "qualified_name", "title"))


DOCS = f"""select *, 'symbol ' || path || ' ' || name || ' ' || qualified_name || ' ' || title searchable
 from (select *, kind || ' ' || qualified_name title from ({SYMBOLS}))"""


def sql_weights(terms: list[str], where: str = "true") -> str:
    """``doc, term, weight`` of each posting as CTEs; ``docs`` are those that hold ``where``."""
    one = " union all ".join(f"select symbol_id doc, '{f}' field, {sql_tokens(f)} t from docs" for f in FIELDS)
    return f"""docs as (select * from ({DOCS}) where {where}), toks as ({one}), stats as (select field, count(*)::double n, avg(len(t)) mean from toks group by 1),
post as (select doc, field, len(t)::double l, unnest(t) term from toks), tf as (select doc, field, l, term, count(*)::double tf from post where term in {tuple(terms)} group by all),
df as (select field, term, count(*)::double df from tf group by all),
w as (select doc, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean)) weight from tf join df using (field, term) join stats using (field))"""


@query(f"with {sql_weights(['small', 'ring', 'brand3'], 'kind in (' + chr(39) + 'function' + chr(39) + ', ' + chr(39) + 'struct' + chr(39) + ') and (path = ' + chr(39) + 'src' + chr(39) + ' or starts_with(path, ' + chr(39) + 'src/' + chr(39) + '))')} select doc, round(sum(weight), 6) score from w group by 1 order by score desc, doc limit 40")
def bm25_fields_filtered(spark, sf_dir):
    docs = search_docs(spark, sf_dir).filter(F.col("kind").isin("function", "struct") & T.within(F.col("path"), F.lit("src")))
    scored = lexical.bm25(docs, ["small", "ring", "brand3"], id_col="symbol_id", fields=FIELDS)
    return ranking.top(scored.select("doc", F.round("score", 6).alias("score")), 40, F.desc("score"), F.asc("doc"))


@query(f"""with {sql_weights(['small', 'ring', 'brand3', 'economy'])}, v(variant, term) as (values (0, 'small'), (0, 'ring'), (0, 'brand3'), (0, 'economy'), (1, 'small'), (1, 'ring'), (2, 'ring'), (2, 'brand3'),
(3, 'brand3'), (3, 'economy'), (4, 'small'), (4, 'ring'), (4, 'brand3'), (5, 'ring'), (5, 'brand3'), (5, 'economy')),
s as (select variant, doc, sum(weight) score from w join v using (term) group by all), r as (select *, row_number() over (partition by variant order by round(score, 9) desc, doc) place from s)
select doc, round(max(score), 6) score, count(*) variant_hits from r where place <= 120 group by 1""")
def lexical_variants_merge(spark, sf_dir):
    found = lexical.variant_search(search_docs(spark, sf_dir), "small ring brand3 economy", id_col="symbol_id", fields=FIELDS, limit=10)
    return found.select("doc", F.round("score", 6).alias("score"), "variant_hits")


_FIRST = "+".join(f"case when contains(q, '{t}') then 16 when contains(n, '{t}') then 14 when contains(ti, '{t}') then 10 when contains(pr, '{t}') then 8 when contains(pa, '{t}') then 7 when contains(hay, '{t}') then 4 else 0 end" for t in ("small", "ring"))
_HITS = "+".join(f"contains(hay, '{t}')::int" for t in ("small", "ring"))


@query(f"""with c as (select symbol_id, kind, path, qualified_name, visibility, (ord % 7) / 2.0::double native, least((ord % 5) * 4.0::double + (ord % 3) * 1.25::double, 240) * 0.7::double activity, ord % 4 + 1 hits,
 lower(qualified_name) q, lower(name) n, lower(title) ti, 'preview of ' || lower(name) pr, lower(path) pa from ({DOCS})), h as (select *, q || ' ' || n || ' ' || ti || ' ' || pr || ' ' || pa hay from c),
s as (select *, native + case when q = 'small ring' then 180 else 0 end + case when n = 'small ring' then 150 else 0 end + case when q like '%::small ring' then 110 else 0 end
 + case when contains(ti, 'small ring') then 18 else 0 end + case when contains(pr, 'small ring') then 12 else 0 end + case when contains(pa, 'small ring') then 16 else 0 end + {_FIRST}
 + case {_HITS} when 2 then 24 when 0 then -18 else 0 end + 30 + case kind when 'trait' then 24 when 'struct' then 22 when 'enum' then 20 when 'impl' then 14 when 'method' then 6 when 'function' then 5 when 'field' then -18 when 'local' then -24 else 0 end
 + case when visibility = 'pub' then 8 else 0 end + activity * case when kind in ('struct', 'enum', 'trait') then 0.08::double when kind = 'impl' then 0.1::double when kind in ('function', 'method') then 0.14::double else 0 end
 + least(greatest(hits - 1, 0), 3) * 4 - case when kind in ('field', 'local') then 30 else 0 end score from h)
select symbol_id, round(score, 6)::double score, row_number() over (order by round(score, 6) desc, path, qualified_name, symbol_id)::int place from s qualify place <= 50""")
def lexical_feature_rerank(spark, sf_dir):
    ord_ = F.col("ord")
    score = lexical.feature_score(
        "Small ring", native=(ord_ % 7) / F.lit(2.0), kind=F.lit("symbol"), symbol_kind=F.col("kind"), name=F.col("name"), qualified=F.col("qualified_name"), title=F.col("title"),
        preview=F.concat(F.lit("preview of "), F.col("name")), path=F.col("path"), searchable=F.lit(""), visibility=F.col("visibility"),
        activity=N.activity({"direct_calls": ord_ % 5, "reads": ord_ % 3}), variant_hits=ord_ % 4 + 1,
    )
    scored = search_docs(spark, sf_dir).select("symbol_id", "path", "qualified_name", F.round(score, 6).alias("score"))
    best = scored.orderBy(F.desc("score"), "path", "qualified_name", "symbol_id").limit(50)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "path", "qualified_name", "symbol_id"))).select("symbol_id", "score", "place")


@query(f"""with s as (select 0 stage, kind, path identity, 10.0::double + ord % 7 score, 'lexical' reason, case when ord % 2 = 0 then '' else name end title from ({SYMBOLS})
union all select 1, kind, path, 9.0::double + ord % 11, case when ord % 3 = 0 then 'lexical' else 'summary' end, name from ({SYMBOLS}) where ord % 2 = 1)
select kind, identity, max(score) score, case when bool_or(reason = 'summary') then 'lexical,summary' else 'lexical' end reasons,
arg_min(title, (stage, reason, title)) filter (title <> '') title from s group by all having bool_or(stage = 0)""")
def candidate_merge(spark, sf_dir):
    s, ord_ = symbols(spark, sf_dir), F.col("ord")
    a = s.select(F.lit(0).alias("stage"), "kind", F.col("path").alias("identity"), (ord_ % 7 + 10.0).alias("score"), F.lit("lexical").alias("reason"), F.when(ord_ % 2 == 0, "").otherwise(F.col("name")).alias("title"))
    b = s.filter(ord_ % 2 == 1).select(F.lit(1).alias("stage"), "kind", F.col("path").alias("identity"), (ord_ % 11 + 9.0).alias("score"), F.when(ord_ % 3 == 0, "lexical").otherwise("summary").alias("reason"), F.col("name").alias("title"))
    merged = lexical.merge_candidates(a.unionByName(b))
    return merged.select("kind", "identity", "score", F.array_join("reasons", ",").alias("reasons"), "title")


@query(f"""with t as (select file_id, path, case when path = 'ththbo.example.com/en/1' then 0 when path = 'blog.tionsh.example.net' or starts_with(path, 'blog.tionsh.example.net/') then 1
 when contains(lower(path), 'tionsh') then 2 end tier from ({FILES})) select file_id, path, tier from t where tier = (select min(tier) from t)""")
def find_file_cascade(spark, sf_dir):
    return ranking.cascade(files(spark, sf_dir), F.col("path"), exact="ththbo.example.com/en/1", prefix="blog.tionsh.example.net", part="tionsh").select("file_id", "path", "tier")


@query(f"""with s(prefix, score) as (values ('src/economy', 30.0::double), ('src/small', 20.0::double)), l as (select symbol_id, prefix, score,
row_number() over (partition by prefix order by kind, path, qualified_name, symbol_id) - 1 i from ({SYMBOLS}) join s on path = prefix or starts_with(path, prefix || '/'))
select symbol_id, round(max(score + 12 - i * 0.35::double), 6) score from l where i < 40 group by 1""")
def positional_decay(spark, sf_dir):
    scopes = spark.createDataFrame([("src/economy", 30.0), ("src/small", 20.0)], "prefix string, score double")
    listed = ranking.scope_listing(symbols(spark, sf_dir), scopes, 40, F.col("kind"), F.col("path"), F.col("qualified_name"), F.col("symbol_id"))
    return listed.groupBy("symbol_id").agg(F.round(F.max("decayed"), 6).alias("score"))


@query(f"""select symbol_id, path, qualified_name, score, row_number() over (order by score desc, path, qualified_name, symbol_id)::int rank
from (select symbol_id, path, qualified_name, (ord % 10)::double score from ({SYMBOLS}) where kind not in ('local', 'field', 'variant') and not (kind = 'method' and visibility <> 'pub')) qualify rank <= 100""")
def visible_candidates(spark, sf_dir):
    kept = symbols(spark, sf_dir).filter(ranking.visible(F.col("kind"), F.col("visibility"))).select("symbol_id", "path", "qualified_name", (F.col("ord") % 10).cast("double").alias("score"))
    best = ranking.top(kept, 100, F.desc("score"), F.asc("path"), F.asc("qualified_name"), F.asc("symbol_id"))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path", "qualified_name", "symbol_id")))


@query(f"""select kind, path, symbol_id from ({SYMBOLS}) where path = 'src/small' or starts_with(path, 'src/small/') order by kind, path, qualified_name, symbol_id limit 30 offset 10""")
def list_documents(spark, sf_dir):
    kept = symbols(spark, sf_dir).filter(T.within(F.col("path"), F.lit("src/small")))
    return ranking.page(kept, 10, 30, F.col("kind"), F.col("path"), F.col("qualified_name"), F.col("symbol_id")).select("kind", "path", "symbol_id")


_TERM = "+".join(f"case when contains(hay, '{t}') then 8 else 0 end + case when '{t}' in (n, q) then 12 else 0 end + case when contains(lower(path), '{t}') then 6 else 0 end + case when '{t}' = kind then 6 else 0 end" for t in ("small_ring", "small", "struct"))


@query(f"""select symbol_id, score from (select symbol_id, ((case when qualified_name = 'small_ring' then 120 else 0 end) + (case when name = 'small_ring' then 100 else 0 end) + (case when q = 'small_ring' then 90 else 0 end)
 + (case when n = 'small_ring' then 75 else 0 end) + (case when contains(lower(path), 'small_ring') then 30 else 0 end) + {_TERM}
 + (case when contains(hay, 'small_ring') and contains(hay, 'small') and contains(hay, 'struct') then 20 else 0 end) + (case when visibility = 'pub' then 5 else 0 end))::double score
 from (select *, lower(qualified_name) q, lower(name) n, lower(kind || ' ' || path || ' ' || name || ' ' || qualified_name) hay from ({SYMBOLS}))) where score > 0""")
def agent_cache_scan(spark, sf_dir):
    hay = F.lower(F.concat_ws(" ", "kind", "path", "name", "qualified_name"))
    score = ranking.cache_score(
        "small_ring", ["small_ring", "small", "struct"], hay=hay, name=F.col("name"), qualified=F.col("qualified_name"), path=F.col("path"), tags=F.array("kind"), visibility=F.col("visibility")
    )
    return symbols(spark, sf_dir).select("symbol_id", score.alias("score")).filter("score > 0")


@query("""with s as (select b.label, b.vec_id, list_dot_product(a.embedding::double[], b.embedding::double[]) sim from embeddings a, embeddings b where a.vec_id = 0),
u as (select label, vec_id, round(sim + 0.03::double * (vec_id % 3) + case vec_id % 4 when 0 then 0.2::double when 1 then 0.1::double else 0 end - case when vec_id % 5 = 0 then 0.12::double else 0 end, 6) score from s where sim > 0),
r as (select *, row_number() over (partition by label order by score desc, vec_id) k from u where score > 0)
select label, max(score) score, count(*) units, string_agg(vec_id::varchar, ',' order by k) filter (k <= 3) best from r group by 1""")
def vector_units_maxp(spark, sf_dir):
    units = ranking.similar(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", ranking.vector_of(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0)).filter("sim > 0")
    n = F.col("vec_id")
    bonus = 0.03 * (n % 3) + F.when(n % 4 == 0, 0.2).when(n % 4 == 1, 0.1).otherwise(0.0) - F.when(n % 5 == 0, 0.12).otherwise(0.0)
    scored = units.withColumn("score", F.round(F.col("sim") + bonus, 6)).filter("score > 0")
    return ranking.best_units(scored, "label", "vec_id", 3).select("label", "score", "units", F.array_join("best", ",").alias("best"))


@query(f"""select symbol_id, round((ord % 50) + 40 * ((ord % 9) / 10.0::double) + 3 * (contains(hay, 'small')::int + contains(hay, 'ring')::int) + (case when q = 'small ring' then 80 when contains(q, 'small ring') then 12 else 0 end)
 + (case when n = 'small_ring' then 0 else 0 end) + 2 * (ord % 2) + case when regexp_matches(p, '/dist/|/vendor/|/node_modules/|\\.min\\.') then -8 else 0 end + case when regexp_matches(p, '/tests/|/test/|\\.snap') then -4 else 0 end - 0.002::double * ord, 6) score
from (select *, lower(qualified_name) q, lower(name) n, lower(path) p, lower(name || ' ' || qualified_name || ' ' || path) hay from ({SYMBOLS}))""")
def staged_prerank(spark, sf_dir):
    s, ord_ = symbols(spark, sf_dir), F.col("ord")
    score = ranking.prerank(
        ["small", "ring"], lexical=ord_ % 50, similarity=(ord_ % 9) / F.lit(10.0), hay=F.concat_ws(" ", "name", "qualified_name", "path"),
        fields=[F.col("qualified_name"), F.col("name"), F.col("path")], unit_hit=ord_ % 2 == 1, path=F.col("path"), rank=ord_,
    )
    return s.select("symbol_id", F.round(score, 6).alias("score"))


_TOKS = sql_tokens("text")
_SET = lambda words: f"len(list_intersect(t, {list(words)})) > 0"


@query(f"""with q as (select conv_id, turn, trim(text) x, lower(trim(text)) lo, {_TOKS} t from conversations where role = 'user'),
f as (select conv_id, turn, x, len(t) n, len(list_distinct(t)) d, {_SET(ranking.DOC_WORDS)} docs, {_SET(ranking.GRAPH_WORDS)} graph, {_SET(ranking.BODY_WORDS)} body, {_SET(lexical.STATEMENT_WORDS)} or contains(lo, '@l') stmt,
 contains(x, '/') or regexp_matches(lo, '\\.({"|".join(ranking.SUFFIXES)})$') path from q),
g as (select *, starts_with(x, 'sym:') or contains(x, '::') or (d <= 2 and not docs and not path and not stmt and not graph) sym from f),
i as (select *, case when docs or path then 'docs' when sym then 'symbol' else 'exploration' end intent from g)
select conv_id, turn, intent, docs explicit_docs, graph explicit_graph, body explicit_body, stmt explicit_statement, path explicit_path, sym explicit_symbol,
 case when docs then 'path-or-docs' when conv_id % 3 = 0 and n <= 3 then 'exact-symbol' when stmt then 'statement-query' when intent = 'exploration' then 'exploration' else 'generic' end reason,
 case when docs then false when conv_id % 3 = 0 and n <= 3 then graph when stmt then true else intent = 'exploration' or graph or conv_id % 3 = 0 end use_graph from i""")
def classify_queries(spark, sf_dir):
    asked = read(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("toks", T.tokens(F.col("text")))
    flagged = asked.select("conv_id", "turn", F.size("toks").alias("n"), F.explode(F.array(ranking.classify(F.col("text"), F.col("toks")))).alias("c")).select("conv_id", "turn", "n", "c.*")
    gate = ranking.gate({c: F.col(c) for c in flagged.columns}, exact_symbol=F.col("conv_id") % 3 == 0, exact_path=F.lit(False), tokens=F.col("n"), summaries=F.lit(True))
    return flagged.select("conv_id", "turn", "intent", "explicit_docs", "explicit_graph", "explicit_body", "explicit_statement", "explicit_path", "explicit_symbol", gate["reason"].alias("reason"), gate["use_graph"].alias("use_graph"))


@query(f"""with r as (select file_id, path, case when file_id % 2 = 0 then regexp_replace(path, '/[^/]*$', '') else path end prefix, row_number() over (order by size desc, file_id) k from ({FILES})),
f as (select prefix, min(k) k from r group by 1) select prefix, row_number() over (order by k)::int scope from f qualify scope <= 3""")
def summary_scopes(spark, sf_dir):
    ranked = files(spark, sf_dir).withColumn("kind", F.when(F.col("file_id") % 2 == 0, "file").otherwise("directory"))
    return ranking.scopes(ranked, -F.col("size"), F.col("file_id"), most=3)


@query(f"""with s(prefix) as (values ('src'), ('src/small'), ('src/small/brand2.rs'), ('tests')), j as (select symbol_id, prefix, case when path = prefix then 0 else greatest(length(path) - length(replace(path, '/', '')) - length(prefix) + length(replace(prefix, '/', '')), 1) end depth
from ({SYMBOLS}) join s on path = prefix or starts_with(path, prefix || '/')) select symbol_id, min(depth)::int depth, arg_min(prefix, (depth, prefix)) scope_prefix from j group by 1""")
def prefix_scope_join(spark, sf_dir):
    scopes = spark.createDataFrame([("src",), ("src/small",), ("src/small/brand2.rs",), ("tests",)], "prefix string")
    return ranking.nearest_scope(symbols(spark, sf_dir), scopes, "symbol_id", "path")


@query(f"""select doc_id, round(len(list_filter(['the', 'of', 'river', 'reden'], lambda t: contains(lower(coalesce(text, '')), t))) / 4.0::double, 6) relevance from documents""")
def summary_relevance(spark, sf_dir):
    terms = F.array(*map(F.lit, ("the", "of", "river", "reden")))
    return read(spark, sf_dir, "documents").select("doc_id", F.round(N.overlap(terms, F.coalesce("text", F.lit(""))) / F.lit(4.0), 6).alias("relevance"))


@query(f"""select symbol_id, 420.0::double - 20 * (row_number() over (order by symbol_id) - 1) score from ({SYMBOLS}) where lower(name) = 'small_ring' or lower(qualified_name) = 'small_ring' or lower(qualified_name) like '%::small!_ring' escape '!' qualify score > 300""")
def exact_symbols(spark, sf_dir):
    hit = (F.lower("name") == "small_ring") | (F.lower("qualified_name") == "small_ring") | F.lower("qualified_name").endswith("::small_ring")
    found = symbols(spark, sf_dir).filter(hit).select("symbol_id").orderBy("symbol_id").limit(6)
    place = F.row_number().over(Window.orderBy("symbol_id")) - 1
    return found.select("symbol_id", (F.lit(420.0) - 20.0 * place).alias("score"))
