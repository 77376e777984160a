"""Queries of the functions on text, names and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import numbers as N
from corvane.functions import text as T
from corvane.plans.registry import FILES, STATEMENTS, SYMBOLS, files, query, read, sql_tokens, statements, symbols


@query(f"select doc_id, len(t)::int n_tokens, sha1(array_to_string(t, ' ')) tokens_sha1 from (select doc_id, {sql_tokens('text')} t from documents)")
def tokenize_tokens(spark, sf_dir):
    toks = read(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return toks.select("doc_id", F.size("t").alias("n_tokens"), F.sha1(F.array_join("t", " ")).alias("tokens_sha1"))


@query(rf"""with t as (select file_id, {sql_tokens("regexp_replace(path, '([^/])[.][^./]*$', chr(92) || '1')")} x from ({FILES})),
u as (select file_id, unnest(x) w, generate_subscripts(x, 1) i from t), f as (select file_id, w, min(i) i from u group by all),
r as (select *, row_number() over (partition by file_id order by i) n from f)
select file_id, string_agg(w, ' ' order by n) terms from r where n <= 8 group by 1""")
def path_terms(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", F.array_join(T.path_terms(F.col("path")), " ").alias("terms"))


@query(r"""select symbol_id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(n, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: t <> ''), ' ') terms
from (select 'sym:' || p_partkey symbol_id, p_type || '::' || p_name || 'HTTPServer2Go' n from part)""")
def identifier_terms(spark, sf_dir):
    name = F.concat(F.col("p_type"), F.lit("::"), F.col("p_name"), F.lit("HTTPServer2Go"))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("sym:"), F.col("p_partkey").cast("string")).alias("symbol_id"), F.array_join(T.identifier_terms(name), " ").alias("terms"))


_ONE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"""select doc_id, case when length(o) > 180 then rtrim(substr(o, 1, 177)) || '...' else o end preview, substr(o, 1, 240) unit_preview
from (select doc_id, {_ONE} o from documents)""")
def preview_text(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.preview(text).alias("preview"), T.unit_preview(text).alias("unit_preview"))


@query(r"""select doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::int tokens,
greatest(len(string_split(regexp_replace(coalesce(text, ''), '\n$', ''), chr(10))), 1)::int lines, length(trim(regexp_replace(text, '\s+', ' ', 'g')))::int collapsed from documents""")
def token_estimates(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(text).alias("tokens"), T.line_count(text).alias("lines"), F.length(T.collapse(text)).alias("collapsed"))


@query(f"""select symbol_id, lower(qualified_name) = 'brand2::small_ring' or lower(qualified_name) like '%::brand2::small!_ring' escape '!'
 or '::' || lower(qualified_name) || '::' like '%::brand2::small!_ring::%' escape '!' whole, '::' || lower(qualified_name) || '::' like '%::brand4::%' segment from ({SYMBOLS})""")
def name_matches(spark, sf_dir):
    s, name = symbols(spark, sf_dir), F.col("qualified_name")
    return s.select("symbol_id", T.name_matches(name, F.lit("Brand2::small_ring")).alias("whole"), T.name_matches(name, F.lit("brand4")).alias("segment"))


@query(f"""with t as (select symbol_id, list_filter(string_split_regex(regexp_replace(path, '[.]rs$', ''), '[/]'), lambda t: t <> '') || [kind]
 || case when starts_with(path, 'tests/') then ['test'] else [] end || case when kind = 'impl' then ['impl'] else [] end x, kind from ({SYMBOLS})),
u as (select symbol_id, kind, unnest(x) w, generate_subscripts(x, 1) i from t), f as (select symbol_id, kind, w, min(i) i from u group by all)
select symbol_id, string_agg(w, ' ' order by i) tags, case when kind in ('fn', 'function', 'method') then 'function_body' when kind in ('struct', 'enum', 'trait', 'impl', 'type') then 'type_body' end body_kind
from f group by symbol_id, kind""")
def symbol_tags(spark, sf_dir):
    s = symbols(spark, sf_dir)
    return s.select("symbol_id", F.array_join(T.symbol_tags(F.col("path"), F.col("kind"), F.col("path").startswith("tests/")), " ").alias("tags"), T.body_kind(F.col("kind")).alias("body_kind"))


@query("select doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) lines from documents where text is not null")
def line_slice(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", T.line_slice(F.col("text"), F.lit(2), F.lit(4)).alias("lines"))


@query(r"""select conv_id, turn, sha1(trim(regexp_replace(lower(text), '[^a-z0-9_:/.\-]+', ' ', 'g'))) answer_sha1,
lower(regexp_replace(trim('  ././Src/' || role || '.rs '), '^(\./)+', '')) path_key from conversations""")
def answer_keys(spark, sf_dir):
    path = F.concat(F.lit("  ././Src/"), F.col("role"), F.lit(".rs "))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha1(T.answer_key(F.col("text"))).alias("answer_sha1"), T.path_key(path).alias("path_key"))


@query(rf"""select symbol_id, regexp_matches('/' || path || '/', '/(generated|gen|dist|target|vendor)/') or regexp_matches(path, '(\.pb\.rs|_pb2\.py|_grpc\.py)$') generated,
case regexp_extract(path, '[^/]\.([^./]+)$', 1) when 'rs' then 'Rust' else 'Other' end as language, regexp_extract(path, '[^/]\.([^./]+)$', 1) extension from ({SYMBOLS})""")
def file_predicates(spark, sf_dir):
    path = F.col("path")
    return symbols(spark, sf_dir).select("symbol_id", T.generated(path).alias("generated"), T.language(path).alias("language"), T.extension(path).alias("extension"))


@query(f"select container, sha1(string_agg(kind || ':' || key, chr(10) order by ts, statement)) body_hash, count(*) n from ({STATEMENTS}) group by 1")
def body_hash(spark, sf_dir):
    rows = statements(spark, sf_dir).groupBy("container").agg(F.sort_array(F.collect_list(F.struct("ts", "statement", F.concat_ws(":", "kind", "key").alias("text")))).alias("rows"), F.count("*").alias("n"))
    return rows.select("container", F.sha1(F.array_join(F.transform("rows", lambda r: r["text"]), "\n")).alias("body_hash"), "n")


@query(r"""select 'doc:' || substr(sha1(doc_id || '|' || coalesce(source, '')), 1, 16) stable_id, doc_id,
round(greatest(0, least(1, n_chars / 5000.0::double)), 3) confidence from documents""")
def stable_ids(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select(N.stable_id("doc", F.col("doc_id").cast("string"), F.coalesce("source", F.lit(""))).alias("stable_id"), "doc_id", N.confidence(F.col("n_chars") / F.lit(5000.0)).alias("confidence"))
