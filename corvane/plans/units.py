"""Queries of retrieval units, their vectors, and encodings of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import numbers as N
from corvane.functions import text as T
from corvane.operators import lexical, ranking, units
from corvane.plans.registry import QUERIES, SYMBOLS, query, read, sql_tokens, symbols
from corvane.tables import spread

_PIECES = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"


@query(f"""with t as (select doc_id, text, {_PIECES} x from documents where text is not null),
w as (select doc_id, k ordinal, array_to_string(x[k * 64 + 1:k * 64 + 128], ' ') unit from t, generate_series(0, 400) g(k) where len(x) > 128 and k <= ceil((len(x) - 128) / 64.0)
union all select doc_id, 0, text from t where len(x) <= 128 and length(text) <= 10000)
select doc_id::varchar || ':unit:' || ordinal || ':' || substr(sha1(doc_id::varchar || chr(0) || ordinal || chr(0) || unit), 1, 16) unit_id, doc_id, ordinal::int ordinal, sha1(unit) unit_sha1, length(unit)::int chars from w""")
def chunk_units_token_windows(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter("text is not null")
    cut = docs.select("doc_id", F.posexplode(units.token_windows(F.col("text"), 128)).alias("ordinal", "unit"))
    return cut.select(N.unit_id(F.col("doc_id").cast("string"), F.col("ordinal"), F.col("unit")).alias("unit_id"), "doc_id", "ordinal", F.sha1("unit").alias("unit_sha1"), F.length("unit").alias("chars"))


@query("""select doc_id, k::int part, sha1(trim(substr(text, k * 900 + 1, 1000))) part_sha1 from documents, generate_series(0, 400) g(k)
where text is not null and k <= ceil(greatest(length(text) - 1000, 0) / 900.0) and trim(substr(text, k * 900 + 1, 1000)) <> ''""")
def chunk_units_chars(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter("text is not null")
    cut = docs.select("doc_id", F.posexplode(units.char_windows(F.col("text"), 1000, 900)).alias("part", "x"))
    return cut.select("doc_id", "part", F.sha1("x").alias("part_sha1"))


def chunk_units_lines(spark, sf_dir):
    """Units of documents as code, prose and plain text in turn."""
    kind = F.element_at(F.array(*map(F.lit, ("file", "doc", "symbol", "function_body"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return units.build(read(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.col("text").alias("content")))


QUERIES["chunk_units_lines"] = chunk_units_lines

_TERMS = f"(select doc_id, unnest({sql_tokens('text')}) term from documents)"


@query(f"select term, count(distinct doc_id) df, count(*) tf from {_TERMS} group by 1")
def token_df(spark, sf_dir):
    return units.document_frequency(read(spark, sf_dir, "documents"), "text")


@query(f"select doc_id, (('0x' || substr(sha1(term), 1, 8))::bigint % 256)::bigint dim, count(*) weight from {_TERMS} group by all")
def hash_dimension_tf(spark, sf_dir):
    # hashing in generated code costs less than counting words first, and at most 256 rows of a document are sent
    words = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return words.groupBy("doc_id", N.dimension(F.col("term")).alias("dim")).agg(F.count("*").alias("weight"))


_VECTORS = f"""tf as (select doc_id, term, count(*) tf from {_TERMS} group by all), df as (select term, ln(((select count(*) from documents) + 1.0::double) / (count(*) + 1)) + 1 idf, ('0x' || substr(sha1(term), 1, 8))::bigint % 256 dim from tf group by 1),
s as (select doc_id, dim::bigint dim, sum(tf * idf) w from tf join df using (term) group by all), v as (select doc_id, dim, w / sqrt(sum(w * w) over (partition by doc_id)) weight from s)"""


@query(f"with {_VECTORS} select doc_id, dim, round(weight, 6) weight from v")
def hash_dimension_tfidf(spark, sf_dir):
    vectors = units.hashed_vectors(read(spark, sf_dir, "documents"), "doc_id", "text")
    return vectors.select("doc_id", F.explode("vector").alias("dim", "w")).select("doc_id", "dim", F.round("w", 6).alias("weight"))


_Q = {k: v for k, v in sorted(units.query_vector(["the", "thing", "der", "des", "tion"]).items())}


@query(f"""with {_VECTORS}, q(dim, qw) as (values {', '.join(f'({k}, {v!r}::double)' for k, v in _Q.items())})
select doc_id, round(sum(weight * qw), 6) score from v join q using (dim) group by 1 having sum(weight * qw) > 0 order by score desc, doc_id limit 20""")
def embedding_search(spark, sf_dir):
    vectors = units.hashed_vectors(read(spark, sf_dir, "documents"), "doc_id", "text")
    scored = vectors.select("doc_id", units.sparse_dot(F.col("vector"), _Q).alias("sim")).filter("sim > 0")
    return ranking.top(scored.select("doc_id", F.round("sim", 6).alias("score")), 20, F.desc("score"), F.asc("doc_id"))


@query(f"""with q as (select distinct unnest({sql_tokens('text')}) term from benchmark where item_id = 0),
d as (select doc_id, {sql_tokens('text')} toks from documents), s as (select count(*)::double n, avg(len(toks)) a from d),
p as (select doc_id, len(toks)::double l, unnest(toks) term from d),
tf as (select doc_id, l, term, count(*)::double tf from p where term in (select term from q) group by all),
df as (select term, count(*)::double df from tf group by 1)
select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) score
from tf join df using (term), s group by 1 order by score desc, doc_id limit 20""")
def bm25_topk(spark, sf_dir):
    asked = read(spark, sf_dir, "benchmark").filter("item_id = 0").agg(F.min("text")).first()[0]
    scored = ranking.bm25(read(spark, sf_dir, "documents"), sorted(set(lexical.words(asked or ""))), id_col="doc_id", text_col="text")
    return ranking.top(scored, 20, F.desc("score"), F.asc("doc_id"))


@query("""select vec_id, label, round(list_dot_product((select embedding from embeddings where vec_id = 0)::double[], embedding::double[]), 6) score from embeddings
where vec_id <> 0 order by score desc, vec_id limit 10""")
def vector_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    scored = ranking.similar(vectors.filter("vec_id <> 0"), "vec_id", "embedding", ranking.vector_of(vectors, "vec_id", "embedding", 0))
    return ranking.top(scored.select("vec_id", "label", F.round("sim", 6).alias("score")), 10, F.desc("score"), F.asc("vec_id"))


@query("""select label, max(round(list_dot_product((select embedding from embeddings where vec_id = 0)::double[], embedding::double[]), 6)) score, count(*) passages from embeddings group by 1""")
def vector_maxp(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    scored = ranking.similar(vectors, "vec_id", "embedding", ranking.vector_of(vectors, "vec_id", "embedding", 0))
    return scored.groupBy("label").agg(F.max(F.round("sim", 6)).alias("score"), F.count("*").alias("passages"))


@query("""select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) norm, round(list_sum(list_transform(list_transform(embedding::double[], lambda x: x * 3), lambda x: x * x)) / 9, 6) square from embeddings""")
def vector_norms(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = N.normalised(v)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(N.norm(v) / 3, 6).alias("norm"), F.round(N.dot(v, v) / 9, 6).alias("square"))


@query(f"""select symbol_id, '{{"name":"' || name || '","path":"' || path || '","start_line":' || start_line || '}}' as payload, case when starts_with(symbol_id, 'sym:') then symbol_id end described, sha1(path || '|' || start_line) fingerprint from ({SYMBOLS})""")
def node_payloads(spark, sf_dir):
    node = F.col("symbol_id")
    return symbols(spark, sf_dir).select(
        "symbol_id", F.to_json(F.struct("name", "path", "start_line")).alias("payload"), F.when(node.startswith("sym:"), node).alias("described"), F.sha1(F.concat_ws("|", "path", "start_line")).alias("fingerprint")
    )


@query("select event_id, (props->>'$.k')::bigint k, '{\"k\":' || (props->>'$.k') || '}' as encoded from events")
def json_props_extract(spark, sf_dir):
    decoded = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return decoded.select("event_id", "p.k", F.to_json("p").alias("encoded"))


@query("""with f as (select source, sha1(string_agg(doc_id || ':' || n_chars, chr(10) order by doc_id)) fingerprint, count(*) n from documents group by 1) select * from f""")
def artifact_fingerprints(spark, sf_dir):
    rows = F.sort_array(F.collect_list(F.struct("doc_id", F.concat_ws(":", "doc_id", "n_chars").alias("t"))))
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.sha1(F.array_join(F.transform(rows, lambda r: r["t"]), "\n")).alias("fingerprint"), F.count("*").alias("n"))
