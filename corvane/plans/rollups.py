"""Queries of rollups, summaries and measures of retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import evaluation, ranking, rollup
from corvane.plans.registry import FILES, STATEMENTS, SYMBOLS, files, query, read, statements, symbols


@query(f"""with f as (select path, size, string_split(path, '/') x from ({FILES})),
e as (select '.' prefix, size from f union all select array_to_string(x[1:k], '/'), size from f, generate_series(1, 12) g(k) where k < len(x))
select prefix, count(*) files, sum(size)::bigint bytes, max(size) largest from e group by 1""")
def path_prefix_rollup(spark, sf_dir):
    return rollup.by_ancestor(files(spark, sf_dir), "path", F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))


@query(rf"""select coalesce(nullif(lower(regexp_extract(path, '[^/]\.([^./]+)$', 1)), ''), '-') extension, case lower(regexp_extract(path, '[^/]\.([^./]+)$', 1)) when 'html' then 'HTML' else 'Other' end as language,
count(*) files, sum(size)::bigint bytes from ({FILES}) group by all""")
def extension_rollup(spark, sf_dir):
    path = F.col("path")
    ending = F.when(T.extension(path) == "", "-").otherwise(T.extension(path))
    return files(spark, sf_dir).groupBy(ending.alias("extension"), T.language(path).alias("language")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(f"select path, size from ({FILES}) order by size desc, path limit 20")
def largest_files(spark, sf_dir):
    return ranking.top(files(spark, sf_dir).select("path", "size"), 20, F.desc("size"), F.asc("path"))


@query(f"""with k as (select package, kind, count(*) n, min(ord) seen from ({SYMBOLS}) group by all), r as (select *, row_number() over (partition by package order by n desc, seen, kind) rank from k),
m as (select package, path, row_number() over (partition by package order by path) i from (select distinct package, path from ({SYMBOLS}))),
t as (select package, count(distinct path) files, count(*) symbols, count(*) filter (starts_with(visibility, 'pub')) public from ({SYMBOLS}) group by 1)
select t.*, (select string_agg(path, ',' order by i) from m where m.package = t.package and i <= 8) modules, (select string_agg(kind || '=' || n, ',' order by rank) from r where r.package = t.package and rank <= 4) kinds from t""")
def package_summary(spark, sf_dir):
    return rollup.package_rollup(symbols(spark, sf_dir), "package")


@query("""select user_id, event_type, n, rank::int rank from (select *, row_number() over (partition by user_id order by n desc, seen, event_type) rank
from (select user_id, event_type, count(*) n, min(event_id) seen from events group by all)) where rank <= 2""")
def top_kinds_per_group(spark, sf_dir):
    return rollup.most_common(read(spark, sf_dir, "events"), ["user_id"], "event_type", F.col("event_id"), 2).select("user_id", "event_type", "n", "rank")


@query(f"""select container, string_agg(statement::varchar, ',' order by k) opening from (select *, row_number() over (partition by container order by ts, statement) k from ({STATEMENTS})) where k <= 8 group by 1""")
def sample_first_n(spark, sf_dir):
    first = rollup.first_n(statements(spark, sf_dir), ["container"], "statement", ["ts", "statement"], 8)
    return first.select("container", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("opening"))


@query("""select event_type, list_sort(list(value))[count(*) // 2 + 1] upper_median, max(value) most, count(*) n from events where value is not null group by 1""")
def upper_median_latency(spark, sf_dir):
    return rollup.upper_median(read(spark, sf_dir, "events"), "event_type", "value")


@query("""select coalesce(l_returnflag, 'all') as mode, count(*) runs, count(*) filter (l_discount > 0.05) hits, round(coalesce(avg(l_quantity), 0), 3) mean_quantity, round(coalesce(avg(case when l_tax > 0.04 then l_tax end), 0), 3) mean_tax
from lineitem group by grouping sets ((l_returnflag), ())""")
def mode_summary(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    per = lines.rollup("l_returnflag").agg(F.count("*").alias("runs"), F.count_if(F.col("l_discount") > 0.05).alias("hits"), rollup.mean3(F.col("l_quantity")).alias("mean_quantity"), rollup.mean3(F.when(F.col("l_tax") > 0.04, F.col("l_tax"))).alias("mean_tax"))
    return per.select(F.coalesce("l_returnflag", F.lit("all")).alias("mode"), "runs", "hits", "mean_quantity", "mean_tax")


@query(f"""with s as (select package, kind, count(*) n from ({SYMBOLS}) group by all) select package, sum(n)::bigint total, coalesce(sum(n) filter (kind = 'function'), 0)::bigint functions, coalesce(sum(n) filter (kind = 'struct'), 0)::bigint structs,
count(*) kinds from s group by 1""")
def probe_counts(spark, sf_dir):
    s = symbols(spark, sf_dir).groupBy("package", "kind").agg(F.count("*").alias("n"))
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    return s.groupBy("package").agg(F.sum("n").alias("total"), of("function").alias("functions"), of("struct").alias("structs"), F.count("*").alias("kinds"))


@query("select event_type, count(*) calls, round(sum(value), 3) total, round(avg(value), 3) mean, max(value) most from events group by 1")
def telemetry_timings(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 3).alias("total"), F.round(F.avg("value"), 3).alias("mean"), F.max("value").alias("most"))


@query(f"""with f as (select path, count(*) n, count(distinct kind) kinds, arg_min(name, (ord)) first_name from ({SYMBOLS}) group by 1)
select path, 'File ' || path || ' has ' || n || ' symbols of ' || kinds || ' kinds, first ' || first_name || '.' summary, case when n > 1 then 'parsed' else 'shallow' end confidence from f""")
def file_summary(spark, sf_dir):
    f = symbols(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"), F.min_by("name", "ord").alias("first_name"))
    return f.select("path", F.format_string("File %s has %d symbols of %d kinds, first %s.", "path", "n", "kinds", "first_name").alias("summary"), F.when(F.col("n") > 1, "parsed").otherwise("shallow").alias("confidence"))


@query(f"""with e as (select '.' prefix, ord, kind, name from ({SYMBOLS}) union all select array_to_string(string_split(path, '/')[1:k], '/'), ord, kind, name from ({SYMBOLS}), generate_series(1, 5) g(k) where k < len(string_split(path, '/'))),
k as (select prefix, kind, count(*) n, min(ord) seen from e group by all), r as (select *, row_number() over (partition by prefix order by n desc, seen, kind) rank from k),
f as (select prefix, name, row_number() over (partition by prefix order by ord) i from e)
select prefix, count(*) symbols, (select string_agg(kind, ',' order by rank) from r where r.prefix = e.prefix and rank <= 3) kinds, (select string_agg(name, ',' order by i) from f where f.prefix = e.prefix and i <= 3) names from e group by prefix""")
def directory_summary(spark, sf_dir):
    up = symbols(spark, sf_dir).withColumn("prefix", F.explode(T.path_prefixes(F.col("path"))))
    totals = up.groupBy("prefix").agg(F.count("*").alias("symbols"))
    kinds = rollup.most_common(up, ["prefix"], "kind", F.col("ord"), 3).groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct("rank", "kind"))).alias("k"))
    names = rollup.first_n(up, ["prefix"], "name", ["ord"], 3)
    joined = totals.join(kinds, "prefix").join(names, "prefix")
    return joined.select("prefix", "symbols", F.array_join(F.transform("k", lambda r: r["kind"]), ",").alias("kinds"), F.array_join("values", ",").alias("names"))


@query(f"""with l as (select case lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) when 'html' then 'HTML' else 'Other' end as lang, count(*) n from ({FILES}) group by 1)
select 'Repository of ' || (select count(*) from ({FILES})) || ' files: ' || (select string_agg(lang || ' ' || n, ', ' order by n desc, lang) from l) || '; ' || (select count(*) from ({SYMBOLS})) || ' symbols.' summary""")
def project_summary(spark, sf_dir):
    langs = files(spark, sf_dir).groupBy(T.language(F.col("path")).alias("lang")).agg(F.count("*").alias("n"))
    # a row for each language, of which there are few
    rows = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "lang", "n")))
    one = langs.agg(F.sum("n").alias("files"), F.array_join(F.transform(rows, lambda r: F.concat_ws(" ", r["lang"], r["n"].cast("string"))), ", ").alias("mix"))
    total = symbols(spark, sf_dir).agg(F.count("*")).first()[0]
    return one.select(F.format_string(f"Repository of %d files: %s; {total} symbols.", "files", "mix").alias("summary"))


_RUNS = "with d as (select doc_id, source case_id, row_number() over (partition by source order by n_chars desc, doc_id) rank from documents), q as (select doc_id, source case_id from documents join labels using (doc_id) where quality = 1)"


@query(f"""{_RUNS}, e as (select case_id, count(distinct doc_id)::double expected from q group by 1), h as (select d.case_id, rank, (q.doc_id is not null)::int rel from d left join q using (doc_id) where rank <= 10),
m as (select case_id, sum(rel) filter (rank <= 1) r1, sum(rel) filter (rank <= 3) r3, sum(rel) filter (rank <= 5) r5, sum(rel) r10, min(rank) filter (rel = 1) first_rank, sum(rel / log2(rank + 1)) dcg, count(*) n from h group by 1)
select case_id, round(r1 / expected, 3) recall_at_1, round(r3 / expected, 3) recall_at_3, round(r5 / expected, 3) recall_at_5, round(r10 / expected, 3) recall_at_10, first_rank::int first_rank, round(coalesce(1.0::double / first_rank, 0), 3) mrr,
round(dcg / (select sum(1 / log2(i + 1)) from generate_series(1, 10) g(i) where i <= least(expected, n)), 3) ndcg from m join e using (case_id)""")
def recall_mrr_ndcg(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    runs = ranking.top(docs.select(F.col("source").alias("case_id"), "doc_id", "n_chars"), 10, F.desc("n_chars"), F.asc("doc_id"), by=["case_id"])
    wanted = docs.select(F.col("source").alias("case_id"), "doc_id").join(labels.filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return evaluation.measures(runs, wanted, case="case_id", item="doc_id", most=10)


@query(r"""with a as (select conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9_:/.\-]+', ' ', 'g')) x from conversations where role = 'assistant'),
f as (select *, (contains(x, 'the') or contains(x, 'de'))::int path_hit, starts_with(x, 'a')::int top_hit, contains(x, 'er')::int name_hit, len(list_filter(['the', 'of', 'und', 'que'], lambda t: contains(x, t))) / 4.0::double terms from a)
select conv_id, turn, round(terms, 3) coverage, round(0.35::double * path_hit + 0.35::double * name_hit + 0.2::double * terms + 0.1::double * top_hit, 3) quality,
round(0.3::double * path_hit + 0.2::double * name_hit + 0.2::double * terms + 0.1::double * top_hit, 3) bundle, round(0.35::double * path_hit + 0.25::double * name_hit + 0.2::double * top_hit + 0.2::double * terms, 3) external_score from f""")
def answer_scores(spark, sf_dir):
    answers = read(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", T.answer_key(F.col("text")).alias("x"))
    x = F.col("x")
    terms = evaluation.coverage(x, ("the", "of", "und", "que"))
    path, name, top = x.contains("the") | x.contains("de"), x.contains("er"), x.startswith("a")
    return answers.select(
        "conv_id", "turn", F.round(terms, 3).alias("coverage"), evaluation.answer_quality(path, name, terms, top).alias("quality"),
        evaluation.bundle_score(path, name, terms, top, F.lit(False), F.lit(False)).alias("bundle"), evaluation.external_score(path, name, top, terms).alias("external_score"),
    )


@query(r"""select conv_id, sum(len(string_split_regex(trim(text), '\s+')))::bigint prepared_tokens, count(distinct role) roles from conversations group by 1""")
def prepared_tokens(spark, sf_dir):
    return evaluation.prepared(read(spark, sf_dir, "conversations"), "conv_id", "text").join(read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.countDistinct("role").alias("roles")), "conv_id")


@query("""with c as (select item_id, trim(text) query, case when item_id % 3 = 0 then '' else 'path/' || item_id end expected from benchmark)
select item_id, 'case-' || item_id as name, query, expected <> '' scored, coalesce(nullif(expected, ''), '-') expected_path from c where query <> ''""")
def eval_cases(spark, sf_dir):
    raw = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"), F.when(F.col("item_id") % 3 == 0, "").otherwise(F.concat(F.lit("path/"), F.col("item_id").cast("string"))).alias("expected_path"))
    return evaluation.normalised_cases(raw).select("item_id", "name", "query", "scored", "expected_path")


@query(f"""select container, statement, gap from (select container, statement, round((epoch_us(ts) - epoch_us(lag(ts) over (partition by container order by ts, statement))) / 1e6, 3) gap from ({STATEMENTS})) where gap is not null order by gap desc, statement limit 10""")
def slowest_steps(spark, sf_dir):
    w = Window.partitionBy("container").orderBy("ts", "statement")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = statements(spark, sf_dir).select("container", "statement", F.round((micros - F.lag(micros).over(w)) / 1e6, 3).alias("gap")).filter("gap is not null")
    return ranking.top(gaps, 10, F.desc("gap"), F.asc("statement"))
