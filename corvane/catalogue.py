"""All registered queries, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators.ranking import top
from corvane.plans import code, graphs, ranking, resolution, rollups, texts, units  # noqa: F401  (they register their queries)
from corvane.plans.registry import ORACLES, QUERIES, query, read

__all__ = ["ORACLES", "QUERIES"]


@query("select doc_id, sha1(text) content_sha1, length(text)::bigint chars from documents")
def content_fingerprint(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("content_sha1"), F.length("text").cast("long").alias("chars"))


@query("select sha1(text) content_sha1, count(*) copies, min(doc_id) first_id from documents group by 1 having count(*) > 1")
def duplicate_content(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.sha1("text").alias("content_sha1")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query("select event_type, count(*) n, count(distinct user_id) users from events group by 1")
def count_by_kind(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("select l_partkey, l_suppkey from (select distinct l_partkey, l_suppkey from lineitem) where l_partkey not in (select l_partkey from lineitem where l_discount > 0.09)")
def anti_missing(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return lines.select("l_partkey", "l_suppkey").distinct().join(lines.filter("l_discount > 0.09").select("l_partkey"), "l_partkey", "left_anti")


@query("select doc_id from documents intersect select doc_id from labels")
def set_overlap(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").intersect(read(spark, sf_dir, "labels").select("doc_id"))


@query("select doc_id from documents except select doc_id from labels")
def set_difference(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").subtract(read(spark, sf_dir, "labels").select("doc_id"))


@query("""select source, doc_id, rank::int rank from (select *, row_number() over (partition by source order by n_chars desc, doc_id) rank from documents) where rank <= 4""")
def per_source_cap(spark, sf_dir):

    return top(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), 4, F.desc("n_chars"), F.asc("doc_id"), by=["source"]).drop("n_chars")
