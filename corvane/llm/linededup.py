"""Removal of lines that spread over many sites.

A line's hash gets a HyperLogLog sketch of the sites it occurs on; sketches merge by aggregation, first within a
task and then across tasks, so a hot line or site sends one record from each task. Hashes whose estimate lies near
the threshold get an exact distinct count. A line on ``min_sites`` sites or more is boilerplate: its first occurrence
(by id, then by place) stays and every other one goes. Lines of fewer than ``min_words`` words stand on many sites by
chance, so of these ``short_sites`` sites are asked.

Lines are compared without the white space around them; blank ones are left alone.

Defined cases: null and empty texts are empty and stay as they are; a null site is a site of its own; rows alike in id
and text are one document repeated, and all of them get the same result; a null id comes after all others; an empty
table gives an empty result; columns other than the id, text and site are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.storage import fresh, materialise

MIN_SITES, MIN_WORDS, SHORT_SITES = 3, 5, 10
#: White space around lines.
BLANKS = " \t\n\x0b\f\r"
#: Estimates from ``threshold * NEAR[0]`` up to ``threshold * NEAR[1]`` are near it.
NEAR = (0.5, 2.0)
LG_K = 10


def occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_words: int) -> DataFrame:
    """``doc, version, pos, hi, lo, short, site``: all lines but blank ones; two hashes name a line."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    site = F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit(""))
    lines = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("version"), site.alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).filter("line <> ''")
    short = ~F.col("line").rlike(rf"^(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{min_words - 1}}}[^\x20\x09-\x0D]")
    # a second hash that does not follow from the first
    return lines.select("doc", "version", "pos", "site", short.alias("short"), F.xxhash64("line").alias("hi"), F.xxhash64(F.reverse("line"), F.lit(1)).alias("lo"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, short_sites: int = SHORT_SITES) -> DataFrame:
    """``hi, lo, first``: the lines on enough sites; first is ``struct<last, doc, version, pos>``."""
    at = F.struct(F.col("doc").isNull().alias("last"), "doc", "version", "pos")
    asked = F.when(F.col("short"), short_sites).otherwise(min_sites)
    spread = lines.groupBy("hi", "lo", "short").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(at).alias("first"), F.count("*").alias("n"))
    spread = spread.filter(F.col("n") >= asked).select("hi", "lo", "first", asked.alias("asked"), F.hll_sketch_estimate("sketch").alias("sites"))
    spread = materialise(spread.filter(F.col("sites") >= F.col("asked") * NEAR[0]), "spread")
    near = spread.filter(F.col("sites") <= F.col("asked") * NEAR[1])
    pairs = lines.join(near.select("hi", "lo"), ["hi", "lo"], "left_semi").select("hi", "lo", "site").distinct()
    exact = pairs.groupBy("hi", "lo").agg(F.count("*").alias("n"))
    sure = spread.filter(F.col("sites") > F.col("asked") * NEAR[1]).select("hi", "lo", "first")
    return sure.unionByName(near.join(exact, ["hi", "lo"]).filter(F.col("n") >= F.col("asked")).select("hi", "lo", "first"))


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS,
    short_sites: int = SHORT_SITES, lines_col: str = "n_lines", removed_col: str = "n_removed",
) -> DataFrame:
    """``docs`` with the text that stays, and the numbers of its lines and of those removed (long).

    Null ids are told apart by their texts alone. A column that is already named as one of these numbers is an error.
    """
    for name in (lines_col, removed_col):
        if name.lower() in {c.lower() for c in docs.columns}:
            raise ValueError(f"documents have a column {name}: name another one for the number of lines")
    lines = materialise(occurrences(docs, id_col, text_col, site_col, min_words), "lines")
    flagged = boilerplate(lines, min_sites, short_sites)
    same = F.struct(F.col("doc").isNull().alias("last"), "doc", "version", "pos") != F.col("first")
    gone = lines.join(flagged, ["hi", "lo"]).filter(same).groupBy("doc", "version").agg(F.collect_set("pos").alias("gone"))
    # names that no column of the documents has
    d, v, g, kept = (fresh(docs, f"line_{x}") for x in ("doc", "version", "gone", "text"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    gone = gone.select(F.col("doc").alias(d), F.col("version").alias(v), F.map_from_arrays("gone", F.transform("gone", lambda _: F.lit(True))).alias(g))
    both = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(v)), "left")
    split = F.split(text, "\n")
    numbered = F.transform(split, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    stays = F.transform(F.filter(numbered, lambda s: ~F.map_contains_key(g, s["i"])), lambda s: s["x"])
    done = F.when(F.col(g).isNull(), F.col(text_col)).otherwise(F.concat_ws("\n", stays))
    out = both.withColumns({kept: done, lines_col: F.size(split).cast("long"), removed_col: F.coalesce(F.size(g), F.lit(0)).cast("long")})
    return out.withColumn(text_col, F.col(kept)).drop(d, v, g, kept)


ORACLE = rf"""with l as (select doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) line,
 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from documents),
t as (select *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') k from l),
c as (select *, not regexp_matches(k, '^([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{MIN_WORDS - 1}}}[^\x20\x09-\x0D]') short from t where k <> ''),
b as (select k from c group by k having count(distinct coalesce('s' || source, '')) >= case when bool_or(short) then {SHORT_SITES} else {MIN_SITES} end),
r as (select doc_id, pos, row_number() over (partition by k order by doc_id nulls last, pos) rn from c join b using (k)),
g as (select doc_id, pos from r where rn > 1),
s as (select t.doc_id, t.pos, t.line, g.pos is not null gone from t left join g on t.doc_id = g.doc_id and t.pos = g.pos)
select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text, count(*) n_lines, count(*) filter (gone) n_removed from s group by doc_id"""
