"""Rollups over keys, folders and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T


def by_ancestor(df: DataFrame, path_col: str, *aggregates: Column) -> DataFrame:
    """``prefix`` and the aggregates of all rows below each folder, the root ``.`` included.

    Rows are first aggregated by folder where the caller can, so a folder sends one row to each ancestor.
    """
    return df.withColumn("prefix", F.explode(T.path_prefixes(F.col(path_col)))).groupBy("prefix").agg(*aggregates)


def most_common(df: DataFrame, by: Sequence[str], value: str, order: Column, n: int) -> DataFrame:
    """``by, value, n, rank``: the most frequent values of each group; of equal ones, those seen first by ``order``."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "seen", value))
    return counted.withColumn("rank", place).filter(F.col("rank") <= n).drop("seen")


def first_n(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], n: int) -> DataFrame:
    """``by, values``: the first values of each group; rows beyond the ``n``-th are cut before they meet in one array."""
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)
    rows = placed.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("place", value))).alias("rows"))
    return rows.select(*by, F.transform("rows", lambda r: r[value]).alias("values"))


def upper_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """``by, upper_median, most, n``: the value at half the number of rows, rounded down, from 0; the largest; the number.

    Values are counted first. Each group's distinct values are dealt into ranges; the ranges' totals tell which range
    holds the median, and only the values of that range are ranked. No group is one task's work.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    bounds = counted.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("most"), F.sum("n").alias("total"))
    width = (F.col("most") - F.col("low")) / 256
    part = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("low")) / width), F.lit(255))).otherwise(0).cast("int")
    dealt = counted.join(bounds, by).withColumn("part", part)
    sums = dealt.groupBy(by, "part", "most", "total").agg(F.sum("n").alias("held"))
    upto = F.sum("held").over(Window.partitionBy(by).orderBy("part"))  # at most 256 rows of a group
    at = F.floor(F.col("total") / 2) + 1
    chosen = sums.withColumn("upto", upto).filter((F.col("upto") >= at) & (F.col("upto") - F.col("held") < at)).select(by, "part", (F.col("upto") - F.col("held")).alias("before"))
    inside = dealt.join(chosen, [by, "part"]).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(by, "part").orderBy(value)))
    return inside.filter(F.col("upto") >= at).groupBy(by, "most", "total").agg(F.min(value).alias("upper_median")).select(by, "upper_median", "most", F.col("total").alias("n"))


def mean3(x: Column) -> Column:
    """The mean to three places; 0 of nothing."""
    return F.round(F.coalesce(F.avg(x), F.lit(0.0)), 3)


def package_rollup(symbols: DataFrame, by: str, kinds: int = 4, modules: int = 8) -> DataFrame:
    """Of each package its files, symbols, public symbols, first modules by name and most common kinds."""
    totals = symbols.groupBy(by).agg(F.countDistinct("path").alias("files"), F.count("*").alias("symbols"), F.count_if(F.col("visibility").startswith("pub")).alias("public"))
    # sets of a package's paths are cut to the first by name before they meet
    firsts = first_n(symbols.select(by, "path").distinct(), [by], "path", ["path"], modules).withColumnRenamed("values", "modules")
    top = most_common(symbols, [by], "kind", F.col("ord"), kinds).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", "kind", "n"))).alias("rows"))
    shown = F.transform("rows", lambda r: F.concat_ws("=", r["kind"], r["n"].cast("string")))
    return totals.join(firsts, by).join(top, by).select(by, "files", "symbols", "public", F.array_join("modules", ",").alias("modules"), F.array_join(shown, ",").alias("kinds"))
