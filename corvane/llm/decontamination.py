"""Benchmark decontamination by template canonicalisation, on DataFrame functions alone.

A text's words become a template: numbers (with their points and commas), names (runs of words capitalised inside a
sentence) and units after a number become typed placeholders, one each; other words are lower-cased. Windows of
``window`` template words of documents are hash-joined with those of benchmark items. An item's window of fewer than
``literals`` words besides placeholders is matched as it is written instead, so items of many numbers or names are
caught where they stand verbatim.

Matches on one diagonal (same distance between places) are checked for the consistency of their slots: each value of
the item stands for one value of the document, and back. A slot that contradicts one before it voids the windows that
hold it and no others. A document leaks an item if windows that are left cover ``share`` of the item's, or ``run``
words on end have them.

Defined cases: null and empty texts, and items without words, match nothing; an item of fewer than ``window`` words is
one window of its own length; one of fewer than ``literals`` words is caught only where it stands as a whole line; items
with the same words are one, named by the smallest id; rows of documents alike in id and text are one; empty tables give
an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.storage import discard, fresh, materialise

WINDOW, LITERALS, SHARE, RUN = 8, 5, 0.5, 13
#: Most distinct benchmark windows (of about 30 bytes) that are broadcast; more are joined by shuffling.
BROADCAST_WINDOWS = 1_000_000
#: Units that are placeholders after a number.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "min", "h", "days", "hours", "minutes", "seconds", "percent", "miles", "feet", "dollars", "euros")
#: Marks before a name and a unit, between the words of a name, and for the point or comma of a number.
NAME, UNIT, GLUE, POINT = "\x01", "\x02", "\x03", "\x04"
TEMPLATE, VERBATIM, LINE = 0, 1, 2


def words(text: Column) -> Column:
    """Lower-cased words; names and units bear a mark in front, the words of a name one between them."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), NAME + UNIT + GLUE + POINT, "    ")
    glued = F.regexp_replace(plain, r"\x20(?=\p{Lu}\p{Ll})(?<=[^.!?\s]\x20\p{Lu}\p{Ll}{1,24}\x20)", GLUE)
    named = F.regexp_replace(glued, r"(?<=[^.!?\s]\x20)(?=\p{Lu}\p{Ll})", NAME)
    whole = F.regexp_replace(named, r"(?<=[0-9])[.,](?=[0-9])", POINT)
    united = F.regexp_replace(whole, rf"(?<=[0-9]\x20)(?=(?i:{'|'.join(UNITS)})\b)", UNIT)
    return F.filter(F.split(F.lower(united), r"[^\p{L}\p{N}\x01-\x04]+"), lambda t: t != "")


def slot(word: Column) -> Column:
    """Whether a word is a placeholder; the marks and digits, and nothing else that begins a word, come before a colon."""
    return word < ":"


def canonical(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    return F.when(~slot(word), word).when(first.isin(NAME, UNIT), first).otherwise("0")


def verbatim(word: Column) -> Column:
    return F.translate(word, NAME + UNIT, "")


def hashed_windows(toks: Column, size: int, kind: int) -> Column:
    """``size, kind, pos, h`` of all windows of ``size`` hashed words, from 0; none if there are fewer words."""
    places = F.when(F.size(toks) >= size, F.sequence(F.lit(1), F.size(toks) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.struct(F.lit(size).alias("size"), F.lit(kind).alias("kind"), (k - 1).alias("pos"), F.xxhash64(F.slice(toks, k, size)).alias("h")))


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int, literals: int) -> tuple[DataFrame, DataFrame]:
    """``item_id, toks`` of distinct items, and ``item_id, size, kind, pos, h`` of all their windows."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), words(F.col(text_col)).alias("toks")).filter(F.size("toks") > 0)
    items = items.groupBy(F.transform("toks", verbatim).alias("plain"), "toks").agg(F.min("item_id").alias("item_id")).select("item_id", "toks", "plain")
    # of items that differ in marks alone, the first; a null id comes last
    items = items.groupBy("plain").agg(F.min_by(F.struct("item_id", "toks"), F.coalesce("item_id", F.lit((1 << 63) - 1))).alias("i")).select("i.item_id", "i.toks")
    sized = items.withColumn("size", F.least(F.size("toks"), F.lit(window)))
    placed = sized.select("item_id", "size", "toks", F.explode(F.sequence(F.lit(0), F.size("toks") - F.col("size"))).alias("pos"))
    placed = placed.withColumn("part", F.slice("toks", F.col("pos") + 1, F.col("size")))
    plain = F.size(F.filter("part", lambda t: ~slot(t)))
    kind = F.when(F.col("size") < literals, LINE).when(plain >= literals, TEMPLATE).otherwise(VERBATIM)
    h = F.when(kind == TEMPLATE, F.xxhash64(F.transform("part", lambda t: F.xxhash64(canonical(t))))).otherwise(F.xxhash64(F.transform("part", lambda t: F.xxhash64(verbatim(t)))))
    return items, placed.select("item_id", "size", kind.alias("kind"), "pos", h.alias("h"))


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, literals: int = LITERALS, share: float = SHARE, run: int = RUN,
) -> DataFrame:
    """``doc_id, version, item_id, covered, item_windows``: what documents leak; version is the XXH64 of the text."""
    items, own = item_windows(benchmark, item_col, item_text_col, window, literals)
    items, own = materialise(items, "items"), materialise(own, "item-windows")
    kinds = sorted(tuple(r) for r in own.select("kind", "size").distinct().collect())  # at most three kinds of ``window`` sizes
    numbers = own.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    wanted = own.select("kind", "size", "h").distinct()
    if wanted.count() <= BROADCAST_WINDOWS:
        wanted = F.broadcast(wanted)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    toks = keyed.select("doc_id", "version", "text", words(F.col("text")).alias("toks"))
    hashed = {TEMPLATE: F.transform("toks", lambda t: F.xxhash64(canonical(t))), VERBATIM: F.transform("toks", lambda t: F.xxhash64(verbatim(t)))}
    arrays = toks.select("doc_id", "version", "text", *[hashed[k].alias(f"h{k}") for k in (TEMPLATE, VERBATIM) if k in {kind for kind, _ in kinds}])
    made = [hashed_windows(F.col(f"h{kind}"), size, kind) for kind, size in kinds if kind != LINE]
    if any(kind == LINE for kind, _ in kinds):
        # a line's words are those of the line alone
        lines = F.transform(F.split("text", "\n"), lambda x: words(x))
        made.append(F.transform(lines, lambda x, k: F.struct(F.size(x).alias("size"), F.lit(LINE).alias("kind"), k.alias("pos"), F.xxhash64(F.transform(x, lambda t: F.xxhash64(verbatim(t)))).alias("h"))))
    if not made:
        made = [F.array().cast("array<struct<size:int,kind:int,pos:int,h:long>>")]
    # all windows of a text in one scan; of theirs only those of any item go on, and only then meet the items that share them
    met = arrays.select("doc_id", "version", F.inline(F.concat(*made))).join(wanted, ["kind", "size", "h"], "left_semi")
    met = materialise(met.select("doc_id", "version", "kind", "size", F.col("pos").alias("dpos"), "h"), "met")
    both = met.join(own.withColumnRenamed("pos", "ipos"), ["kind", "size", "h"])
    # a line is found where it is: it has no diagonal to check
    shift = F.when(F.col("kind") == LINE, F.lit(None)).otherwise(F.col("dpos") - F.col("ipos"))
    lines = materialise(both.groupBy("doc_id", "version", "item_id", "size", shift.alias("shift")).agg(F.array_sort(F.collect_set("ipos")).alias("places")), "lines")

    ids = lines.filter("shift is not null").select(F.col("doc_id").alias("d"), F.col("version").alias("v")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))
    texts = keyed.join(ids, same, "left_semi").dropDuplicates(["doc_id", "version"])
    texts = texts.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), words(F.col("text")).alias("dtoks"))
    found = lines.filter("shift is not null").join(texts, same).drop("d", "v").join(items.select(F.col("item_id").alias("i"), "toks"), F.col("item_id").eqNullSafe(F.col("i")))
    inside = lambda p: F.exists("places", lambda w: (w <= p) & (p < w + F.col("size")))
    pairs = F.transform("toks", lambda t, p: F.struct(p.alias("p"), t.alias("i"), F.get("dtoks", (p + F.col("shift")).cast("int")).alias("d")))
    near = F.filter("toks_at", lambda x: x["d"].isNotNull() & slot(x["i"]) & slot(x["d"]) & inside(x["p"]))
    # ``shift`` may be negative at the opening of an item that a document has cut off: no word is there
    found = found.withColumn("toks_at", pairs).withColumn("slots", near)
    clash = lambda x, q: (q["p"] < x["p"]) & (((q["i"] == x["i"]) & (q["d"] != x["d"])) | ((q["d"] == x["d"]) & (q["i"] != x["i"])))
    found = found.withColumn("bad", F.transform(F.filter("slots", lambda x: F.exists("slots", lambda q: clash(x, q))), lambda x: x["p"]))
    good = F.filter("places", lambda w: ~F.exists("bad", lambda b: (w <= b) & (b < w + F.col("size"))))
    kept = found.select("doc_id", "version", "item_id", F.explode(good).alias("place"))
    kept = kept.unionAll(lines.filter("shift is null").select("doc_id", "version", "item_id", F.explode("places").alias("place"))).distinct()
    covered = kept.groupBy("doc_id", "version", "item_id").agg(F.count("*").alias("covered"))
    joined = covered.join(numbers.withColumnRenamed("item_id", "i"), F.col("item_id").eqNullSafe(F.col("i"))).drop("i")
    enough = F.least(F.ceil(F.col("item_windows") * share), F.lit(run - window + 1))
    out = materialise(joined.filter(F.col("covered") >= enough).select("doc_id", "version", "item_id", "covered", "item_windows"), "leaks")
    for done in (items, own, met, lines):
        discard(done)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that leak nothing; other columns stay as they are."""
    d, v = fresh(docs, "leak_doc"), fresh(docs, "leak_version")
    bad = leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias(d), F.col("version").alias(v)).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(v)), "left_anti")
