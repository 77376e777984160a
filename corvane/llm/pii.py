"""Personal data: base patterns, and identifiers that contexts bootstrapped from them disclose.

All of it is DataFrame functions. Base matches of a kind (leftmost, non-overlapping) that are words of their own are the
seeds of that kind; what is assigned to a name like ``token`` or ``password`` is a seed of the kind ``secret``. Seeds
induce lexical patterns: the shape of a word, its shape after the word before it, and the three words or signs before it. In each
round a pattern's confidence in a kind is the share of it that its instances' beliefs make up, against what contradicts
it (matches that failed their kind's check, instances of other kinds), and a little of what is unknown. An instance not
known before believes in a kind as its patterns do together; those sure enough count for their patterns in the next
round, until nothing changes. Every occurrence of such an instance is a span of its kind.

Defined cases: null and empty texts have no spans; rows alike in id and text are one document repeated; ties between
kinds go to the one listed first; an empty table gives an empty result; columns other than the id and text are not
looked at. The work grows with a text's length, also of one long word or of matches alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.storage import discard, materialise

#: What stands for a dot between the letters of names, and for a sign between digits, where they are one.
JOINT = "\x05"
#: The base patterns, in the order of kinds, as they match a text whose joints are marked. Loops of single
#: characters, possessive where what follows cannot be part of them, need no stack; a match begins where no longer one
#: could, so a long run that is no match is read once.
PATTERNS = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+{JOINT}-]))[A-Za-z0-9._%+{JOINT}-]++@[A-Za-z0-9-]++{JOINT}[A-Za-z0-9{JOINT}-]++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": rf"[0-9][0-9{JOINT}]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Joints of a kind, and what a text must hold for a match of a kind to be possible.
JOINTS = {"email": r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "card": r"(?<=[0-9])[\x20-](?=[0-9])"}
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){12}", "phone": r"\+[0-9]", "word": "[0-9@]"}
KINDS = (*PATTERNS, "secret")
#: Kinds whose matches that fail their check speak against what looks like them.
CHECKED = ("ip", "card")
#: What may be an identifier (a run of its characters with a digit or at sign), and what a secret follows.
CANDIDATE = r"(?<![A-Za-z0-9._@%+-])(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9._@%+-]++"
ASSIGNED = r"(?i)(?:token|secret|api[_-]?key|passw(?:or)?d|credential)[\x22\x27]?\s*[:=]\s*[\x22\x27]?$"
ROUNDS, SUPPORT, CONFIDENCE, UNKNOWN = 4, 5, 0.7, 0.1
#: Matches whose places are added up together, and most rows of a table that is broadcast.
CHUNK, BROADCAST_ROWS = 256, 1_000_000


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether digits pass Luhn's check."""
    back = F.transform(F.sequence(F.lit(1), F.length(x)), lambda k: F.substring(F.reverse(x), k, F.lit(1)).cast("int"))
    added = F.transform(back, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(added, F.lit(0), lambda s, d: s + d) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(digits(x)).between(12, 19) & F.when(F.length(digits(x)).between(12, 19), luhn(digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(digits(x)).between(9, 15)
    return F.lit(True)


def starts(steps: Column) -> Column:
    """Where each match starts: sums of ``gap`` and ``len`` before it.

    They are added up chunk by chunk, so an array is copied as often as there are chunks, not matches.
    """
    none = F.array().cast("array<int>")

    def step(s, p):
        at = s["at"] + p["gap"]
        return F.struct((at + p["len"]).alias("at"), F.concat(s["out"], F.array(at)).alias("out"))

    def chunk(s, c):
        done = F.aggregate(F.slice(steps, c * CHUNK + 1, CHUNK), F.struct(s["at"].alias("at"), none.alias("out")), step)
        return F.struct(done["at"].alias("at"), F.concat(s["out"], F.array(done["out"])).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), first, chunk)["out"])


def matched(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``docs`` (``doc_id, version, text``) with, for each pattern, its matches and the gaps around and starts of them.

    Most texts have none and are not split.
    """
    plain = F.translate("text", JOINT, " ")
    source = {k: F.regexp_replace(plain, JOINTS[k], JOINT) if k in JOINTS else plain for k in patterns}
    nothing = F.array().cast("array<string>")
    read = docs.select("*", *[F.when(F.col("text").rlike(NEEDED[k]), source[k]).alias(f"t_{k}") for k in patterns])
    found = read.select("*", *[F.coalesce(F.regexp_extract_all(f"t_{k}", F.lit(p), F.lit(0)), nothing).alias(f"m_{k}") for k, p in patterns.items()])
    split = found.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split(f"t_{k}", p, -1)).otherwise(nothing).alias(f"g_{k}") for k, p in patterns.items()])
    step = lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"))
    # columns of their own, which expressions read twice: so they are worked out once
    steps = split.select("*", *[F.zip_with(F.slice(f"g_{k}", 1, F.size(f"m_{k}")), f"m_{k}", step).alias(f"l_{k}") for k in patterns])
    return steps.select("*", *[F.when(F.size(f"m_{k}") > 0, starts(F.col(f"l_{k}"))).otherwise(F.array().cast("array<int>")).alias(f"s_{k}") for k in patterns])


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, version``, an array of spans of each base kind, and ``words`` that may be identifiers."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    every = matched(keyed, {**PATTERNS, "word": CANDIDATE})
    spans = {k: F.zip_with(f"s_{k}", f"m_{k}", lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("stop"), m.alias("match"))) for k in PATTERNS}
    passes = {k: (lambda kind: lambda x: valid(kind, x["match"]))(k) for k in PATTERNS}
    # the texts of matches, which may be long, go no further
    ends = lambda found: F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    good = {k: ends(F.filter(spans[k], passes[k])).alias(k) for k in PATTERNS}
    failed = {k: ends(F.filter(spans[k], (lambda fine: lambda x: ~fine(x))(passes[k]))).alias(f"no_{k}") for k in CHECKED}
    # a word without the signs around it, the three words or signs before it and its own place
    core = lambda m: F.regexp_replace(m, r"^[._@%+-]++|[._@%+-]++$", "")
    lead = lambda m: F.length(F.regexp_extract(m, r"^[._@%+-]*+", 0))
    tail = lambda g: F.lower(F.regexp_extract(F.right(g, F.lit(64)), r"((?:\S*\s*){3})$", 1))
    words = F.transform("m_word", lambda m, i: F.struct((F.get("s_word", i) + lead(m)).alias("start"), core(m).alias("word"), tail(F.get("g_word", i)).alias("before")))
    flat = every.select("doc_id", "version", *good.values(), *failed.values(), F.filter(words, lambda w: F.length(w["word"]) > 3).alias("words"))
    # the span of each kind that a word could touch: the first that ends after the word starts
    met = lambda w: F.array(*[first_after(F.col(c), w["start"]) for c in (*PATTERNS, *(f"no_{k}" for k in CHECKED))])
    hits = F.transform("words", lambda w: F.named_struct(F.lit("w"), w, F.lit("stop"), w["start"] + F.length(w["word"]), F.lit("hits"), met(w)))
    return flat.withColumn("words", F.transform(hits, judged)).drop(*(f"no_{k}" for k in CHECKED))


def first_after(spans: Column, at: Column) -> Column:
    """Of ordered spans that do not overlap, the first that ends after ``at``, found by halving; null if none does."""
    steps = F.when(F.size(spans) > 0, F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))).otherwise(F.array().cast("array<int>"))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        later = (s["lo"] < s["hi"]) & (F.get(spans, mid)["stop"] <= at)
        return F.struct(F.when(later, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(later, s["hi"]).otherwise(mid).alias("hi"))

    return F.get(spans, F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve)["lo"])


def judged(x: Column) -> Column:
    """A word with its seed's kind, whether a base span touches it, and whether it is a match that failed its check."""
    start, stop = x["w"]["start"], x["stop"]
    hit = [F.get(x["hits"], k) for k in range(len(PATTERNS) + len(CHECKED))]
    same = [F.coalesce((h["start"] == start) & (h["stop"] == stop), F.lit(False)) for h in hit]
    whole = F.coalesce(*[F.when(yes, k) for yes, k in zip(same, PATTERNS)])
    touched = reduce(lambda a, b: a | b, [F.coalesce(h["start"] < stop, F.lit(False)) for h in hit[: len(PATTERNS)]])
    secret = ~touched & x["w"]["before"].rlike(ASSIGNED) & (F.length(x["w"]["word"]) >= 8)
    kind = F.coalesce(whole, F.when(secret, "secret"))
    against = reduce(lambda a, b: a | b, same[len(PATTERNS) :])
    return F.named_struct(F.lit("start"), start, F.lit("stop"), stop, F.lit("word"), x["w"]["word"], F.lit("before"), x["w"]["before"], F.lit("kind"), kind, F.lit("touched"), touched, F.lit("contrary"), against & kind.isNull())


def shape(word: Column) -> Column:
    """A word's shape: how many digits in a row, and letters as one sign; a long hexadecimal number as its length alone."""
    hexa = word.rlike("^[0-9a-fA-F]{16,}$") & word.rlike("[a-fA-F]")
    plain = F.regexp_replace(F.regexp_replace(word, "[0-9]", "9"), "[A-Za-z]+", "a")
    return F.when(hexa, F.concat(F.lit("x"), F.length(word).cast("string"))).otherwise(F.substring(plain, 1, 48))


def occurrences(found: DataFrame) -> DataFrame:
    """``doc_id, version, start, stop, word, kind, contrary, patterns`` of words that may be identifiers.

    ``kind`` is that of a seed. Words that base spans touch but are not are left out.
    """
    rows = found.select("doc_id", "version", F.inline("words")).filter(F.col("kind").isNotNull() | ~F.col("touched"))
    last = F.regexp_extract(F.rtrim("before"), r"(\S+)$", 1)
    patterns = F.array(F.concat(F.lit("shape "), shape(F.col("word"))), F.concat(F.lit("after "), last, F.lit(" shape "), shape(F.col("word"))), F.concat(F.lit("context "), "before"))
    return rows.select("doc_id", "version", "start", "stop", "word", "kind", "contrary", patterns.alias("patterns"))


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= most else table


def bootstrap(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``word, kind, belief``: instances that were no seeds and that patterns disclose. ``found`` is as ``occurrences``."""
    pairs = found.select("word", "kind", "contrary", F.explode("patterns").alias("pattern"))
    # a frequent word or pattern is one row of each task
    edges = materialise(pairs.groupBy("pattern", "word").agg(F.max("kind").alias("kind"), F.max("contrary").alias("contrary")), "graph")
    news = None
    for _ in range(rounds):
        # seeds are in the edges themselves: only what earlier rounds disclosed is joined
        known = edges.withColumn("sure", F.col("kind").isNotNull().cast("double"))
        if news is not None:
            told = small(news).select("word", F.col("kind").alias("told"), "belief")
            known = edges.join(told, "word", "left").select("pattern", "word", F.coalesce("kind", "told").alias("kind"), "contrary", F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("belief", F.lit(0.0))).alias("sure"))
        share = [F.sum(F.when(F.col("kind") == k, F.col("sure")).otherwise(0.0)).alias(f"b_{k}") for k in KINDS]
        scored = known.groupBy("pattern").agg(*share, F.count_if(F.col("contrary") & F.col("kind").isNull()).alias("against"), F.count_if(F.col("kind").isNull() & ~F.col("contrary")).alias("open"), F.count_if(F.col("kind").isNotNull()).alias("support"))
        total = reduce(lambda a, b: a + b, [F.col(f"b_{k}") for k in KINDS]) + F.col("against") + UNKNOWN * F.col("open") + 0.5
        order = F.array(*[F.struct((F.col(f"b_{k}") / total).alias("sure"), F.lit(-at).alias("at"), F.lit(k).alias("kind")) for at, k in enumerate(KINDS)])
        best = scored.filter(F.col("support") >= support).select("pattern", F.array_max(order).alias("b")).select("pattern", F.col("b.kind").alias("of"), F.col("b.sure").alias("sure"))
        kept = materialise(best.filter(F.col("sure") >= confidence), "patterns")
        reached = edges.filter(F.col("kind").isNull() & ~F.col("contrary")).join(small(kept), "pattern").groupBy("word", "of").agg((1 - F.exp(F.sum(F.log(1 - F.least("sure", F.lit(0.999)))))).alias("belief"))
        place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("of"))
        later = reached.groupBy("word").agg(F.max_by("of", F.struct("belief", (-place).alias("at"))).alias("kind"), F.max("belief").alias("belief"))
        later = materialise(later, "instances")
        same = news is not None and later.count() == news.count() and later.join(news, ["word", "kind"], "left_anti").isEmpty()
        discard(kept)
        if news is not None:
            discard(news)
        news = later
        if same:
            break
    discard(edges)
    return news


def written(kinds: tuple[str, ...], more: Column | None = None) -> Column:
    """Spans as kind:start:end by start, then kind as listed, joined by commas; ``more`` are such of given kinds."""

    def placed(order: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("a"), F.lit(order).alias("o"), s["stop"].alias("b"), F.lit(kind).alias("k")))

    every = [placed(order, kind) for order, kind in enumerate(kinds)]
    if more is not None:
        every.append(F.transform(more, lambda s: F.struct(s["start"].alias("a"), (F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]) - 1).cast("int").alias("o"), s["stop"].alias("b"), s["kind"].alias("k"))))
    return F.array_join(F.transform(F.array_sort(F.concat(*every)), lambda s: F.concat_ws(":", s["k"], s["a"], s["b"])), ",")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_spans`` of every row.

    The first four numbers and the hash are of base spans; ``n_found`` counts the spans that seeds of secrets and
    bootstrapped patterns add.
    """
    found = materialise(marked(docs, id_col, text_col), "marked")
    seen = materialise(occurrences(found).distinct(), "occurrences")
    news = bootstrap(seen)
    told = seen.filter(F.col("kind").isNull() & ~F.col("contrary")).drop("kind").join(small(news).select("word", "kind"), "word")
    added = told.select("doc_id", "version", "start", "stop", "kind").unionByName(seen.filter("kind = 'secret'").select("doc_id", "version", "start", "stop", "kind"))
    added = added.groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "stop", "kind")).alias("more"))
    added = added.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "more")
    both = found.drop("words").join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    both = both.withColumn("more", F.coalesce("more", F.array().cast("array<struct<start:int,stop:int,kind:string>>")))
    base = tuple(PATTERNS)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    total = reduce(lambda a, b: a + b, [F.size(k) for k in base]) + F.size("more")
    return both.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(base, F.col("more")).alias("spans"), F.size("more").cast("long").alias("n_found"), total.cast("long").alias("n_spans"))
