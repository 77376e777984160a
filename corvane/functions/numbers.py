"""Column functions on ids, weights and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The weights of a symbol's semantic sets, their most and their share; marks of vendored paths and tests.
ACTIVITY = {
    "direct_calls": 4.0, "reads": 1.25, "writes": 1.25, "interprocedural_reads": 1.0, "interprocedural_writes": 1.0,
    "interprocedural_references": 0.75, "transitive_calls": 0.35,
}
ACTIVITY_MOST, ACTIVITY_SHARE = 240.0, 0.7
VENDORED, TESTS = r"/dist/|/vendor/|/node_modules/|\.min\.", r"/tests/|/test/|\.snap"
TEST_WORDS = ("test", "tests", "snap", "schema")


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and the first 16 digits of the SHA-1 of the parts, which a vertical bar divides."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))


def unit_id(doc: Column, ordinal: Column, text: Column) -> Column:
    """A retrieval unit's id: its document, its place and a hash of all three."""
    zero = F.lit("\0")
    return F.concat_ws(":", doc, F.lit("unit"), ordinal.cast("string"), F.substring(F.sha1(F.concat(doc, zero, ordinal.cast("string"), zero, text)), 1, 16))


def dimension(term: Column, dims: int = 256) -> Column:
    """A term's hashed dimension: the first 32 bits of its SHA-1, modulo ``dims``."""
    return F.pmod(F.conv(F.substring(F.sha1(term), 1, 8), 16, 10).cast("long"), F.lit(dims))


def smoothed_idf(df: Column, n: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    """A vector of length one; zeros stay zeros."""
    length = norm(v)
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; of two lengths, the longer one's rest does not count."""
    parts = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def confidence(x: Column, fallback: float = 0.5) -> Column:
    """Between 0 and 1, to three places; ``fallback`` for null."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.cast("double"), F.lit(fallback)))), 3)


def activity(sizes: dict[str, Column]) -> Column:
    """A symbol's weight by how many members its semantic sets have."""
    total = sum((F.lit(ACTIVITY[name]) * F.coalesce(n, F.lit(0)) for name, n in sizes.items()), F.lit(0.0))
    return F.least(total, F.lit(ACTIVITY_MOST)) * ACTIVITY_SHARE


def path_penalty(path: Column, asked: Column) -> Column:
    """What a vendored path, and one of tests where none of the words asked is about tests, takes off a score."""
    low, words = F.lower(path), F.array(*[F.lit(w) for w in TEST_WORDS])
    return F.when(low.rlike(VENDORED), -8.0).otherwise(0.0) + F.when(low.rlike(TESTS) & ~F.arrays_overlap(asked, words), -4.0).otherwise(0.0)


def overlap(terms: Column, text: Column) -> Column:
    """How many of the terms a text holds as parts of it."""
    low = F.lower(text)
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


def exact_boost(asked: Column, fields: list[Column]) -> Column:
    """80 for each field that equals the query, 12 for each other one that holds it."""
    one = lambda f: F.when(F.lower(f) == asked, 80.0).when(F.contains(F.lower(f), asked), 12.0).otherwise(0.0)
    return sum((one(f) for f in fields), F.lit(0.0))
