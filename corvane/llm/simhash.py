"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, verified Hamming distance, components.

Words are runs without ASCII white space of the text with A-Z lower-cased; shingles are ``shingle`` words joined by
a space, repeats included (the whole sequence if the text has fewer words); a bit is set if it is set in over half of
the shingles' XXH64 (seed 42). Distinct fingerprints are split into ``parts`` parts. Two within ``distance`` bits
agree on at least ``parts - distance`` of them, so they meet under one of the keys that such a choice of parts makes.

Defined cases: null and empty texts have fingerprint zero and are linked to each other like any others; repeated
rows have one fingerprint and one component; a null id never names a component (the component of null ids alone is
null); an empty table gives an empty result; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.storage import discard, materialise

SHINGLE, DISTANCE, PARTS, SEED = 3, 3, 5, 42
#: Fingerprints of a key that one task compares with each other; more are dealt as pairs of blocks.
BLOCK = 4096
#: Shingles whose bits are summed together.
STEP = 1 << 16


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the unsigned 64-bit hashes have each bit, from bit 0."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), STEP):
        bits = np.unpackbits(hashes[k : k + STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def shingles(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The hashes of a text's shingles, in order; none of a text without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(shingle, len(words))
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    hashes = shingles(text, shingle, seed)
    set_bits = np.flatnonzero(2 * bit_counts(hashes) > len(hashes))
    return int(np.bitwise_or.reduce(np.uint64(1) << set_bits.astype(np.uint64))) if len(set_bits) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` of every row; fp is the fingerprint as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle, seed) for t in batch.column(1).cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(of, "doc_id long, fp long")


def block_keys(fp, parts: int, distance: int):
    """An array of the keys of a fingerprint: for each choice of parts, its number and the parts' bits."""
    edges = [64 * k // parts for k in range(parts + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(parts), parts - distance)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    return F.array(*keys)


def forest(fps: np.ndarray, distance: int, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join what is within ``distance`` bits, as many as a spanning forest has, among ``fps`` (and ``other``)."""
    every = fps if other is None else np.concatenate([fps, other])
    root = np.arange(len(every))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    links = []
    across = every if other is None else other
    shift = 0 if other is None else len(fps)
    for k, fp in enumerate(fps):
        near = np.flatnonzero(np.bitwise_count(across ^ fp) <= distance) + shift
        for j in near[near > k].tolist() if other is None else near.tolist():
            a, b = top(k), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((int(every[k]), int(every[j])))
    return links


def links(distinct: DataFrame, distance: int = DISTANCE, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that have the components of all links within ``distance``.

    A key's fingerprints are compared in blocks of at most about ``block``, each pair of blocks in a group of its own.
    """
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), parts, distance)).alias("key")).select("fp", "key.choice", "key.bits")
    counts = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    counts = counts.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    shared = keyed.join(counts.select("choice", "bits", "blocks"), ["choice", "bits"])
    mine = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    shared = shared.withColumn("own", mine)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("lo"), F.greatest(k, F.col("own")).alias("hi")))
    shared = shared.select("fp", "choice", "bits", "own", F.explode(pairs).alias("pair")).select("fp", "choice", "bits", "own", "pair.lo", "pair.hi")
    dealt = shared.repartition("choice", "bits", "lo", "hi").sortWithinPartitions("choice", "bits", "lo", "hi", "own", "fp")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def joined(part: pd.DataFrame) -> list[tuple[int, int]]:
            fps, own = part["fp"].to_numpy().view(np.uint64), part["own"].to_numpy()
            if part["lo"].iat[0] == part["hi"].iat[0]:
                return forest(fps, distance)
            cut = int(np.searchsorted(own, part["hi"].iat[0]))
            return forest(fps[:cut], distance, fps[cut:])

        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            at = batch[["choice", "bits", "lo", "hi"]].to_numpy()
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            rest = batch.iloc[cuts[-1] if len(cuts) else 0 :]
            yield _linked(_runs(batch, [0, *cuts.tolist()], joined))
        if rest is not None and len(rest):
            yield _linked(joined(rest))

    return dealt.mapInPandas(compare, "a long, b long").distinct()


def _runs(batch: pd.DataFrame, cuts: list[int], joined) -> list[tuple[int, int]]:
    return [x for a, b in zip(cuts, cuts[1:]) if b - a > 1 for x in joined(batch.iloc[a:b])]


def _linked(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for all nodes of ``edges`` (``a, b``): root is the smallest node reachable.

    Alternates the large-star and small-star steps, each written to the shared folder, until nothing changes.
    """
    small = F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")
    now = materialise(edges.filter("a <> b").select(*small).distinct(), "edges")
    last = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        starred = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        step = materialise(starred.filter("u <> v").distinct(), "edges")
        # the next step's links as a number that does not depend on their order
        mark = step.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(now)
        now = step
        if mark == last:
            break
        last = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def members(prints: DataFrame, distance: int = DISTANCE, parts: int = PARTS) -> DataFrame:
    """``fp, root`` of all fingerprints ``fp`` of ``prints``; a root names the component."""
    distinct = materialise(prints.select("fp").distinct(), "distinct")
    roots = components(links(distinct, distance, parts))
    return materialise(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")), "members")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, parts: int = PARTS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "prints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    member = members(prints, distance, parts).join(least, "fp")
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    member = materialise(member.select("fp", "root").join(named, "root").select("fp", "component_id"), "named")
    return prints.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def versions(docs: DataFrame, text_col: str = "text"):
    """The XXH64 of the text, which with the id names a document."""
    return F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))


def firsts(docs: DataFrame, roots: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of ``roots`` (``version, root``); a version that is not there is a root itself.

    It is that with the smallest id, null ids last, and of equal ids that with the smallest text hash.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("__d"), versions(docs, text_col).alias("__v")).distinct()
    keyed = keyed.join(roots.select(F.col("version").alias("__v"), F.col("root").alias("__r")), "__v", "left")
    best = F.struct(F.col("__d").isNull().alias("last"), F.col("__d").alias("d"), F.col("__v").alias("v"))
    kept = keyed.groupBy(F.coalesce("__r", "__v")).agg(F.min(best).alias("__best")).select("__best.d", "__best.v")
    kept = materialise(kept.select(F.col("d").alias("__d"), F.col("v").alias("__v")), "kept")
    rows = docs.withColumns({"__id": F.col(id_col).cast("long"), "__version": versions(docs, text_col)})
    rows = rows.join(kept, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__version") == F.col("__v")), "left_semi")
    return rows.dropDuplicates(["__id", "__version"]).drop("__id", "__version")


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component (of repeated rows, one).

    Rows are told apart by id and text: null ids, or texts that share an id, stay where their components differ.
    """
    # a text's hash stands in the place of its id
    texts = docs.select(versions(docs, text_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialise(fingerprints(texts).distinct(), "prints")
    roots = prints.join(members(prints), "fp").select(F.col("doc_id").alias("version"), "root")
    return firsts(docs, roots, id_col=id_col, text_col=text_col)


__all__ = ["bit_counts", "components", "fingerprint", "fingerprints", "firsts", "forest", "links", "members", "near_duplicates", "representatives", "shingles", "versions"]
