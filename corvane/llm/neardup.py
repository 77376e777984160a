"""The near-duplicate stage of the SimHash operator: texts whose sets of five-word shingles have a Jaccard of 0.8 or more.

First come the links of SimHash: 64-bit fingerprints of the five-word shingles, which meet in the pigeonhole's blocks, are
verified by their Hamming distance and then by whole sets. But at a Jaccard of 0.8 a bit differs with probability 0.15,
some 10 of 64, and no split of the fingerprint has blocks that such pairs must share and others rarely do. So for the
pairs beyond the distance there is an exact way, and the pigeonhole is applied to the shingle sets themselves: sets of n and m members that are similar share at least 4/5 of either, so of the first ``n // 5 + 1`` of one
and ``m // 5 + 1`` of the other, in an order common to all, one is the same. Texts meet under such a member (a block);
the pairs that meet are verified by the Hamming distance of fingerprints, and what is left by whole sets.

A set's parity fingerprint has a bit for each class of hashes, four times as many as the set has members: whether an odd number of
members is in the class. A member that one set alone has turns one bit, so the distance of similar sets is at most the
members that only one of them has, a ninth of n + m; sets of little in common differ in far more bits. Of two lengths the
longer fingerprint is folded onto the shorter one.

Texts that meet under a member are first compared with the smallest among them alone, which makes one component of most
copies. Those that meet and are not yet of one component are then compared with each other: in pairs
where few meet, in blocks of bounded size, from which only close pairs come forth, where many do; at first no more of
these than would join all texts that are close, then, when those are verified, all that are still of two components. So
no link is lost. Components are those of all links.

Defined cases: null, empty and blank texts have one set and are linked; a text of fewer words than a shingle has one
member, the whole; an empty table gives an empty result; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.lm import MIX, numbered
from corvane.llm.packing import in_chunks
from corvane.llm.simhash import components, fingerprints, firsts, versions
from corvane.llm.simhash import links as hamming_links
from corvane.llm.storage import discard, materialise, trimmed

SHINGLE = 5
#: Texts of the sample, how many of them bear a common member, and the most common members that order the sets.
SAMPLE, COMMON, ORDERED = 2000, 3, 50_000
#: Texts of a member that are compared in pairs of rows; of more, the texts of a block.
FEW, BLOCK = 8, 512
#: Bytes of text whose sets are made together.
CHUNK = 1 << 20
#: Members of all sets that a task remembers while it compares.
REMEMBERED = 1 << 20


def sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles as hashes, in ascending order."""
    words, seq, sizes = numbered(texts)
    ids, first = words[seq], np.cumsum(sizes) - sizes
    rolling = np.zeros(len(ids), np.uint64)
    for k in range(min(shingle, len(ids))):
        rolling[: len(ids) - k] = rolling[: len(ids) - k] * MIX + ids[k:]
    out = []
    for a, n in zip(first.tolist(), (sizes - 1).tolist()):
        if n >= shingle:
            found = rolling[a : a + n - shingle + 1]
        else:
            found = np.zeros(1, np.uint64)
            for x in ids[a : a + n]:
                found = found * MIX + x
        found = (found ^ (found >> np.uint64(31))) * MIX
        out.append(np.unique(found ^ (found >> np.uint64(33))))
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first members of a set in the order by count in the sample (``common``, ascending, has ``counts``), then hash."""
    size = len(found) // 5 + 1
    if not len(common):
        return found[:size]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return found[np.argsort(np.where(common[at] == found, counts[at], 0), kind="stable")[:size]]


def parities(found: np.ndarray) -> bytes:
    """The fingerprint of a set: of each class of hashes, whether an odd number of members is in it."""
    size = 1 << max(6, (4 * len(found) - 1).bit_length())
    return np.packbits((np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def distance(a: bytes, b: bytes) -> int:
    """In how many bits two fingerprints differ, the longer one folded."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum(dtype=np.int64))


def _exploded(texts: DataFrame, of) -> DataFrame:
    """``key, version, n, bits`` for each of the members that ``of`` picks from a set of n; the first alone has the bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            versions = batch.column(0).to_pylist()
            for first, some in in_chunks(batch.column(1), CHUNK):
                held = {v: (of(found), len(found), parities(found)) for v, found in zip(versions[first : first + len(some)], sets(some))}
                sizes = [len(keys) for keys, _, _ in held.values()]
                keys = np.concatenate([keys for keys, _, _ in held.values()]).view(np.int64)
                rows = [keys, np.repeat(np.array([*held], np.int64), sizes), np.repeat(np.array([n for _, n, _ in held.values()], np.int64), sizes)]
                bits = [b for size, (_, _, bits) in zip(sizes, held.values()) for b in (bits, *[None] * (size - 1))]
                yield pa.RecordBatch.from_arrays([*(pa.array(r) for r in rows), pa.array(bits, pa.binary())], ["key", "version", "n", "bits"])

    return texts.mapInArrow(trimmed(run), "key long, version long, n long, bits binary")


def possible(pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``a, b``: the ``pairs`` of versions whose fingerprints do not rule out that the texts are similar."""
    left, right = (bitmaps.select(F.col("version").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.fromiter((distance(x.as_py(), y.as_py()) for x, y in zip(batch.column(3), batch.column(5))), np.int64, len(batch))
            good = 9 * apart <= batch.column(2).to_numpy() + batch.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    return materialise(both.mapInArrow(trimmed(pick), "a long, b long"), "possible")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b``: the ``pairs`` of versions whose texts are similar."""
    ids = materialise(pairs.select(F.col("a").alias("version")).union(pairs.select("b")).distinct(), "asked")
    some = materialise(texts.join(ids, "version", "left_semi").dropDuplicates(["version"]), "texts")
    left, right = (some.select(F.col("version").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0

        def of(version: int, text: pa.Scalar) -> np.ndarray:
            nonlocal held
            if version not in known:
                if held >= REMEMBERED:
                    known.clear()
                    held = 0
                known[version] = sets([text.as_py() or b""])[0]
                held += len(known[version])
            return known[version]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            good = [similar(of(x, t), of(y, u)) for x, y, t, u in zip(a, b, *texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    out = materialise(both.mapInArrow(trimmed(compare), "a long, b long"), "links")
    discard(some)
    discard(ids)
    return out


def hashed(texts: DataFrame) -> DataFrame:
    """``a, b``: pairs of versions that have the components of all SimHash fingerprints within the operator's distance."""
    prints = materialise(fingerprints(texts, "version", shingle=SHINGLE).distinct(), "prints")
    lead = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("lead")), "leads")
    same = prints.join(lead, "fp").filter(F.col("doc_id") != F.col("lead")).select(F.col("lead").alias("a"), F.col("doc_id").alias("b"))
    left, right = (lead.select(F.col("fp").alias(c), F.col("lead").alias(f"lead_{c}")) for c in ("a", "b"))
    close = hamming_links(lead.select("fp")).join(left, "a").join(right, "b").select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b"))
    out = materialise(same.union(close).distinct(), "pairs")
    discard(prints)
    discard(lead)
    return out


def groups(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``version, root`` of the texts of ``docs`` that have a near duplicate; version is the XXH64 of the text."""
    texts = docs.select(versions(docs, text_col).alias("version"), F.col(text_col).cast("string").alias("text"))
    every = max(1, texts.count() // SAMPLE)
    sample = texts.filter(F.pmod(F.xxhash64("version"), F.lit(every)) == 0)
    often = _exploded(sample, lambda found: found).select("key", "version").distinct().groupBy("key").count().filter(F.col("count") >= COMMON)
    often = often.orderBy(F.desc("count"), "key").limit(ORDERED).toPandas()
    common = often["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[order], often["count"].to_numpy(np.int64)[order]))

    keyed = materialise(_exploded(texts, lambda found: prefix(found, *shared.value)), "prefixes")
    # of plain longs, which are summed up in a hash table: the smallest struct would have all rows sorted
    lead = keyed.groupBy("key").agg(F.min("version").alias("a"), F.min_by("n", "version").alias("m"), F.max("version").alias("last"))
    lead = materialise(lead.filter(F.col("a") != F.col("last")).select("key", "a", "m"), "leads")
    met = materialise(keyed.select("key", "version", "n").join(lead, "key").distinct(), "met")
    bitmaps = materialise(keyed.filter("bits is not null").select("version", "n", "bits").dropDuplicates(["version"]), "bitmaps")
    discard(keyed)
    near = (5 * F.col("n") >= 4 * F.col("m")) & (5 * F.col("m") >= 4 * F.col("n"))
    first = hashed(texts)
    star = met.filter((F.col("a") != F.col("version")) & near).select("a", F.col("version").alias("b")).distinct()
    star = materialise(star.join(first, ["a", "b"], "left_anti"), "pairs")
    links = materialise(verified(first, texts).union(verified(possible(star, bitmaps), texts)), "links")
    tested = materialise(first.union(star), "pairs")
    rest = _mixed(met.select("key", "version", "n"), components(links))
    # as few pairs as would join all that may be similar, closest first; when these are verified, all pairs that are left
    for sparing in (True, False):
        sizes = rest.groupBy("key").agg(F.count("*").alias("held"))
        few = rest.join(sizes.filter(F.col("held") <= FEW).select("key"), "key", "left_semi")
        other = few.select("key", F.col("version").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"))
        pairs = few.withColumnRenamed("version", "a").join(other, "key").filter((F.col("a") < F.col("b")) & (F.col("root") != F.col("other")) & near)
        pairs = materialise(pairs.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        many = rest.join(sizes.filter(F.col("held") > FEW), "key").join(bitmaps.select("version", "bits"), "version")
        found = materialise(possible(pairs, bitmaps).union(crowded(many, sparing)).distinct().join(tested, ["a", "b"], "left_anti"), "possible")
        links, tested = materialise(links.union(verified(found, texts)), "links"), materialise(tested.union(pairs).union(found), "pairs")
        roots = components(links)
        if sparing:
            rest = _mixed(rest.select("key", "version", "n"), roots)
    for done in (met, bitmaps, first, star, rest, pairs, found, links, tested):
        discard(done)
    return roots.select(F.col("node").alias("version"), "root")


def crowded(rows: DataFrame, sparing: bool = False, block: int = BLOCK) -> DataFrame:
    """``a, b``: texts of one key, but of two components, whose sizes and fingerprints do not rule out that they are similar.

    ``rows`` are ``key, version, n, root, held, bits``, with ``held`` texts of the key. They are compared where they lie
    together, in blocks of bounded size, each pair of blocks by itself: no pair that the fingerprints rule out is a row.
    If ``sparing``, of each pair of blocks only as many are given as would make one component of all that are close.
    """
    blocks = F.ceil(F.col("held") / block).cast("int")
    own = F.pmod(F.xxhash64("version"), blocks).cast("int")
    ends = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("lo"), F.greatest(k, F.col("own")).alias("hi")))
    dealt = rows.withColumn("own", own).select("key", "version", "n", "root", "bits", "own", F.explode(ends).alias("e")).select("key", "e.lo", "e.hi", "own", "version", "n", "root", "bits")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            at = np.stack([table[c].to_numpy() for c in ("key", "lo", "hi")])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield near_pairs(table.slice(a, b - a), sparing)
            rest = table.slice(cuts[-1])
        if rest is not None and len(rest):
            yield near_pairs(rest, sparing)

    return materialise(dealt.mapInArrow(trimmed(compare), "a long, b long").distinct(), "possible")


def near_pairs(rows: pa.Table, sparing: bool = False) -> pa.RecordBatch:
    """``crowded`` of one pair of blocks."""
    version, n, root, own = (rows[c].to_numpy() for c in ("version", "n", "root", "own"))
    across, lo = rows["lo"][0].as_py() != rows["hi"][0].as_py(), rows["lo"][0].as_py()
    raw = [x.as_py() for x in rows["bits"]]
    sizes = np.array([len(x) for x in raw])
    out = []
    for long in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == long)
        prints = np.frombuffer(b"".join(raw[k] for k in mine.tolist()), np.uint64).reshape(len(mine), -1)
        # sizes of similar sets differ by a quarter at most, so of shorter fingerprints those of half the length are enough
        for short in (long, long // 2):
            theirs = np.flatnonzero(sizes == short)
            if not len(theirs):
                continue
            folded = prints if short == long else np.bitwise_xor.reduce(prints.reshape(len(mine), 2, -1), axis=1)
            other = prints if short == long else np.frombuffer(b"".join(raw[k] for k in theirs.tolist()), np.uint64).reshape(len(theirs), -1)
            for k, row in zip(mine.tolist(), folded):
                apart = np.bitwise_count(other ^ row).sum(axis=1, dtype=np.int64)
                good = (9 * apart <= n[theirs] + n[k]) & (root[theirs] != root[k]) & (5 * n[theirs] >= 4 * n[k]) & (5 * n[k] >= 4 * n[theirs])
                good &= (own[theirs] != own[k]) & (own[k] == lo) if across and short == long else own[theirs] != own[k] if across else (version[theirs] > version[k]) | (short != long)
                found = theirs[good]
                out.append(np.stack([apart[good] / (n[found] + n[k]), np.full(len(found), k), found], axis=1))
    every = np.concatenate(out) if out else np.zeros((0, 3))
    pairs = every[:, 1:].astype(np.int64)
    if sparing:
        top = {r: r for r in root.tolist()}

        def up(r: int) -> int:
            while top[r] != r:
                top[r] = r = top[top[r]]
            return r

        kept = []
        for at in np.argsort(every[:, 0], kind="stable").tolist():
            x, y = up(int(root[pairs[at, 0]])), up(int(root[pairs[at, 1]]))
            if x != y:
                top[max(x, y)] = min(x, y)
                kept.append(at)
        pairs = pairs[kept]
    both = np.sort(version[pairs].reshape(-1, 2), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, version, n, root`` of the keys whose texts are not all of one component."""
    tagged = rows.join(roots, F.col("version") == F.col("node"), "left").select("key", "version", "n", F.coalesce("root", "version").alias("root"))
    tagged = materialise(tagged, "tagged")
    mixed = tagged.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    out = materialise(tagged.join(mixed, "key", "left_semi"), "rest")
    discard(tagged)
    return out


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near duplicates (of rows alike in id and text, one)."""
    return firsts(docs, groups(docs, text_col=text_col), id_col=id_col, text_col=text_col)
