"""Nearest neighbours by additive quantisation.

Full-dimensional codebooks are trained one after another on the residuals of a bounded sample. Every vector is
normalised and encoded by beam search: the best few partial sums are kept at each codebook. A code's squared norm is
stored. A query's inner products with all codewords make lookup tables; the score of a code is the sum of its entries
over the stored norm. The exact cosine is off that score by no more than the distance of the normalised vector from its
normalised code. The best ``keep`` codes of each block give a bound for the ``k``-th cosine; every code that its score
and distance let reach the bound is ranked by the exact cosine, so a block's result and the merged one are exact. Vectors and queries meet in blocks of bounded size, each pair in a group of its own.

Defined cases: vectors that are null, empty, zero, of another dimension than most of the sample, or that hold null or
non-finite components take no part; null ids take no part; of repeated ids, each row is a candidate and ranks on
its own except for the query's own id, and the least of their vectors asks; ties go to the smaller id; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.storage import materialise

#: The most vectors that train codebooks; codebooks, codewords of each, and partial sums kept while encoding.
SAMPLE, BOOKS, WORDS, BEAM = 20_000, 16, 64, 6
#: Rows and queries of a block, and codes of a block that give a query its bound.
ROWS, QUERIES, KEEP = 8192, 1024, 400
#: More than rounding adds to a score.
SLACK = 1e-9


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """``books`` codebooks of ``words`` codewords: k-means of what the ones before leave."""
    rng, rest, out = np.random.default_rng(seed), x.copy(), []
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=len(rest) < words)]
        for _ in range(rounds):
            near = np.argmin((c * c).sum(1) - 2 * rest @ c.T, axis=1)
            n = np.bincount(near, minlength=words)
            sums = np.zeros_like(c)
            np.add.at(sums, near, rest)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        near = np.argmin((c * c).sum(1) - 2 * rest @ c.T, axis=1)
        rest = rest - c[near]
        out.append(c)
    return np.array(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row and the squared norm of what they add up to."""
    n, words = len(x), books.shape[1]
    codes, sums = np.zeros((n, 1, 0), np.int16), np.zeros((n, 1, x.shape[1]))
    for c in books:
        left = x[:, None, :] - sums
        cost = (left * left).sum(2)[:, :, None] - 2 * left @ c.T + (c * c).sum(1)
        width = min(beam, cost.shape[1] * words)
        best = np.argpartition(cost.reshape(n, -1), width - 1, axis=1)[:, :width]
        path, word = best // words, best % words
        codes = np.concatenate([np.take_along_axis(codes, path[:, :, None], 1), word[:, :, None].astype(np.int16)], axis=2)
        sums = np.take_along_axis(sums, path[:, :, None], 1) + c[word]
    best = np.argmin(((x[:, None, :] - sums) ** 2).sum(2), axis=1)
    rows = np.arange(n)
    return codes[rows, best], (sums[rows, best] ** 2).sum(1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two each, which changes no cosine: squares of very small and large components stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def search(
    vectors: DataFrame, queries, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, sample: int = SAMPLE, keep: int = KEEP,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each row for which the column ``queries`` holds."""
    v = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), queries.alias("asks")).filter(F.col("vec_id").isNotNull() & fine)
    some = kept.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(some):
        return vectors.sparkSession.createDataFrame([], schema)
    dims = int(some["v"].map(len).mode().iat[0])
    kept = kept.filter(F.size("v") == dims)
    x = scaled(np.array([r for r in some["v"] if len(r) == dims]))
    books = train(x / np.linalg.norm(x, axis=1, keepdims=True))
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # BOOKS * WORDS vectors

    def coded(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024].copy()
                x = scaled(np.array(part["v"].tolist()))
                part["v"] = list(x)
                codes, norms = encode(x / np.linalg.norm(x, axis=1, keepdims=True), shared.value)
                part["codes"], part["norm"] = list(codes.astype(np.int32)), norms
                yield part

    index = kept.mapInPandas(coded, "vec_id long, v array<double>, asks boolean, codes array<int>, norm double")
    index = materialise(index, "codes")
    n = index.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    row_blocks, query_blocks = max(1, -(-n["n"] // ROWS)), max(1, -(-n["q"] // QUERIES))
    rows = index.withColumn("rb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(row_blocks)).cast("int"))
    rows = rows.select("vec_id", "v", "codes", "norm", "rb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    asks = index.filter("asks").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(query_blocks)).cast("int"))
    asks = asks.select("vec_id", "v", "qb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"))

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        # the order that ties need
        r = r.sort_values("vec_id", kind="stable")
        ids, x, codes, norm = r["vec_id"].to_numpy(), np.array(r["v"].tolist()), np.array(r["codes"].tolist()), np.sqrt(np.maximum(r["norm"].to_numpy(), 1e-12))
        length = np.linalg.norm(x, axis=1)
        sums = np.zeros_like(x)
        for book, c in zip(shared.value, codes.T):
            sums += book[c]
        off = np.linalg.norm(x / length[:, None] - sums / norm[:, None], axis=1) + SLACK
        out = []
        for qid, y in zip(q["vec_id"].tolist(), q["v"]):
            y = np.asarray(y)
            lut = shared.value @ (y / np.linalg.norm(y))
            rough = lut[np.arange(codes.shape[1]), codes].sum(1) / norm
            rough[ids == qid] = -np.inf

            def exact(at: np.ndarray) -> np.ndarray:
                return (x[at] * y).sum(1) / (length[at] * np.linalg.norm(y))

            top = np.argpartition(-rough, min(keep, len(rough)) - 1)[:keep]
            bound = np.sort(exact(top[rough[top] > -np.inf]))[::-1][k - 1 : k]
            top = np.flatnonzero((rough > -np.inf) & (rough + off >= (bound[0] if len(bound) else -np.inf)))
            score = exact(top)
            best = np.argsort(-score, kind="stable")[:k]
            out.append((np.full(len(best), qid), ids[top[best]], score[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    found = asks.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInPandas(meet, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
