"""Document quality from a linear-chain conditional random field over lines.

A line has a few figures (kinds of characters, words, repetition), its neighbours' figures beside them. The field has
two states, good and bad; it is trained by gradient steps on a bounded sample of labelled documents. Lines have no labels of
their own: after a start in which each bears its document's, they are latent. What a document's label then asks is that
the mean probability of good, weighted by the lines' lengths, is ``GOOD`` at least or ``BAD`` at most; the nearest
labelling of the field that holds this, one that all lines' potentials are shifted to alike, is what the field is moved
towards. So a bad document may have good lines, and changes between the two are learnt. Forward-backward gives each
line's probability of good; a document's score is their mean, weighted alike.

Defined cases: null and empty texts are one empty line and are scored like any other; repeated rows get the same
score; an empty table gives an empty result; without labelled rows every score is 0.5; columns other than the id and
the text are not looked at; of clashing labels of one document, the largest holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.toxicity import sample

#: The most labelled documents of each label, and characters of such a sample, that training collects.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 12_000_000
STEPS, RATE, DECAY, DECAY_MOVES = 200, 0.1, 1e-3, 0.05
LOWER, UPPER, DIGIT = bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58))
STOP, SYMBOL, WIDE = b".,;:!?'\"-", b"#$%&*+/<=>@\\^_`|~()[]{}", bytes(range(128, 256))
OWN = 12
#: The share of steps that start with lines labelled as their documents, and the means of good that labels ask for.
START, GOOD, BAD = 0.4, 0.92, 0.25


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray


def line_figures(line: bytes, seen: int) -> tuple:
    n = max(len(line), 1)
    words = line.split()
    shares = [(len(line) - len(line.translate(None, kind))) / n for kind in (LOWER, UPPER, DIGIT, STOP, SYMBOL, WIDE)]
    k = max(len(words), 1)
    return (*shares, len(words) == 0, np.log1p(len(line)), len(line) / k, len(set(words)) / k, line.count(b"!") / k, min(seen, 3))


def figures(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Figures of each line with those of both neighbours and a constant, and the lines' lengths."""
    lines, seen, rows = text.split(b"\n"), {}, []
    for line in lines:
        key = hash(line)
        rows.append(line_figures(line, seen.get(key, 0)))
        seen[key] = seen.get(key, 0) + 1
    own = np.array(rows, float)
    edge = np.zeros((1, OWN))
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.ones((len(own), 1))]), np.array([max(len(x), 1) for x in lines], float)


def forward_backward(good: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For one chain: log potentials of good (bad has zero) to probabilities of good, and expected moves."""
    n = len(good)
    p = np.exp(np.column_stack([np.zeros(n), np.clip(good, -30, 30)]))
    p /= p.sum(1, keepdims=True)
    m = np.exp(np.clip(moves, -10, 10))
    a, b = np.empty((n, 2)), np.ones((n, 2))
    a[0] = p[0] / p[0].sum()
    for t in range(1, n):
        a[t] = (a[t - 1] @ m) * p[t]
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = m @ (b[t + 1] * p[t + 1])
        b[t] /= b[t].sum()
    post = a * b
    post /= post.sum(1, keepdims=True)
    pair = np.zeros((2, 2))
    if n > 1:
        each = a[:-1, :, None] * m[None] * (p[1:] * b[1:])[:, None, :]
        pair = (each / each.sum((1, 2), keepdims=True)).sum(0)
    return post[:, 1], pair


def nearest(good: np.ndarray, moves: np.ndarray, share: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray]:
    """``forward_backward`` with all potentials shifted, no more than a document's label ``y`` asks."""
    sign, bound = (1, GOOD) if y else (-1, BAD)
    met = lambda found: sign * (found[0] @ share - bound) >= 0
    found = forward_backward(good, moves)
    if met(found):
        return found
    low, high = 0.0, 24.0
    for _ in range(7):
        mid = (low + high) / 2
        found = forward_backward(good + sign * mid, moves)
        low, high = (low, mid) if met(found) else (mid, high)
    return forward_backward(good + sign * high, moves)


def train(bad: list[bytes], good: list[bytes], steps: int = STEPS) -> Model:
    """Stochastic steps on batches of documents, each document weighing the same and both labels alike."""
    docs = [(*figures(t), y) for y, some in ((0, bad), (1, good)) for t in some]
    every = np.vstack([x for x, _, _ in docs])
    mean, scale = every.mean(0), every.std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    docs = [((x - mean) / scale, lengths / lengths.sum(), y) for x, lengths, y in docs]
    rng, w, moves = np.random.default_rng(3), np.zeros(every.shape[1]), np.zeros((2, 2))
    square_w, square_m = np.zeros_like(w) + 1e-8, np.zeros((2, 2)) + 1e-8
    for step in range(steps):
        dw, dm = DECAY * w, DECAY_MOVES * moves
        batch = rng.choice(len(docs), min(64, len(docs)), replace=False)
        for k in batch.tolist():
            x, share, y = docs[k]
            at, pair = forward_backward(x @ w, moves)
            if step < START * steps:
                wanted, moved = np.full(len(x), float(y)), np.zeros((2, 2))
                moved[y, y] = len(x) - 1
            else:
                wanted, moved = nearest(x @ w, moves, share, y)
            dw += x.T @ (at - wanted) / len(x) / len(batch)
            dm += (pair - moved) / len(x) / len(batch)
        square_w += dw * dw
        square_m += dm * dm
        w -= RATE * dw / np.sqrt(square_w)
        moves -= RATE * dm / np.sqrt(square_m)
    return Model(mean, scale, w, moves)


def line_scores(text: bytes, model: Model) -> tuple[np.ndarray, np.ndarray]:
    x, lengths = figures(text)
    return forward_backward(((x - model.mean) / model.scale) @ model.weights, model.moves)[0], lengths


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model | None:
    found = sample(docs, labels, "quality", id_col=id_col, text_col=text_col, rows=rows, chars=chars)
    return train(found[0], found[1]) if found[0] and found[1] else None


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, line_scores`` of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, lines = [], []
            for t in batch.column(1).cast(pa.binary()):
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                good, lengths = line_scores(text, model) if model else (np.full(1, 0.5), np.ones(1))
                totals.append(float(np.clip(good @ lengths / lengths.sum(), 0, 1)))
                lines.append(good.astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.float64()), pa.array(lines, pa.list_(pa.float32()))], ["doc_id", "score", "line_scores"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(of, "doc_id long, score double, line_scores array<float>")
