"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more.

Training takes a bounded sample of labelled documents. One dictionary is trained on windows of ordinary documents alone,
the other on windows of toxic documents alone: on all of them at first and then, since a toxic document is mostly
ordinary text too, in rounds on those that the toxic dictionary of other documents shortens, by the gain that tells
them from windows of ordinary documents best. The dictionaries are used as plain content. Each window of a text
is compressed with the ordinary dictionary and with the toxic one beside it, so what they differ by is what the toxic
dictionary alone has; the differences of lengths become a few figures of a document, whose threshold and slope a logistic
fit calibrates on documents that trained neither dictionary (each fold by the dictionaries of the others).

A window of several words hides a stem that ordinary text has at times too, since the large ordinary dictionary holds it.
So a second, small pair of dictionaries is trained on words: the ordinary one on those of ordinary texts, and the toxic one
on those of toxic texts that are in far more of them than ordinary texts and chance explain (near copies of a text count
once). It grows in stages, each trained on the words that the stages before do not shorten to nothing, and keeps the
parts that shorten toxic words far oftener. A word is compressed between two texts that both know, so that its length
tells of nothing else; the text behind it is needed, since zstandard starts no match in the last eight bytes of its input.
How many of a document's words, and of its distinct words, the toxic dictionary shortens, and to how little, joins the
figures of the windows.

Defined cases: null and empty texts have no windows and get the score of no difference at all; repeated rows get the
same score; an empty table gives an empty result; without both labels among the training rows every score is 0;
columns other than the id and the text are not looked at; labels with a null id or label are left out; of clashing
labels of one document, the largest holds; of texts that share an id, the one of the least hash is learnt from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.storage import bounded, trimmed

#: The most labelled documents of each label that training collects, those of the least hashed ids, and the most
#: characters of such a sample.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 24_000_000
WINDOW_BYTES, LEVEL = 32, 3
#: The most bytes of the ordinary and of the toxic dictionary.
ORDINARY_BYTES, TOXIC_BYTES = 110_000, 2048
#: Bytes of a training sample and of a dictionary's segments, and the fewest samples that the trainer takes.
SAMPLE_BYTES, SEGMENT, LEAST_SAMPLES = 1024, 16, 256
#: Rounds of choosing toxic windows.
ROUNDS = 6
#: Bytes of a part of the toxic dictionary that is judged alone, windows that judge it, the gain that counts, and how
#: many times as often as in ordinary windows it must occur.
PART, JUDGES, LEAST_GAIN, OFTENER = 24, 6000, 3, 4.0
#: Folds of the labelled documents that calibrate, and the weight of the penalty.
FOLDS, RIDGE = 3, 3.0
#: Differences of lengths, in bytes, over which windows are counted.
STEPS = (2, 3, 4, 5, 6, 8, 10)
#: What words are compressed between (the end: eight bytes or more), and the most bytes of their ordinary dictionary; of
#: the toxic one, in a stage, whose segments hold whole words.
CARRIER, END, COMMON_BYTES, STAGE_BYTES, WORD_SEGMENT = b"=:carrier:of:words:=", b"\n:end:.\n", 1000, 2048, 32
#: Stages, the gain of a word that counts, and how many times as often as ordinary ones it must occur.
STAGES, WORD_GAIN, WORD_OFTENER = 4, 2, 8.0
#: The fewest texts with a word that is trained on, and the least log-likelihood ratio of its counts.
LEAST_TEXTS, SURPRISE = 3, 7.0
#: Near copies share half of this many words of least hashes, of those of so many bytes or more.
SKETCH, LONG = 8, 8
#: The most words of ordinary texts that train.
TRAIN_WORDS = 400_000
#: Gains, and bytes left of a word (one: a reference to the whole), over which words are counted; bytes that a word must share with the toxic dictionary
#: to be compressed at all, and distinct words whose gains a task remembers.
WORD_STEPS, WORD_RESTS, SHARED, REMEMBERED = (2, 3, 4, 5, 6), (1, 4, 99), 5, 200_000


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    #: the toxic and the ordinary dictionary of words
    stems: bytes = b"-"
    common: bytes = b"-"


def windows(text: bytes) -> list[bytes]:
    """Runs of whole lower-cased words of about ``WINDOW_BYTES`` bytes; the whole text in order."""
    out, some, n = [], [], 0
    for word in text.lower().split():
        some.append(word)
        n += len(word) + 1
        if n >= WINDOW_BYTES:
            out.append(b" ".join(some))
            some, n = [], 0
    if some:
        out.append(b" ".join(some))
    return out


def dictionary(some: list[bytes], most: int) -> bytes:
    """The content of a dictionary trained on windows, without its tables; the longer the more windows there are."""
    # the trainer ends early in text that repeats itself
    return trained(b" ".join(dict.fromkeys(some)), most, 1024, 8)


def trained(held: bytes, most: int, least: int, d: int, segment: int = SEGMENT) -> bytes:
    """``dictionary`` of a text, of runs of ``d`` bytes."""
    import zstandard as z

    # the trainer passes over samples that are shorter than its segments
    held = held or b"-" * SAMPLE_BYTES
    samples = [held[k : k + SAMPLE_BYTES] for k in range(0, len(held), SAMPLE_BYTES)]
    size = min(most, max(least, len(held) // 8))
    samples *= -(-LEAST_SAMPLES // len(samples)) if len(samples) < LEAST_SAMPLES else 1
    return z.train_dictionary(size, samples, k=segment, d=d, level=LEVEL).as_bytes()[-size:]


def measure(content: bytes):
    """A function from a window to its compressed length with a dictionary."""
    import zstandard as z

    made = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=LEVEL)
    compress = z.ZstdCompressor(dict_data=made, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    return lambda window: len(compress(window))


def gains(ordinary, toxic, some: list[bytes]) -> np.ndarray:
    """By how many bytes the toxic dictionary shortens each window more."""
    return np.fromiter((ordinary(w) - toxic(w) for w in some), np.int64, len(some))


def word_measure(content: bytes):
    """A function from a word to its compressed length with a dictionary, between the carrier and its end."""
    length = measure(content + CARRIER)
    return lambda word: length(CARRIER + b" " + word + b" " + END)


def thinned(some: list[bytes], most: int = 100_000) -> list[bytes]:
    """At most ``most`` windows, evenly."""
    return some[:: -(-len(some) // most)] if some else some


def choose(found: np.ndarray, contrast: np.ndarray) -> np.ndarray:
    """The windows of the gain, or a larger one, that tells most about coming from ``found`` and not from the contrast."""
    best, picked = 0.0, np.zeros(len(found), bool)
    for least in range(2, WINDOW_BYTES):
        held = found >= least
        a, b = held.mean(), ((contrast >= least).sum() + 1) / (len(contrast) + 1)
        if held.sum() >= 10 and a > b and a * np.log(a / b) > best:
            best, picked = a * np.log(a / b), held
    return picked


def dictionaries(toxic: list[bytes], ordinary: list[bytes], rounds: int = ROUNDS) -> tuple[bytes, bytes]:
    """The content of the toxic and of the ordinary dictionary."""
    plain = dictionary(thinned([w for t in ordinary[0::2] for w in windows(t)]), ORDINARY_BYTES)
    contrast = thinned([w for t in ordinary[1::2] or ordinary for w in windows(t)], 40_000)
    halves = [thinned([w for t in part for w in windows(t)], 40_000) for part in (toxic[0::2], toxic[1::2] or toxic)]
    picks, base = halves, measure(plain)
    for _ in range(rounds):
        chosen = []
        for mine, others in zip(halves, picks[::-1]):
            other = measure(plain + dictionary(others, TOXIC_BYTES))
            held = choose(gains(base, other, mine), gains(base, other, contrast))
            chosen.append([w for w, yes in zip(mine, held) if yes])
        if not all(chosen):
            break
        picks = chosen
    return telling(dictionary(picks[0] + picks[1], TOXIC_BYTES), plain, thinned(halves[0] + halves[1], JUDGES), thinned(contrast, JUDGES)), plain


def telling(content: bytes, plain: bytes, found: list[bytes], contrast: list[bytes]) -> bytes:
    """The parts of a toxic dictionary that, each alone beside the ordinary one, shorten toxic windows far oftener."""
    base, kept = measure(plain), []
    before = [np.fromiter(map(base, some), np.int64, len(some)) for some in (found, contrast)]
    for at in range(0, len(content), PART // 2):
        other = measure(plain + content[at : at + PART])
        a, b = (int((lengths - np.fromiter(map(other, some), np.int64, len(some)) >= LEAST_GAIN).sum()) for lengths, some in zip(before, (found, contrast)))
        if a >= 3 and a / len(found) > OFTENER * (b + 0.5) / len(contrast):
            kept.append((a, content[at : at + PART]))
    # the end of a dictionary is the cheapest to refer to
    return b" ".join(part for _, part in sorted(kept)) or content


def originals(texts: list[bytes]) -> list[set[bytes]]:
    """The words of each text that is no near copy of one before it."""
    out, seen = [], set()
    for t in texts:
        words = set(t.lower().split())
        sketch = sorted(crc32(w) for w in words if len(w) >= LONG)[:SKETCH]
        if len(sketch) < SKETCH or 2 * sum(k in seen for k in sketch) <= SKETCH:
            out.append(words)
        seen.update(sketch)
    return out


def marked(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> list[bytes]:
    """Words that are in far more toxic texts than ordinary ones and chance explain, as often as there are such texts."""
    found, against = (Counter(w for words in some for w in words) for some in (toxic, ordinary))
    share, out = len(toxic) / (len(toxic) + len(ordinary)), []
    for w in sorted(found):
        a, b = found[w], against[w]
        if a >= LEAST_TEXTS and a / len(toxic) > WORD_OFTENER * (b + 0.5) / len(ordinary):
            if a * np.log(a / (a + b) / share) + (b * np.log(b / (a + b) / (1 - share)) if b else 0.0) > SURPRISE:
                out += [w] * a
    Random(1).shuffle(out)
    return out


def word_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The content of the toxic and of the ordinary dictionary of words."""
    common = trained(b" ".join(thinned([w for t in ordinary[0::2] for w in t.lower().split()], TRAIN_WORDS)), COMMON_BYTES, 512, 8)
    foul, plain = originals(toxic), originals(ordinary)
    left, base = marked(foul, plain), word_measure(common)
    # in how many texts each word is, and its length; a part shortens only words that share a match's bytes with it
    counts = [Counter(w for words in some for w in words) for some in (foul, plain)]
    total, before, sharing = [sum(c.values()) for c in counts], {}, {}
    for w in sorted(counts[0].keys() | counts[1].keys()) if left else ():
        for gram in grams(b" " + w + b" "):
            sharing.setdefault(gram, []).append(w)

    def oftener(part: bytes) -> float:
        """How many toxic words the part shortens, of the gain at which it tells; zero where it does at none."""
        other, held = word_measure(common + part), np.zeros((2, WINDOW_BYTES))
        for w in {w for gram in grams(part) for w in sharing.get(gram, ())}:
            if w not in before:
                before[w] = base(w)
            gain = before[w] - other(w)
            if gain >= WORD_GAIN:
                held[:, WORD_GAIN : gain + 1] += [[c[w]] for c in counts]
        good = (held[0] >= LEAST_TEXTS + 1) & (held[0] / total[0] > WORD_OFTENER * (held[1] + 0.5) / total[1])
        return float((held[0] * good).max())

    kept: list[tuple[float, bytes]] = []
    for _ in range(STAGES):
        content = trained(b" ".join(left), STAGE_BYTES, 512, 6, WORD_SEGMENT) if left else b""
        parts = [content[at : at + PART] for at in range(0, len(content), PART // 2)]
        new = [(often, part) for part in parts if (often := oftener(part))]
        if not new:
            break
        kept += new
        other = word_measure(common + b" ".join(part for _, part in sorted(kept)))
        done = {w for w in set(left) if base(w) - other(w) >= WORD_GAIN and other(w) <= base(b"") + WORD_RESTS[0]}
        left = [w for w in left if w not in done]
    return b" ".join(part for _, part in sorted(kept)) or b"-", common


def grams(text: bytes, size: int = 4) -> set[bytes]:
    return {text[k : k + size] for k in range(len(text) - size + 1)}


RESTS, STEPPED = np.array(WORD_RESTS)[:, None], np.array(WORD_STEPS)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.ends = model, (measure(model.ordinary), measure(model.ordinary + model.toxic))
        self.words, self.known = (word_measure(model.common), word_measure(model.common + model.stems)), {}
        self.least, self.grams = self.words[0](b""), grams(b" " + model.stems + b" ", SHARED)

    def gain(self, word: bytes) -> int:
        """By how many bytes the toxic dictionary of words shortens the word more."""
        return self.shortened(word)[0]

    def shortened(self, word: bytes) -> tuple[int, int]:
        """``gain``, and the bytes that are left of the word; no gain where it has no run of bytes of that dictionary."""
        found = self.known.get(word)
        if found is None:
            held = b" " + word + b" "
            found = 0, len(word)
            if not self.grams.isdisjoint([held[k : k + SHARED] for k in range(len(held) - SHARED + 1)]):
                lengths = self.words[0](word), self.words[1](word)
                found = lengths[0] - lengths[1], lengths[1] - self.least
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(word) <= 64:  # long ones seldom come again
                self.known[word] = found
        return found

    def word_features(self, text: bytes) -> np.ndarray:
        counts = Counter(text.lower().split())
        n, held = sum(counts.values()), np.zeros((2, len(WORD_RESTS), len(WORD_STEPS)))
        for word, often in counts.items():
            gain, rest = self.shortened(word)
            if gain >= WORD_GAIN:
                held += np.array([often, 1])[:, None, None] * ((rest <= RESTS) & (gain >= STEPPED))
        over, distinct = held.reshape(2, -1)
        return np.concatenate([np.log1p(over), np.log1p(distinct), np.sqrt(over / max(n, 1)), [np.log1p(n)]])

    def features(self, text: bytes) -> np.ndarray:
        return np.concatenate([self.window_features(text), self.word_features(text)])

    def window_features(self, text: bytes) -> np.ndarray:
        gain = gains(*self.ends, windows(text)).astype(float)
        if not len(gain):
            return np.zeros(len(STEPS) * 2 + 2)
        over = np.array([(gain >= s).sum() for s in STEPS], float)
        return np.concatenate([np.log1p(over), over / len(gain), [gain.max(), np.sort(gain)[-3:].mean()]])

    def score(self, text: bytes) -> float:
        x = (self.features(text) - self.model.mean) / self.model.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.model.weights + self.model.bias, -30, 30))))


def train(toxic: list[bytes], ordinary: list[bytes], odds: float | None = None, folds: int = FOLDS) -> Model:
    """Dictionaries of all documents, calibrated by folds: each fold's figures are of the other folds' dictionaries.

    ``odds`` are those of toxic to ordinary documents, where the sample's differ from them.
    """
    x, y = [], []
    for k in range(folds):
        rest = [[t for j, t in enumerate(d) if j % folds != k] or d for d in (toxic, ordinary)]
        scorer = Scorer(Model(*dictionaries(*rest), None, None, None, 0.0, *word_dictionaries(*rest)))
        for label, some in ((1.0, toxic), (0.0, ordinary)):
            x += [scorer.features(t) for t in some[k::folds]]
            y += [label] * len(some[k::folds])
    x, y = np.array(x), np.array(y)
    model = Model(*dictionaries(toxic, ordinary), x.mean(0), x.std(0) + 1e-6, None, 0.0, *word_dictionaries(toxic, ordinary))
    x = np.column_stack([(x - model.mean) / model.scale, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([RIDGE] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    model.weights, model.bias = w[:-1], float(w[-1] + (np.log(odds * len(ordinary) / len(toxic)) if odds else 0.0))
    return model


def sample(docs: DataFrame, labels: DataFrame, label: str, *, id_col: str, text_col: str, rows: int, chars: int) -> dict[int, list[bytes]]:
    """Texts of each label: at most ``rows`` of the least hashed ids, while they have at most ``chars`` characters."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    # the join that picks the sample carries ids alone: texts are read for the picked ids only and never shuffled whole
    joined = texts.select("__id").join(known, "__id").withColumn("__h", F.xxhash64("__id", F.lit(11)))
    out = {}
    for y in (0, 1):
        ids = [r[0] for r in joined.filter(F.col("__y") == y).select("__id", "__h").orderBy("__h", "__id").limit(rows).collect()] if rows else []
        got, left = [], chars
        found = texts.filter(F.col("__id").isin(ids)).groupBy("__id").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text")).withColumn("__h", F.xxhash64("__id", F.lit(11))) if ids else None
        for r in found.orderBy("__h", "__id").toLocalIterator() if found is not None else ():
            left -= len(r["__text"])
            if left < 0 and got:
                break
            got.append(r["__text"].encode())
        out[y] = got
    return out


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model | None:
    """A model of the labelled rows of ``docs``; ``labels`` has ``doc_id, toxic``. None without both labels."""
    found = sample(docs, labels, "toxic", id_col=id_col, text_col=text_col, rows=rows, chars=chars)
    share = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).agg(F.avg("toxic")).first()[0]
    return train(found[1], found[0], share / (1 - share) if share and share < 1 else None) if found[0] and found[1] else None


def annotate(docs: DataFrame, model: Model | None, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score of every row beside its columns; nothing is shuffled. A column named ``score_col`` is an error."""
    if score_col in docs.columns:
        raise ValueError(f"documents have a column {score_col}: name another one for the score")

    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model) if model else None
        for some in texts:
            yield pa.array([scorer.score(t.as_buffer().to_pybytes() if t.is_valid else b"") if scorer else 0.0 for t in some], pa.float64())

    bounded(docs.sparkSession)
    # a scalar function: the other columns never leave the executor
    run = F.arrow_udf(trimmed(of), "double", F.ArrowUDFType.SCALAR_ITER)
    return docs.withColumn(score_col, run(F.col(text_col).cast("string").cast("binary")))


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return annotate(source, model).select("doc_id", "score")


def remainder(mod: int, id_col: str = "doc_id"):
    """The id's fold: the CRC-32 of its decimal text, modulo ``mod``."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))
