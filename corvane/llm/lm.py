"""Language-model scoring with a weighted backoff automaton.

States are the contexts of up to two words that training saw, and the root. A state's arc for a word, one for each
n-gram seen, has the probability of the word in that context; a word without an arc takes the failure arc, whose weight
is the context's backoff mass, to the context without its first word, and looks again there. So a text costs one
traversal from left to right that carries the state and adds the logarithms of what it passes.

With ``c`` an n-gram's count and ``m`` its context's, ``p = (c + b(m) q) / (m + b(m))``, where ``q`` is the shorter
context's probability: a failure arc weighs ``b(m) / (m + b(m))`` and every state's probabilities add up to one. ``b``
is ``a * m ** e``, about how many different words follow a context of that count. The root is add-one smoothed, with a
share for unknown words.

No model is gathered in one place. Texts are dealt into blocks of bounded bytes, each one row of compressed word
numbers. A block sends its distinct n-grams with their counts in its training texts, as sorted hashes coded by their
differences, to the shards of the hash range; a shard adds them up and sends back the totals in the same order. From
these a block builds its own part of the automaton and traverses it. A word is sent once for each block, so a frequent
one is no hot key.

Hashes have ``SPARE`` bits more than are needed to number all n-grams, so an unseen one is taken for a seen one with
probability below ``2 ** -SPARE`` at every size of input.

Defined cases: null and empty texts are the end token alone; repeated rows are scored, and learnt from, each; without
training rows every token is unknown; a null training condition is false; an empty table gives an empty result;
columns other than the id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.storage import materialise, release, trimmed

#: ``a, e`` of the backoff mass after one word and after two; chosen on a fold of the training rows.
MASS = ((6.0, 0.95), (2.0, 0.9))
#: Bytes of text of a block, n-grams of all blocks that a shard adds up, and tokens that are traversed as one run.
BLOCK, SHARD, RUN = 8 << 20, 2_000_000, 512
SPARE = 22
#: The hashes of a text's beginning and end, and the multiplier that mixes an n-gram.
START, END, MIX = np.uint64(1), np.uint64(2), np.uint64(0x9E3779B97F4A7C15)

DEALT = "block long, ids array<long>, learn array<boolean>, sizes binary, words binary, seq binary, n long"
SENT = "shard long, block long, kind int, keys binary, counts binary"
ANSWER = "block long, shard long, kind int, counts binary, n long, v long"


def packed(x: np.ndarray) -> bytes:
    """Unsigned integers, compressed plane by plane of their bytes."""
    import zstandard

    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    held = [k for k in range(8) if planes[k].any()]
    return bytes([len(x) >> 8 * k & 255 for k in range(4)]) + bytes([sum(1 << k for k in held)]) + zstandard.ZstdCompressor(level=1).compress(planes[held].tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    n, held = int.from_bytes(raw[:4], "little"), [k for k in range(8) if raw[4] >> k & 1]
    planes = np.zeros((8, n), np.uint8)
    planes[held] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[5:], max_output_size=max(1, n * len(held))), np.uint8).reshape(-1, n) if n and held else 0
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each distinct token, the tokens as places in it (each text closed by the end), and texts' sizes."""
    from xxhash import xxh64_intdigest

    known: dict[bytes, int] = {}
    sizes, seq = np.empty(len(texts), np.int64), []
    for k, text in enumerate(texts):
        words = text.lower().split()
        for w in words:
            if w not in known:
                known[w] = len(known) + 1
        some = np.empty(len(words) + 1, np.uint32)
        some[:-1] = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        some[-1] = 0
        seq.append(some)
        sizes[k] = len(words) + 1
    hashes = np.fromiter((2, *map(xxh64_intdigest, known)), np.uint64, len(known) + 1)
    return hashes, np.concatenate(seq) if seq else np.zeros(0, np.uint32), sizes


def dealt(docs: DataFrame) -> DataFrame:
    """A row for each run of rows of about ``BLOCK`` bytes of ``docs`` (``doc_id, text, learn``)."""
    names = [f.split()[0] for f in DEALT.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, learn, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def row() -> pa.RecordBatch:
            words, seq, sizes = numbered(texts)
            cols = [[block], [ids], [learn], [packed(sizes)], [packed(words)], [packed(seq)], [len(seq)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        for batch in batches:
            for doc, text, use in zip(batch.column(0), batch.column(1), batch.column(2)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if size and size + len(raw) > BLOCK:
                    yield row()
                    block, ids, learn, texts, size = block + 1, [], [], [], 0
                ids.append(doc.as_py())
                learn.append(bool(use.as_py()))
                texts.append(raw)
                size += len(raw) + 64
        if texts:
            yield row()

    return docs.mapInArrow(trimmed(of), DEALT)


def mix(context: np.ndarray, word: np.ndarray, mask: np.uint64) -> np.ndarray:
    x = (context ^ (context >> np.uint64(29))) * MIX + word
    return (x ^ (x >> np.uint64(32))) & mask


class Block:
    """The tokens of a block and the hashes of the n-grams that end at each."""

    def __init__(self, row: dict, width: int):
        mask = np.uint64((1 << width) - 1)
        self.sizes, self.seq = unpacked(row["sizes"]).astype(np.int64), unpacked(row["seq"]).astype(np.int32)
        self.words = unpacked(row["words"]) & mask
        ends = np.cumsum(self.sizes)
        self.first = ends - self.sizes
        self.inner = np.ones(len(self.seq), bool)  # all but each text's first token, which no two tokens precede
        self.inner[self.first] = False
        self.learn = np.repeat(np.array(row["learn"], bool), self.sizes)
        ids = self.words[self.seq]
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[self.first] = START
        self.pairs = mix(before, ids, mask)
        self.triples = mix(self.pairs[:-1], ids[1:], mask) if len(ids) else ids
        self.triples = np.concatenate([np.zeros(min(1, len(ids)), np.uint64), self.triples])
        self.texts = int(np.count_nonzero(self.learn[self.first])) if len(ids) else 0

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of words (with the beginning), pairs and triples, the distinct hashes in order and their counts in training."""
        flag = np.uint64(1)
        words = np.bincount(self.seq[self.learn], minlength=len(self.words))
        order = np.argsort(self.words)
        keys, counts = np.append(self.words[order], START), np.append(words[order], self.texts)
        yield _merged(keys, counts)
        for x, learn in ((self.pairs, self.learn), (self.triples[self.inner], self.learn[self.inner])):
            both = np.sort(x << flag | learn.astype(np.uint64))
            starts = _starts(both >> flag)
            yield both[starts] >> flag, np.add.reduceat(both & flag, starts).astype(np.int64) if len(both) else np.zeros(0, np.int64)


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Places where a new value begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = _starts(keys)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def _places(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Each element's place among the distinct values in order, and how many there are."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.zeros(len(keys), np.int32)
    np.cumsum(ordered[1:] != ordered[:-1], out=new[1:], dtype=np.int32)
    out = np.empty(len(keys), np.int32)
    out[order] = new
    return out, int(new[-1]) + 1 if len(new) else 0


def sent(blocks: DataFrame, width: int, bits: int) -> DataFrame:
    """Each block's n-grams by shard, the first ``bits`` of a hash."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for kind, (keys, counts) in enumerate(Block(row, width).grams()):
                    cuts = np.append(np.searchsorted(keys, edges), len(keys))
                    held = np.flatnonzero(cuts[1:] > cuts[:-1])
                    parts = [(keys[a:b], counts[a:b]) for a, b in zip(cuts[held].tolist(), cuts[held + 1].tolist())]
                    cols = [held, np.full(len(held), row["block"]), np.full(len(held), kind, np.int32)]
                    coded = [[packed(np.diff(k, prepend=np.uint64(0))) for k, _ in parts], [packed(c) for _, c in parts]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), *(pa.array(c, pa.binary()) for c in coded)], [f.split()[0] for f in SENT.split(", ")])

    return blocks.select("block", "learn", "sizes", "words", "seq").mapInArrow(trimmed(of), SENT)


def answered(grams: DataFrame) -> DataFrame:
    """What each block's n-grams count in all blocks, in the order they were sent; the sums of a shard's words beside."""

    def of(part: pa.Table) -> pa.Table:
        rows = part.select(["shard", "block", "kind"]).to_pylist()
        keys = [np.cumsum(unpacked(k.as_py())) for k in part["keys"]]
        places, n = _places(np.concatenate(keys))
        counts = np.concatenate([unpacked(c.as_py()) for c in part["counts"]]).astype(np.int64)
        totals = np.bincount(places, counts, n).astype(np.int64)
        cuts = np.cumsum([0] + [len(k) for k in keys])
        out = [(r["block"], r["shard"], r["kind"], packed(totals[places[a:b]]), 0, 0) for r, a, b in zip(rows, cuts, cuts[1:])]
        if rows[0]["kind"] == 0:
            found = np.zeros(n, np.uint64)
            found[places] = np.concatenate(keys)
            totals[found == START] = 0
            out.append((None, rows[0]["shard"], 0, None, int(totals.sum()), int((totals > 0).sum())))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        del keys, places, counts, totals
        release()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [f.split()[0] for f in ANSWER.split(", ")])

    return grams.groupBy("shard", "kind").applyInArrow(of, ANSWER)


class Automaton:
    """A block's states and arcs: for each token the arcs that its three possible contexts may have for it.

    ``arc[k]`` is the logarithm of a token's probability after ``k`` words, and ``seen[k]`` whether that arc exists;
    ``fail[k]`` the weight of the failure arc of the state of the ``k`` words before it, and ``state[k]`` whether there
    is that state. At the root every token has an arc.
    """

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, total: int, distinct: int, mass=MASS):
        keys = _merged(np.append(block.words, START), np.zeros(len(block.words) + 1, np.int64))[0]
        opening = float(words[np.searchsorted(keys, START)])
        # arrays of all tokens follow; each goes as soon as it is not needed
        c = words[np.searchsorted(keys, block.words)].astype(float)[block.seq]
        p = (c + 1) / (total + distinct + 1)
        self.known, self.root = c > 0, np.log10(p)
        self.arc, self.fail, self.seen, self.state = [self.root], [None], [None], [None]
        for order, (a, e) in enumerate(mass):
            m = np.roll(c, 1)
            m[block.first] = 0 if order else opening
            if order:
                c[:] = 0
                c[block.inner] = triples[_places(block.triples[block.inner])[0]]
            else:
                c = pairs[_places(block.pairs)[0]].astype(float)
            there, b = m > 0, a * m**e
            m += b
            # without a state the mass below is all there is
            weight = np.divide(b, m, out=np.ones(len(m)), where=there)
            p *= weight
            p += np.divide(c, m, out=np.zeros(len(m)), where=there)
            self.arc.append(np.log10(p))
            self.fail.append(np.log10(weight, out=weight))
            self.seen.append(c > 0)
            self.state.append(there)

    def traverse(self, first: np.ndarray, sizes: np.ndarray, run: int = RUN) -> np.ndarray:
        """The log probability of each text, from left to right.

        Long texts are taken in runs side by side. A state is known by the two tokens before it, so a run that does not
        begin a text starts in the state which reading those two leads to.
        """
        pieces = -(-sizes // run)
        text = np.repeat(np.arange(len(sizes)), pieces)
        begins = first[text] + run * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        ends = np.minimum(begins + run, (first + sizes)[text])
        order = np.argsort(begins - ends, kind="stable")  # longest first: those at work are always the foremost
        at, ends = begins[order], ends[order]
        state = np.where(self.state[2][at], 2, np.where(self.state[1][at], 1, 0))
        logs = np.zeros(len(at))
        while len(at):
            for k in (2, 1):
                here = state == k
                miss = here & ~self.seen[k][at]
                logs[: len(at)] += np.where(miss, self.fail[k][at], np.where(here, self.arc[k][at], 0.0))
                # a hit leaves; a miss goes on to the shorter context, which has a state whenever the longer one has
                state = np.where(miss, k - 1, np.where(here, 9, state))
            logs[: len(at)] += np.where(state == 0, self.root[at], 0.0)
            at = at + 1
            more = int(np.count_nonzero(at < ends[: len(at)]))
            at = at[:more]
            state = np.where(self.state[2][at], 2, np.where(self.state[1][at], 1, 0))
        out = np.zeros(len(sizes))
        np.add.at(out, text[order], logs)
        return out


def score(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", mass=MASS) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row; ``training`` is a condition."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.coalesce(training, F.lit(False)).alias("learn"))
    blocks = materialise(dealt(source), "blocks")
    tokens = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    width = (3 * tokens + 1).bit_length() + SPARE
    bits = min(20, (2 * tokens // SHARD).bit_length())
    answers = materialise(answered(sent(blocks, width, bits)), "answers")
    sums = answers.filter("block is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    total, distinct = int(sums[0]), int(sums[1])
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scored(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        row, got = mine.to_pylist()[0], theirs.sort_by("shard")
        block = Block(row, width)
        counts = [np.concatenate([np.zeros(0, np.uint64), *(unpacked(c.as_py()) for k, c in zip(got["kind"], got["counts"]) if k.as_py() == kind)]) for kind in range(3)]
        machine = Automaton(block, *counts, total, distinct, mass)
        sums = lambda x: np.add.reduceat(x, block.first)
        cols = [pa.array(row["ids"], pa.int64()), block.sizes, sums(machine.known.astype(np.int64)), np.full(len(block.sizes), total), sums(machine.root), machine.traverse(block.first, block.sizes)]
        out = pa.Table.from_arrays([pa.array(c) for c in cols], [f.split()[0] for f in schema.split(", ")])
        del block, machine, counts, cols
        release()
        return out

    mine = blocks.select("block", "ids", "learn", "sizes", "words", "seq").groupBy("block")
    return mine.cogroup(answers.filter("block is not null").select("block", "shard", "kind", "counts").groupBy("block")).applyInArrow(scored, schema)
