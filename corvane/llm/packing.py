"""First-fit-decreasing packing of documents into fixed-length token sequences.

A document's tokens (and one end-of-document id) are cut into full sequences and a remainder. Remainders are
dealt at random into groups of bounded size; each group is packed on its own, first-fit decreasing, with a
tournament tree over bin capacities that finds the first bin with room in O(log bins).

Defined cases: a null or empty text is a document of the end id alone; repeated rows are packed as often as they
occur; an empty table gives an empty result; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.storage import kept, materialise, trimmed

TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 2048
END_ID = 1
GROUP_PIECES = 4096
#: Bytes beyond which a worker forgets words, and the bytes of the longest word that it remembers.
CACHE_BYTES, WORD_BYTES = 24 << 20, 48
#: About what an entry takes besides its bytes: two objects' heads and a place in the table.
ENTRY_BYTES = 200
#: Lower-cased words of Latin letters that composition leaves alone, and signs after them: one piece each for the
#: tokenizer. Any other line matches as nothing.
PLAIN = re.compile("^(?:([a-zß-öø-ÿ]+)([.,!?;:*#%()]*)|.*)$", re.MULTILINE)
#: Bytes of text that are looked up together.
CHUNK = 4 << 20
#: What stands for the end of a word among the ranks; plain words do not hold it.
END_MARK = "\x7f"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, uid long"


def tokenizer_file(name: str) -> str:
    """A path as it is; a bare name is one of the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_signs() -> dict[int, str]:
    """How byte-level models write each byte: printable ones as they are, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder:
    """Ids of a tokenizer that never joins characters across ASCII white space.

    Each distinct word is encoded once and remembered in a table of bounded bytes. Where the tokenizer lower-cases,
    splits letters from signs and marks the ends of words, words of plain letters go through its ranks, all at once.
    """

    def __init__(self, name: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file(name))
        self.tokenizer.encode_special_tokens = True
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        parts = json.loads(self.tokenizer.to_str())
        steps = parts["normalizer"].get("normalizers", []) if parts["normalizer"] else []
        # the vocabulary's own splitter and normaliser, by their settings: anything else takes the general way
        splitter = json.dumps(parts["pre_tokenizer"] or {})
        self.plain = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and r"|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in splitter and "ByteLevel" in splitter
        if self.plain:
            self.ranked = self.ranks(parts["model"])

    def ranks(self, model: dict):
        """The model's merges in the order of their ids, with ``END_MARK`` for the end of a word."""
        import tiktoken

        raw = {sign: bytes([b]) for b, sign in byte_signs().items()}
        suffix = model["end_of_word_suffix"]
        held = {}
        for token, at in model["vocab"].items():
            stem = token.removesuffix(suffix) if token != suffix else token
            if all(c in raw for c in stem):
                held[b"".join(raw[c] for c in stem) + (END_MARK.encode() if token.endswith(suffix) else b"")] = at
        # a token that already holds the mark's byte does not occur in plain words, but for the byte itself
        self.closes = np.zeros(max(held.values()) + 1, bool)
        self.closes[[at for token, at in held.items() if len(token) > 1 and token.endswith(END_MARK.encode())]] = True
        return tiktoken.Encoding("plain", pat_str=f"[^{END_MARK}]+{END_MARK}", mergeable_ranks=held, special_tokens={})

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word, as little-endian unsigned 32-bit bytes."""
        if not self.plain:
            return self.learn_any(words)
        if not words:
            return {}
        # one line a word: a stem of letters and the signs after it, or nothing where a word is not of this form
        found = PLAIN.findall(b"\n".join(words).decode("utf-8", "replace").lower())
        pieces = dict.fromkeys([p for both in found for p in both if p])
        raw = self.ranked.encode_to_numpy(END_MARK.join([*pieces, ""])).astype("<u4") if pieces else np.zeros(0, "<u4")
        stops = (4 * (np.flatnonzero(self.closes[raw]) + 1)).tolist()
        raw = raw.tobytes()
        pieces = dict(zip(pieces, (raw[a:b] for a, b in zip([0, *stops], stops))))
        pieces[""] = b""
        out = {w: pieces[stem] + pieces[signs] for w, (stem, signs) in zip(words, found) if stem}
        rest = [w for w, (stem, _) in zip(words, found) if not stem]
        return out | self.learn_any(rest) if rest else out

    def learn_any(self, words: list[bytes]) -> dict[bytes, bytes]:
        """``learn`` for words of any kind, by the whole tokenizer."""
        out = {}
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            texts = [w.decode("utf-8", "replace") for w in some]
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])
            found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            at = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
            cuts = np.searchsorted(at, starts) * 4
            raw = ids.tobytes()
            out.update((w, raw[a:b]) for w, a, b in zip(some, cuts, cuts[1:]))
        return out

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text, for texts in UTF-8."""
        split = [t.split() for t in texts]
        words = set().union(*split)
        if self.held > CACHE_BYTES:
            self.known = {w: self.known[w] for w in words if w in self.known}
            self.held = ENTRY_BYTES * len(self.known) + sum(map(len, self.known)) + sum(map(len, self.known.values()))
        known = self.known
        new = words.difference(known)
        del words
        learnt = self.learn([w for w in new if len(w) <= WORD_BYTES])
        known.update(learnt)
        self.held += ENTRY_BYTES * len(learnt) + sum(map(len, learnt)) + sum(map(len, learnt.values()))
        long = self.learn([w for w in new if len(w) > WORD_BYTES])
        look = known.__getitem__ if not long else lambda w: known[w] if len(w) <= WORD_BYTES else long[w]
        for some in split:
            yield b"".join(map(look, some))

    def forget(self) -> None:
        self.known, self.held = {}, 0


def encoder(name: str) -> WordEncoder:
    """The encoder of a tokenizer, which takes long to load: tasks that pack share it."""
    loaded = kept("packing")
    if name not in loaded:
        loaded[name] = WordEncoder(name)
    return loaded[name]


def in_chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive texts of about ``most`` bytes, with the place of the first; null is empty."""
    some, first, size = [], 0, 0
    for k, text in enumerate(texts):
        some.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
        size += len(some[-1])
        if size >= most:
            yield first, some
            some, first, size = [], k + 1, 0
    if some:
        yield first, some


def _cutter(name: str, sequence: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, uid = encoder(name), TaskContext.get().partitionId() << 34
        # words and ids are many small objects without cycles, which the collector would walk again and again
        gc.disable()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, some in in_chunks(batch.column(1)):
                rows = []
                for doc, raw in zip(ids[first : first + len(some)], enc.encode(some)):
                    raw += end
                    n = len(raw) // 4
                    for a in range(0, n, sequence):
                        piece = raw[4 * a : 4 * (a + sequence)]
                        rows.append((doc, a, len(piece) // 4, zlib.crc32(piece), n, uid, piece))
                        uid += 1
                cols = list(zip(*rows))
                arrays = [pa.array(c, pa.int64()) for c in cols[:6]] + ([pa.array(cols[6], pa.binary())] if keep_ids else [])
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in PIECES.split(", ")] + ["ids"] * keep_ids)
        enc.forget()

    return trimmed(cut, "packing")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size. ``sizes`` are taken largest first, ties in their order."""
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[k]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[k], offsets[k] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a >= b else b
    return bins, offsets


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, sequence: int = SEQUENCE,
    end_id: int = END_ID, group_pieces: int = GROUP_PIECES, seed: int = 7, keep_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a document: where it lies in which sequence.

    ``group_pieces`` bounds the pieces that one task packs together. ``keep_ids`` adds the ids themselves as
    little-endian unsigned 32-bit integers.
    """
    schema = PIECES + (", ids binary" if keep_ids else "")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialise(source.mapInArrow(_cutter(tokenizer, sequence, end_id, keep_ids), schema), "pieces")
    rest = pieces.filter(F.col("length") < sequence)
    groups = max(1, -(-rest.count() // group_pieces))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("uid", ignore_index=True)
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), sequence)
        part["sequence_id"] = ((part.pop("grp").to_numpy().astype(np.int64) << 24) | bins) * 2
        part["offset"] = offsets
        return part

    grouped = rest.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(groups)))
    placed = grouped.groupBy("grp").applyInPandas(packed, schema + ", sequence_id long, offset long")
    full = pieces.filter(F.col("length") == sequence).withColumns({"sequence_id": F.col("uid") * 2 + 1, "offset": F.lit(0).cast("long")})
    return full.unionByName(placed).drop("uid")
