"""Token counts of a text's sections, from one encoding of the whole text.

Each text is encoded once; tokens have character spans. Sections are lines (their line ends lie between sections) or
any spans given in order. An interval join by binary search brings tokens to sections. The rule for a token across a
border: it goes to the section that holds most of its characters, the earlier one of a tie; a token wholly between
sections goes to the section before it. So the counts of a text's sections add up to its tokens.

Defined cases: null and empty texts are one empty section without tokens; repeated rows give repeated results; an
empty table gives an empty result; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Characters of text that are encoded together.
CHUNK = 1 << 20
SECTIONS = "section array<int>, start array<int>, stop array<int>, n_tokens array<int>, n_crossing array<int>"


def span_encoder(name: str) -> Callable[[str], np.ndarray]:
    """A function from a text to the character spans of its tokens.

    A vocabulary of ranks has the bytes of each token, so spans follow from the ids; a token that holds a part of a
    character spans it all, as with tokenizer files.
    """
    import os

    from corvane.llm.packing import tokenizer_file

    if not name.endswith(".tiktoken"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(tokenizer_file(name))
        whole.encode_special_tokens = True
        return lambda text: np.array(whole.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)

    import base64

    import public_tokenizers
    import tiktoken

    with open(tokenizer_file(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)

    def spans(text: str) -> np.ndarray:
        held = sizes[enc.encode_to_numpy(text, disallowed_special=())]
        stops = np.cumsum(held)
        starts = stops - held
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) == len(text):
            return np.stack([starts, stops], axis=1)
        character = np.cumsum((raw & 0xC0) != 0x80)
        return np.stack([character[starts] - 1, character[stops - 1]], axis=1)

    return spans


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's lines, without their line ends."""
    ends = np.array([len(x) for x in text.split("\n")], np.int64)
    stops = np.cumsum(ends + 1) - 1
    return stops - ends, stops


def attribute(spans: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those among them that cross a border. ``spans`` has a row for each token."""
    n = len(starts)
    if not len(spans):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    a, b = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    first = np.maximum(np.searchsorted(starts, a, "right") - 1, 0)
    last = np.maximum(np.searchsorted(starts, b - 1, "right") - 1, first)
    owner = first.copy()
    for k in np.flatnonzero(last > first).tolist():
        some = np.arange(first[k], last[k] + 1)
        held = np.minimum(stops[some], b[k]) - np.maximum(starts[some], a[k])
        owner[k] = some[int(np.argmax(held))]
    crossing = (a < starts[owner]) | (b > stops[owner])
    return np.bincount(owner, minlength=n), np.bincount(owner, crossing, minlength=n).astype(np.int64)


def count(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, doc_tokens, section, start, stop, n_tokens, n_crossing``; the last five are arrays over sections."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = span_encoder(tokenizer)

        def result(some: list[tuple[int, str]]) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(7)]
            for doc, text in some:
                starts, stops = lines_of(text)
                spans = encode(text)
                n, crossing = attribute(spans, starts, stops)
                for col, x in zip(cols, (doc, len(spans), np.arange(len(n)), starts, stops, n, crossing)):
                    col.append(x)
            kinds = [pa.int64()] * 2 + [pa.list_(pa.int32())] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "doc_tokens", "section", "start", "stop", "n_tokens", "n_crossing"])

        for batch in batches:
            some, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                some.append((doc, text.as_py() or ""))
                size += len(some[-1][1])
                if size >= CHUNK:
                    yield result(some)
                    some, size = [], 0
            if some:
                yield result(some)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(of, "doc_id long, doc_tokens long, " + SECTIONS)


def sections(counted: DataFrame) -> DataFrame:
    """A row for each section of ``count``'s result."""
    zipped = F.explode(F.arrays_zip("section", "start", "stop", "n_tokens", "n_crossing")).alias("s")
    return counted.select("doc_id", "doc_tokens", zipped).select("doc_id", "doc_tokens", "s.*")
