"""Retrieval units of documents, and their hashed TF-IDF vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import numbers as N
from corvane.functions import text as T
from corvane.tables import spread

#: The bounds of units in tokens and characters, the stride of character windows, and kinds of documents.
CODE_TOKENS, TEXT_TOKENS, CHARS, CHAR_STRIDE, OVERLAP = 350, 900, 10_000, 9_000, 116
CODE_KINDS, DOC_KINDS = ("file", "function_body", "type_body", "statement"), ("doc", "repo", "directory", "package")
TOKEN = re.compile(r"\w+|[^\w\s]")


def token_windows(text: Column, limit: int = TEXT_TOKENS) -> Column:
    """Half-overlapping windows of ``limit`` tokens, each joined by single spaces; a text within the bounds is one, as it is."""
    toks = F.regexp_extract_all(text, F.lit(T.PIECE), F.lit(0))
    n, step = F.size(toks), max(limit // 2, 1)
    # the last window is the first to reach the end
    starts = F.sequence(F.lit(0), F.ceil(F.greatest(n - limit, F.lit(0)) / step).cast("int"))
    return F.when((n <= limit) & (F.length(text) <= CHARS), F.array(text)).when(n <= limit, char_windows(text)).otherwise(F.transform(starts, lambda k: F.array_join(F.slice(toks, k * step + 1, limit), " ")))


def char_windows(text: Column, size: int = CHARS, stride: int = CHAR_STRIDE) -> Column:
    """Windows of ``size`` characters, ``stride`` apart, trimmed; empty ones are left out."""
    starts = F.sequence(F.lit(0), F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / stride).cast("int"))
    return F.filter(F.transform(starts, lambda k: F.trim(F.substring(text, k * stride + 1, F.lit(size)))), lambda t: t != "")


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, term, n``: how often each word occurs in each row; counted in each task before it is sent."""
    words = spread(docs.select(id_col, text_col)).select(id_col, F.explode(T.tokens(F.col(text_col))).alias("term"))
    return words.groupBy(id_col, "term").agg(F.count("*").alias("n"))


def document_frequency(docs: DataFrame, text_col: str) -> DataFrame:
    """``term, df, tf``: in how many rows each word is and how often it occurs.

    A row's distinct words and all its words are two lists of one scan, so ids and postings are not shuffled: a task
    sends each word once.
    """
    toks = spread(docs.select(text_col)).select(T.tokens(F.col(text_col)).alias("t"))
    lists = toks.select(F.posexplode(F.array(F.array_distinct("t"), F.col("t"))).alias("every", "words")).select("every", F.explode("words").alias("term"))
    return lists.groupBy("term").agg(F.count_if(F.col("every") == 0).alias("df"), F.count_if(F.col("every") == 1).alias("tf"))


def hashed_vectors(docs: DataFrame, id_col: str, text_col: str, dims: int = 256) -> DataFrame:
    """``id_col, vector``: hashed TF-IDF of each row, of length one, as a map from dimension to weight."""
    counts, n = term_counts(docs, id_col, text_col), docs.count()
    # a term is hashed once, where its frequency is
    terms = counts.groupBy("term").agg(F.count("*").alias("df")).select("term", N.smoothed_idf(F.col("df"), F.lit(n)).alias("idf"), N.dimension(F.col("term"), dims).alias("dim"))
    summed = counts.join(terms, "term").groupBy(id_col, "dim").agg(F.sum(F.col("n") * F.col("idf")).alias("w"))
    rows = summed.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("dim", "w"))).alias("rows"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.select(id_col, F.map_from_entries(F.transform("rows", lambda r: F.struct(r["dim"], r["w"] / F.col("norm")))).alias("vector"))


def sparse_dot(vector: Column, query: dict[int, float]) -> Column:
    """The inner product of a map and a query's weights, of which there are at most as many as dimensions."""
    return sum((F.coalesce(F.try_element_at(vector, F.lit(k).cast("long")), F.lit(0.0)) * w for k, w in query.items()), F.lit(0.0))


def query_vector(words: list[str], dims: int = 256) -> dict[int, float]:
    """A query's hashed vector, every word of the same weight, of length one."""
    import hashlib

    out: dict[int, float] = {}
    for w in words:
        at = int.from_bytes(hashlib.sha1(w.encode()).digest()[:4], "big") % dims
        out[at] = out.get(at, 0.0) + 1.0
    length = sum(x * x for x in out.values()) ** 0.5
    return {k: x / length for k, x in out.items()}


def line_spans(lines: list[str], tokens: int = CODE_TOKENS, chars: int = CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of lines, end exclusive, each within the bounds as far as one line allows; the next one begins with the
    last lines of the one before, at least one, as many as cost ``overlap`` tokens at most."""
    plain = [len(TOKEN.findall(x)) for x in lines]
    spans, first, held, size = [], 0, 0, 0
    for k, line in enumerate(lines):
        cost = max(plain[k], 1)
        if k > first and (held + cost > tokens or size + len(line) > chars):
            spans.append((first, k))
            back, total = k - 1, max(plain[k - 1], 1)
            while back > first and total + max(plain[back - 1], 1) <= overlap:
                back -= 1
                total += max(plain[back], 1)
            first, held, size = back, sum(plain[back:k]), sum(len(x) + 1 for x in lines[back:k])
        held, size = held + cost, size + len(line) + 1
    if first < len(lines):
        spans.append((first, len(lines)))
    return spans


def windows_of(text: str, tokens: int) -> list[str]:
    """``token_windows`` of a text, each cut into character windows where it is too long."""
    found = TOKEN.findall(text)
    if len(found) <= tokens:
        return [text] if len(text) <= CHARS else _cut(text)
    step = max(tokens // 2, 1)
    last = -(-(len(found) - tokens) // step)
    parts = [" ".join(found[k * step : k * step + tokens]) for k in range(last + 1)]
    return [p for part in parts for p in ([part] if len(part) <= CHARS else _cut(part))]


def _cut(text: str) -> list[str]:
    last = -(-max(len(text) - CHARS, 0) // CHAR_STRIDE)
    return [p for k in range(last + 1) if (p := text[k * CHAR_STRIDE : k * CHAR_STRIDE + CHARS].strip())]


def code_units(text: str) -> list[tuple[str, int | None, int | None]]:
    """Units of code with their first and last lines."""
    lines = text.splitlines()
    if len(TOKEN.findall(text)) <= CODE_TOKENS and len(text) <= CHARS:
        return [(text, 1, max(len(lines), 1))]
    out = []
    for a, b in line_spans(lines):
        whole = "\n".join(lines[a:b])
        fits = len(TOKEN.findall(whole)) <= CODE_TOKENS and len(whole) <= CHARS
        out += [(part, a + 1, b) for part in ([whole] if fits else windows_of(whole, CODE_TOKENS))]
    return out


def paragraph_units(text: str) -> list[tuple[str, int | None, int | None]]:
    """Units of prose: whole paragraphs as many as fit; a paragraph too long for one is cut into windows."""
    parts = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    if not parts:
        return [(w, None, None) for w in windows_of(text, TEXT_TOKENS)]
    out, some, held, size = [], [], 0, 0

    def close() -> None:
        nonlocal some, held, size
        if some:
            whole = "\n\n".join(some)
            fits = len(TOKEN.findall(whole)) <= TEXT_TOKENS and len(whole) <= CHARS
            out.extend((w, None, None) for w in ([whole] if fits else windows_of(whole, TEXT_TOKENS)))
        some, held, size = [], 0, 0

    for p in parts:
        n = len(TOKEN.findall(p))
        if some and (held + n > TEXT_TOKENS or size + len(p) > CHARS):
            close()
        if n > TEXT_TOKENS or len(p) > CHARS:
            out.extend((w, None, None) for w in windows_of(p, TEXT_TOKENS))
        else:
            some.append(p)
            held, size = held + n, size + len(p) + 2
    close()
    return out


UNIT = "doc_id string, unit_id string, ordinal int, unit_kind string, content string, start_line int, end_line int, token_estimate int, char_count int"


def build(docs: DataFrame) -> DataFrame:
    """Units of ``docs`` (``doc_id, kind, content``, and ``path, symbol_id`` for the key that units are grouped under).

    Code is cut at lines, prose at paragraphs, all else into windows of tokens. A unit's lines depend on the ones before
    it, so this runs in Python, a batch of rows at a time; a row without text has no unit.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = [f.split()[0] for f in UNIT.split(", ")]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc, kind, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not (text or "").strip():
                    continue
                found = code_units(text) if kind in CODE_KINDS else paragraph_units(text) if kind in DOC_KINDS else [(w, None, None) for w in windows_of(text, TEXT_TOKENS)]
                own = kind if kind in ("function_body", "type_body", "statement") else None
                if kind in CODE_KINDS:
                    unit = own or ("line_window" if len(found) > 1 or kind == "file" else "symbol_body")
                else:
                    unit = "semantic_text" if kind not in DOC_KINDS else "doc_section" if len(found) > 1 else f"{kind}_summary"
                for k, (part, a, b) in enumerate(found):
                    part = part.strip()
                    if part:
                        digest = hashlib.sha1(f"{doc}\0{k}\0{part}".encode()).hexdigest()[:16]
                        for col, x in zip(cols, (doc, f"{doc}:unit:{k}:{digest}", k, unit, part, a, b, len(TOKEN.findall(part)), len(part))):
                            col.append(x)
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return docs.select(F.col("doc_id").cast("string"), "kind", "content").mapInArrow(of, UNIT)


def aggregation_key(symbol_id: Column, path: Column, doc_id: Column) -> Column:
    """What a document's units are grouped under: its symbol, else its path, else itself."""
    return F.when(symbol_id.isNotNull(), F.concat(F.lit("symbol:"), symbol_id)).when(path.isNotNull(), F.concat(F.lit("path:"), path)).otherwise(F.concat(F.lit("doc:"), doc_id.cast("string")))
