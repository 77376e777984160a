"""Column functions on text, identifiers and paths. All of them give null, or an empty array, for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of generated and vendored paths, and the languages of file name endings.
GENERATED_PARTS = ("generated", "gen", "dist", "target", "vendor")
GENERATED_ENDINGS = (".pb.rs", "_pb2.py", "_grpc.py")
LANGUAGES = {
    "c": "C", "cc": "C++", "cpp": "C++", "css": "CSS", "go": "Go", "h": "C/C++ Header", "html": "HTML", "java": "Java", "js": "JavaScript",
    "json": "JSON", "jsx": "JSX", "lock": "Lockfile", "md": "Markdown", "proto": "Protocol Buffers", "py": "Python", "rs": "Rust", "sh": "Shell",
    "sql": "SQL", "toml": "TOML", "ts": "TypeScript", "tsx": "TSX", "txt": "Text", "yaml": "YAML", "yml": "YAML",
}
#: The signs that divide words, what is not part of one, and what an estimate counts as a token.
SIGNS, NOT_WORD, PIECE = "/-.", r"[^\p{L}\p{N}_\s]+", r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def tokens(text: Column) -> Column:
    """Words in their order, repeats included: lower-cased, divided at white space, ``::``, ``/``, ``-`` and ``.``."""
    # plain replacements and one pattern: nothing here is evaluated word by word
    parted = F.translate(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("::"), F.lit(" ")), SIGNS, " " * len(SIGNS))
    return F.array_remove(F.split(F.regexp_replace(parted, NOT_WORD, ""), r"\s+"), "")


def path_terms(path: Column, limit: int = 8) -> Column:
    """The first distinct words of a path's segments, the last one without its ending."""
    stem = F.regexp_replace(F.coalesce(path, F.lit("")), r"(?<=[^/])\.[^./]*$", "")
    return F.slice(F.array_distinct(tokens(stem)), 1, limit)


def identifier_terms(name: Column) -> Column:
    """Lower-cased parts of an identifier, divided where a capital follows and at all that is no ASCII letter or digit."""
    parted = F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2"))
    return F.filter(F.split(parted, "[^a-z0-9]+"), lambda t: t != "")


def collapse(text: Column) -> Column:
    """The text with every run of white space as one space, none around it."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def preview(text: Column, width: int = 180) -> Column:
    """The collapsed text; where it is longer than ``width``, its opening and three dots of that length together."""
    one = collapse(text)
    return F.when(F.length(one) > width, F.concat(F.rtrim(F.substring(one, 1, width - 3)), F.lit("..."))).otherwise(one)


def unit_preview(text: Column, width: int = 240) -> Column:
    """The collapsed text, cut to ``width`` characters."""
    return F.substring(collapse(text), 1, width)


def estimate_tokens(text: Column) -> Column:
    """How many words and signs a text has."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)))


def line_count(text: Column) -> Column:
    """How many lines a text has, one at least; a final line end begins no line."""
    return F.greatest(F.size(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")), F.lit(1))


def line_slice(text: Column, start: Column, stop: Column) -> Column:
    """The lines from ``start`` to ``stop``, which count from 1; empty beyond the end."""
    return F.array_join(F.slice(F.split(text, "\n"), start, F.greatest(stop - start + 1, F.lit(0))), "\n")


def answer_key(text: Column) -> Column:
    """An answer's text with all but ASCII words, and the signs of paths and names, as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9_:/.\-]+", " "))


def path_key(path: Column) -> Column:
    """A path to be compared: trimmed, without leading ``./``, lower-cased."""
    return F.lower(F.regexp_replace(F.trim(path), r"^(\./)+", ""))


def generated(path: Column) -> Column:
    """Whether a path is that of a generated or vendored file."""
    parts = F.concat(F.lit("/"), path, F.lit("/")).rlike("/(" + "|".join(GENERATED_PARTS) + ")/")
    ending = path.rlike("(" + "|".join(e.replace(".", r"\.") for e in GENERATED_ENDINGS) + ")$")
    return parts | ending


def extension(path: Column) -> Column:
    """The lower-cased ending of a path's last segment, without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """The language of a file by its name; ``Other`` for one that is not listed."""
    listed = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(path.rlike("(^|/)Dockerfile$"), "Dockerfile").otherwise(F.coalesce(F.try_element_at(listed, extension(path)), F.lit("Other")))


def path_prefixes(path: Column) -> Column:
    """All proper ancestors of a path, the longest last, after ``.`` for the root."""
    parts = F.split(path, "/")
    inner = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    return F.concat(F.array(F.lit(".")), F.coalesce(inner, F.array().cast("array<string>")))


def parent(path: Column) -> Column:
    """The deepest ancestor of a path, ``.`` at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def within(path: Column, prefix: Column) -> Column:
    """Whether a path is ``prefix`` or lies below it; a prefix ends where a segment does."""
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def name_matches(qualified: Column, query: Column) -> Column:
    """Whether a qualified name ends with, or holds as whole segments, another one; case does not count."""
    name, asked = F.lower(qualified), F.lower(query)
    return (name == asked) | name.endswith(F.concat(F.lit("::"), asked)) | F.concat(F.lit("::"), name, F.lit("::")).contains(F.concat(F.lit("::"), asked, F.lit("::")))


def ngrams(toks: Column, sizes: tuple[int, ...] = (2, 3), least: int = 3) -> Column:
    """The whole sequence and, where it has ``least`` tokens or more, its runs of each size; distinct, in this order."""
    runs = [
        F.when((F.size(toks) >= least) & (F.size(toks) >= n), F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda k, n=n: F.array_join(F.slice(toks, k, n), " "))).otherwise(F.array().cast("array<string>"))
        for n in sizes
    ]
    return F.filter(F.array_distinct(F.concat(F.array(F.array_join(toks, " ")), *runs)), lambda t: t != "")


def plain_type(text: Column, nested: int = 4) -> Column:
    """A type's name without reference, lifetime, ``mut``, ``dyn`` and parameters, nested ones up to a depth."""
    out = text
    for _ in range(nested):
        out = F.regexp_replace(out, "<[^<>]*>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"^[&\s]+('\w+\s+)?", ""), r"^((mut|dyn)\s+)+", ""))


def symbol_tags(path: Column, kind: Column, is_test: Column) -> Column:
    """The words of a symbol's path, its kind and what it is besides; distinct, in this order."""
    nothing = F.array().cast("array<string>")
    return F.array_distinct(F.concat(path_terms(path), F.array(kind), F.when(is_test, F.array(F.lit("test"))).otherwise(nothing), F.when(kind == "impl", F.array(F.lit("impl"))).otherwise(nothing)))


def body_kind(kind: Column) -> Column:
    return F.when(kind.isin("fn", "function", "method"), "function_body").when(kind.isin("struct", "enum", "trait", "impl", "type"), "type_body")


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/]+)", 1)


def url_path(url: Column) -> Column:
    """A URL as a path: host and path without scheme, query and fragment, no slash at the end."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://|[?#].*$", ""), "/+$", "")
