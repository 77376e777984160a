"""Symbols, imports and statements of Rust sources.

A source is read once, character by character of interest: comments, strings and attributes are blanked first, in one
pass of a pattern, so that braces and words are those of code alone. Items are then found by a stack of open braces.
Files do not depend on each other; each is parsed by itself where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is no code, the openings of items, and kinds of statements by their first word.
NO_CODE = re.compile(r'//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|$)|b?r(#*)"(?:.|\n)*?"\1|b?"(?:\\.|[^"\\])*(?:"|$)|b?\'(?:\\[^\n]{1,10}?|[^\\\'\n])\'')
ITEM = re.compile(
    r"(?P<vis>\bpub(?:\s*\([^)]*\))?\s+)?(?:(?:default|async|const|unsafe|extern(?:\s+)?)\s+)*"
    r"(?:\b(?P<kind>fn|struct|enum|union|trait|mod|const|static|type|macro_rules!)\s+(?:mut\s+)?(?P<name>[A-Za-z_]\w*)|\b(?P<impl>impl)\b(?P<head>[^{;]*)|\buse\s+(?P<use>[^;]+);)"
)
KINDS = {"fn": "function", "mod": "module", "macro_rules!": "macro", "union": "struct"}
FIRST = ("let", "if", "match", "for", "while", "loop", "return")
ASSIGN = re.compile(r"^([A-Za-z_][\w.]*(?:\[[^\]]*\])?)\s*(?:[-+*/%&|^]|<<|>>)?=(?!=)")
CALL = re.compile(r"([A-Za-z_][\w:]*)\s*(?:::<[^>]*>)?\(")
NAME = re.compile(r"(?<![\w.:])([a-z_]\w*)(?!\s*[(:!]|\w)")
WORDS = frozenset("as async await box break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self static struct super trait true type unsafe use where while".split())

SYMBOL = "path string, symbol_id int, kind string, name string, qualified_name string, container int, visibility string, start_line int, end_line int, signature string, impl_target string, impl_trait string, super_traits array<string>, is_test boolean"
IMPORT = "path string, target string, alias string, line int"
STATEMENT = "path string, symbol_id int, ord int, line int, kind string, depth int, parent int, text string, defines array<string>, writes array<string>, calls array<string>, reads array<string>"


def code_of(source: str) -> str:
    """The source with comments and the insides of strings as blanks; lines and places stay."""
    blank = lambda m: re.sub(r"[^\n]", " ", m.group()) if m.group()[:1] == "/" else '"' + re.sub(r"[^\n]", " ", m.group()[1:-1]) + '"'
    return NO_CODE.sub(blank, source)


def use_targets(text: str) -> list[tuple[str, str | None]]:
    """``path, alias`` of each name that a use declaration brings in; braces may nest."""
    out: list[tuple[str, str | None]] = []

    def walk(prefix: str, part: str) -> None:
        part = part.strip()
        brace = part.find("{")
        if brace >= 0 and part.endswith("}"):
            head, depth, first = prefix + part[:brace].strip(), 0, brace + 1
            for k in range(brace + 1, len(part)):
                depth += (part[k] == "{") - (part[k] == "}")
                if (part[k] == "," and depth == 0) or k == len(part) - 1:
                    walk(head, part[first:k])
                    first = k + 1
            return
        name, _, alias = (x.strip() for x in part.partition(" as "))
        whole = (prefix + name).removesuffix("::self") if name != "self" else prefix.removesuffix("::")
        if whole:
            out.append((re.sub(r"\s+", "", whole), alias or None))

    walk("", text)
    return out


def plain_type(text: str) -> str:
    """A type without references, lifetimes and parameters."""
    text = re.sub(r"^\s*(?:&\s*(?:'\w+\s*)?)?(?:mut\s+|dyn\s+)*", "", text)
    while "<" in text and (inner := re.sub(r"<[^<>]*>", "", text)) != text:
        text = inner
    return text.split(" where ")[0].strip()


def parse(source: str, module: str = "") -> tuple[list[dict], list[tuple], list[tuple[int, int, int]]]:
    """Symbols, imports (``target, alias, line``) and the bodies of functions (``symbol, first, last`` character)."""
    code = code_of(source)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]

    def line_of(at: int) -> int:
        import bisect

        return bisect.bisect_right(starts, at)

    closing, stack = {}, []
    for m in re.finditer(r"[{}]", code):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            closing[stack.pop()] = m.start()
    symbols, imports, bodies, around = [], [], [], []  # around: symbol and end of each item that is open
    at = 0
    while m := ITEM.search(code, at):
        at = m.end()
        while around and around[-1][1] <= m.start():
            around.pop()
        if m["use"]:
            imports += [(target, alias, line_of(m.start())) for target, alias in use_targets(m["use"])]
            continue
        owner = around[-1][0] if around else None
        up = symbols[owner] if owner is not None else None
        if up and up["kind"] in ("function", "method", "associated_function") and not m["kind"] in ("fn", "struct", "enum", "trait", "impl"):
            continue
        opens, ends = code.find("{", at), code.find(";", at)
        body = opens >= 0 and (ends < 0 or opens < ends) and not (m["kind"] in ("const", "static", "type"))
        if m["kind"] in ("const", "static", "type"):
            last = ends if ends >= 0 else len(code) - 1
        else:
            last = closing.get(opens, len(code) - 1) if body else ends if ends >= 0 else len(code) - 1
        head = re.sub(r"\s+", " ", source[m.start() : opens if body else last + 1]).strip()
        target = trait = None
        supers: list[str] = []
        if m["impl"]:
            if not body:
                continue
            whole = re.sub(r"^\s*<(?:[^<>]|<[^<>]*>)*>", "", m["head"])
            left, _, right = whole.partition(" for ")
            trait, target = (plain_type(left), plain_type(right)) if right else (None, plain_type(left))
            kind, name, qualified = "impl", target, "::".join(x for x in (module, target) if x)
        else:
            kind, name = KINDS.get(m["kind"], m["kind"]), m["name"]
            if kind == "function" and up and up["kind"] in ("impl", "trait"):
                kind = "method" if re.search(r"\(\s*(?:&\s*)?(?:'\w+\s+)?(?:mut\s+)?self\b", head) else "associated_function"
            base = up["qualified_name"] if up else module
            qualified = "::".join(x for x in (base, name) if x)
            if kind == "trait" and (found := re.match(r"[^:{]*:(?!:)([^{]*?)(?:\bwhere\b|$)", head)):
                supers = [plain_type(x) for x in found[1].split("+") if x.strip() and not x.strip().startswith("'")]
        vis = re.sub(r"\s+", "", m["vis"]) if m["vis"] else "private"
        before = source[max(0, m.start() - 200) : m.start()]
        test = bool(re.search(r"#\[[^\]]*\btest\b[^\]]*\]\s*(?:#\[[^\]]*\]\s*)*$", before)) or bool(up and up["is_test"])
        first = m.start() + len(m.group()) - len(m.group().lstrip())
        symbols.append({"symbol_id": len(symbols), "kind": kind, "name": name, "qualified_name": qualified, "container": owner, "visibility": vis, "start_line": line_of(first), "end_line": line_of(last), "signature": head, "impl_target": target, "impl_trait": trait, "super_traits": supers, "is_test": test})
        if body:
            if kind in ("function", "method", "associated_function"):
                bodies.append((len(symbols) - 1, opens + 1, last))
            around.append((len(symbols) - 1, last))
            at = opens + 1
    return symbols, imports, bodies


def statements(source: str, first: int, last: int) -> list[dict]:
    """The statements of a body, line by line: kind, depth and parent by open braces, what they define, write, call, read."""
    code, out, open_ = code_of(source)[first:last], [], []
    line, depth = source.count("\n", 0, first) + 1, 0
    for k, raw in enumerate(code.split("\n")):
        text = raw.strip()
        lead = len(text) - len(text.lstrip("}"))
        level = depth - lead
        while open_ and open_[-1][1] >= max(level, 0) + 1:
            open_.pop()
        bare = re.sub(r"\s*\{$", "", text.lstrip("} ").rstrip("; ")).strip()
        depth += text.count("{") - text.count("}")
        if not bare or bare in ("else", ")", "("):
            continue
        word = re.match(r"(?:else\s+)?([a-z]+)\b", bare)
        kind = word[1] if word and word[1] in FIRST else "assign" if ASSIGN.match(bare) else "expr"
        defines = re.findall(r"\blet\s+(?:mut\s+)?([a-z_]\w*)", bare) + re.findall(r"\bfor\s+([a-z_]\w*)\s+in\b", bare)
        writes = [w[1] for w in [ASSIGN.match(bare)] if w and kind == "assign"]
        calls = [c for c in CALL.findall(bare) if c not in WORDS]
        known = {*defines, *writes, *WORDS}
        reads = list(dict.fromkeys(n for n in NAME.findall(re.sub(r'"[^"]*"', " ", bare)) if n not in known))
        out.append({"ord": len(out), "line": line + k, "kind": kind, "depth": len(open_), "parent": open_[-1][0] if open_ else None, "text": bare, "defines": defines, "writes": writes, "calls": list(dict.fromkeys(calls)), "reads": reads})
        if text.endswith("{") and kind in ("if", "match", "for", "while", "loop"):
            open_.append((len(out) - 1, depth))
    return out


def _table(files: DataFrame, schema: str, rows) -> DataFrame:
    names = [f.split()[0] for f in re.split(r", (?=[a-z_]+ )", schema)]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    types = [kinds[f.split()[1]] for f in re.split(r", (?=[a-z_]+ )", schema)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{"path": p, **r} for p, m, text in zip(*(c.to_pylist() for c in batch.columns)) for r in rows(text or "", m or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types)], names)

    return files.select("path", "module", F.col("source").cast("string")).mapInArrow(of, schema)


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of ``files`` (``path, module, source``); a null source has none."""
    return _table(files, SYMBOL, lambda text, module: parse(text, module)[0])


def imports(files: DataFrame) -> DataFrame:
    return _table(files, IMPORT, lambda text, module: [{"target": t, "alias": a, "line": n} for t, a, n in parse(text, module)[1]])


def all_statements(files: DataFrame) -> DataFrame:
    return _table(files, STATEMENT, lambda text, module: [{"symbol_id": s, **r} for s, a, b in parse(text, module)[2] for r in statements(text, a, b)])
