"""Readers and stores on small trees and files."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corvane.sources import inventory, providers
from corvane.sources.store import Store


@pytest.fixture
def tree(tmp_path):
    held = {
        "Cargo.toml": '[workspace]\nmembers = ["crates/*", "tools"]\n\n[profile.release]\n', "crates/one/Cargo.toml": '[package]\nname = "one"\n', "crates/one/src/lib.rs": "pub fn a() {}\n",
        "crates/one/src/deep/mod.rs": "fn b() {}\n", "crates/two/src/main.rs": "fn main() {}\n", "tools/run.py": "x = 1\n", "web/package.json": '{"name": "w", "workspaces": ["a"]}', "target/out.rs": "no", "crates/one/gen/x.rs": "generated",
        "Dockerfile": "FROM x", "README": "hello",
    }
    for path, text in held.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def test_inventory(spark, tree):
    files = inventory.scan(spark, str(tree))
    got = {r.path: r for r in files.collect()}
    assert "target/out.rs" not in got and got["Dockerfile"].language == "Dockerfile" and got["README"].language == "Other" and got["crates/one/gen/x.rs"].generated
    assert got["tools/run.py"].size == 6 and got["tools/run.py"].content_hash == hashlib.sha1(b"x = 1\n").hexdigest()
    found = {r.path: (r.kind, r.name, r.members) for r in inventory.manifests(files).collect()}
    assert found["Cargo.toml"] == ("cargo-workspace", "", ["crates/*", "tools"]) and found["crates/one/Cargo.toml"][:2] == ("cargo-package", "one") and found["web/package.json"] == ("node-workspace", "w", ["a"])
    roots = {r.root for r in inventory.member_roots(inventory.manifests(files), inventory.folders(files)).collect()}
    assert roots == {"crates/one", "crates/two", "tools"}  # there is no folder web/a
    assert [r.path for r in inventory.selected(files, ["crates/one"]).collect()] == ["crates/one/src/deep/mod.rs", "crates/one/src/lib.rs"]
    made = files.select(inventory.module_path(F.col("path"), F.lit("crates/one"), F.lit("one")).alias("m"), "path").filter("path like 'crates/one/src%'").collect()
    assert {r.m for r in made} == {"one", "one::deep"}
    inventory.write(files, f"{tree}/.out")
    assert inventory.read(spark, f"{tree}/.out", "languages").filter("language = 'Rust'").first().files == 4


def test_tags_and_matches(spark):
    tag = {"_type": "tag", "name": "go", "path": "a.go", "language": "Go", "kind": "func", "scope": "pkg", "line": 3, "pattern": "/^func go() {\\/x$/"}
    lines = spark.createDataFrame([(json.dumps(tag),), (json.dumps(tag),), ("not json",), ("",), ('{"_type": "ptag"}',)], "value string")
    got = providers.tags(lines, "r").collect()
    assert len(got) == 1 and got[0].qualified_name == "pkg::go" and got[0].end_line == 3 and got[0].signature == "func go() {/x" and providers.rows(lines, providers.TAG).filter("broken").count() == 1
    hit = {"FileName": "x.rs", "Repository": "r", "Score": 2, "LineMatches": [{"LineNumber": 4, "Line": base64.b64encode("né".encode()).decode(), "Score": 1.0}]}
    (row,) = providers.matches(spark.createDataFrame([(json.dumps(hit),)], "value string")).collect()
    assert (row.path, row.line_number, row.preview) == ("x.rs", 4, "né")


def test_scip(spark):
    payload = {"documents": [
        {"relative_path": "a.ts", "language": "ts", "symbols": [{"symbol": "p a/f().", "kind": "Function", "display_name": "f", "relationships": [{"symbol": "p a/I#", "is_implementation": True}]}],
         "occurrences": [{"symbol": "p a/f().", "symbol_roles": 1, "range": [0, 4, 9], "enclosing_range": [0, 0, 5, 1]}, {"symbol": "p b/g().", "range": [2, 1, 4]}]},
        {"relative_path": "b.ts", "occurrences": [{"symbol": "p b/g().", "symbol_roles": 1, "range": [7, 0, 3]}]},
    ]}
    table = spark.createDataFrame([(json.dumps(payload),)], "value string").select(F.from_json("value", providers.SCIP).alias("p")).select("p.*")
    symbols, refs, relations = providers.scip(table, "r")
    got = {r.qualified_name: (r.name, r.path, r.start_line, r.end_line) for r in symbols.collect()}
    assert got == {"p a/f().": ("f", "a.ts", 1, 6), "p b/g().": ("g", "b.ts", 8, 8)}
    assert [(r.path, r.line, r.target_id is not None) for r in refs.collect()] == [("a.ts", 3, True)]
    assert [tuple(r) for r in relations.collect()] == [("p a/f().", "p a/I#", "IMPLEMENTS")]


def test_cases(spark, tmp_path):
    good = {"name": "n", "repo": "r", "query": "q", "expected_path": "a.rs"}
    (tmp_path / "a.jsonl").write_text("# note\n\n" + json.dumps(good) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"cases": [good, good | {"name": "m", "expected_paths": ["x", "y"]}]}))
    (tmp_path / "c.jsonl").write_text(json.dumps({"name": "n", "repo": "r", "query": ""}))
    assert [r.expected_paths for r in providers.cases(spark, f"{tmp_path}/a.jsonl").collect()] == [["a.rs"]]
    assert [(r.name, r.expected_paths) for r in providers.cases(spark, f"{tmp_path}/b.json").collect()] == [("n", ["a.rs"]), ("m", ["x", "y"])]
    with pytest.raises(Exception, match="lacks"):
        providers.cases(spark, f"{tmp_path}/c.jsonl").collect()


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    symbols = spark.createDataFrame([("s2", "m::b", "b", "src/b.rs"), ("s1", "m::a", "a", "src/a.rs"), ("s3", "n::a", "a", "srcx/c.rs")], "symbol_id string, qualified_name string, name string, path string")
    statements = spark.createDataFrame([("s1", 2, "y"), ("s1", 1, "x")], "symbol_id string, ord int, text string")
    store.write_bundle(symbols, statements)
    assert [r.symbol_id for r in store.resolve("name", "a").collect()] == ["s1", "s3"] and store.get("symbols", "symbol_id", ["s1", "none"]).count() == 1
    assert store.get("bodies", "symbol_id", ["s1"]).first().statements == ["x", "y"]
    assert [r.path for r in store.with_prefix("symbols", "path", "src/", 9).collect()] == ["src/a.rs", "src/b.rs"]
    assert store.get_case("c", "f") is None
    store.put_case("c", "f", "one")
    store.put_case("c", "g", "two")
    assert store.get_case("c", "f") == "one" and store.get_case("c", "h") is None
    for status in ("running", "failed", "running", "completed"):
        store.mark("r1", status)
    assert store.table("builds").first().attempts == 2
    assert [r.repo for r in store.pending(spark.createDataFrame([("r1",), ("r2",)], "repo string")).collect()] == ["r2"]
    nodes = spark.createDataFrame([("n1", "file", 5), ("n1", "file", 4), ("n2", "symbol", 6)], "node_id string, kind string, size int")
    edges = spark.createDataFrame([("e1", "CALLS", "n1", "n2"), ("e1", "CALLS", "n1", "n2"), ("e2", "READS", "n1", "n2")], "edge_id string, edge_type string, src string, dst string")
    store.write_graph(nodes, edges)
    assert store.table("nodes").count() == 2 and store.table("edges").count() == 2 and {r.edge_type for r in store.edge_types().collect()} == {"CALLS", "READS"}


def test_search_on_a_written_index(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = [("d1", "symbol", "src/ring/a.rs", "small_ring", "x::small_ring", "struct small_ring", "holds a ring"), ("d2", "file", "src/ring", "ring", "", "ring file", "nothing"), ("d3", "symbol", "srcx/b.rs", "bolt", "x::bolt", "bolt", "a ring of bolts")]
    docs = spark.createDataFrame(rows, "doc_id string, kind string, path string, name string, qualified_name string, title string, content string")
    store.write_search(docs)
    assert {r.doc_id for r in store.search("ring", 5).collect()} == {"d1", "d2", "d3"}
    assert [r.doc_id for r in store.search("ring", 5, kinds=["symbol"], prefix="src/").collect()] == ["d1"]
    assert [r.doc_id for r in store.search(" ?! ", 2).collect()] == ["d1", "d2"]
    page, total, following = store.page(1, 1)
    assert [r.doc_id for r in page.collect()] == ["d2"] and total == 3 and following == 2
    assert store.add_vectors(docs.filter("doc_id <> 'd3'"), "m") == 2 and store.add_vectors(docs, "m") == 1 and store.table("vectors").count() == 3
