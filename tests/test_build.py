"""A small source tree from files to answers."""

import pytest
from pyspark.sql import functions as F

from corvane import build
from corvane.operators import graph, retrieval

LIB = """use std::collections::HashMap;

pub trait Shape {
    fn area(&self) -> u32;
}

pub struct Square { side: u32 }

impl Shape for Square {
    fn area(&self) -> u32 {
        let side = self.side;
        let out = multiply(side, side);
        out
    }
}

pub fn multiply(a: u32, b: u32) -> u32 { a * b }

mod tests {
    #[test]
    fn squares() { let s = make(); total(s); }
    fn make() -> Square { Square { side: 2 } }
}
"""
OTHER = """use crate::Square;
pub fn total(s: Square) -> u32 {
    let mut sum = 0;
    for k in 0..3 {
        sum = sum + s.area();
    }
    crate::multiply(sum, 2)
}
"""


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in {"Cargo.toml": '[package]\nname = "my-shapes"\n', "src/lib.rs": LIB, "src/sums.rs": OTHER, "README.md": "# Shapes\nHow to use a square."}.items():
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(text)
    return build.build(spark, str(root), f"file://{root}/.store", "shapes")


def test_symbols_and_bodies(store):
    names = {r.qualified_name: r.kind for r in store.table("symbols").collect()}
    assert names["my_shapes::Square::area"] == "method" and names["my_shapes::sums::total"] == "function" and names["my_shapes::tests::squares"] == "function"
    assert [r.symbol_id for r in store.resolve("qualified_name", "my_shapes::multiply").collect()] and store.table("builds").first().status == "completed"


def test_edges(store):
    symbols = {r.symbol_id: r.qualified_name for r in store.table("symbols").collect()}
    found = {(r.edge_type, symbols.get(r.src, r.src), symbols.get(r.dst, r.dst)) for r in store.table("edges").collect()}
    calls = {(a, b) for kind, a, b in found if kind == "CALLS"}
    assert {("my_shapes::Square::area", "my_shapes::multiply"), ("my_shapes::sums::total", "my_shapes::multiply"), ("my_shapes::tests::squares", "my_shapes::tests::make"), ("my_shapes::tests::squares", "my_shapes::sums::total")} <= calls
    assert ("IMPLEMENTS", "my_shapes::Square", "my_shapes::Shape") in found and ("IMPORTS", "file:src/lib.rs", "dep:std") in found
    assert ("OVERRIDES", "my_shapes::Square::area", "my_shapes::Shape::area") in found and ("CONTAINS", "dir:src", "file:src/lib.rs") in found
    assert {k for k, _, _ in found} >= {"DEFINES", "DECLARES", "NEIGHBOR", "CONTROL_FLOW", "DATA_FLOW", "TESTS", "REFERENCES"}


def test_questions(spark, store):
    (target,) = [r.symbol_id for r in store.resolve("qualified_name", "my_shapes::multiply").collect()]
    types, direction = graph.OPERATIONS["callers_of"]
    met = graph.neighbors(store.table("edges").select("src", "dst", "edge_type"), spark.createDataFrame([(target,)], "node string"), types=types, direction=direction)
    callers = {r.qualified_name for r in store.table("symbols").join(met, F.col("symbol_id") == F.col("neighbor")).collect()}
    assert callers == {"my_shapes::Square::area", "my_shapes::sums::total"}
    assert retrieval.retrieve(store, "multiply", limit=3).first().symbol_id == target
    assert retrieval.bundle(store, "which functions call multiply on a square here")["neighbours"]


def run(capsys, spark, store, *argv):
    import json

    from corvane import cli

    assert cli.main([*argv, "--store", store.root], spark) == 0
    return json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_commands(capsys, spark, store):
    ask = lambda *argv: run(capsys, spark, store, *argv)
    assert {r["qualified_name"] for r in ask("callers-of", "my_shapes::multiply")} == {"my_shapes::Square::area", "my_shapes::sums::total"}
    assert ask("where-defined", "total")[0]["path"] == "src/sums.rs" and ask("find-symbol", "multiply")[0]["name"] == "multiply"
    assert ask("get-symbol-body", "total")[0]["statements"][0] == "let mut sum = 0" and ask("get-symbol-signature", "total")[0]["visibility"] == "pub"
    assert [r["qualified_name"] for r in ask("get-enclosing-context", "src/lib.rs:11")][:2] == ["my_shapes::Square::area", "my_shapes::Square"]
    assert ask("path-between", "my_shapes::tests::squares", "my_shapes::multiply", "--direction", "out", "--types", "CALLS")[0]["hop_count"] == 2
    assert [r["path"] for r in ask("find-file", "src")] == ["src/lib.rs", "src/sums.rs"] and ask("plan-query", "multiply")["profile"]["intent"] == "symbol"
    assert ask("trace-calls", "total")["callees"] and ask("summarize-path", "src")[0]["symbols"] > 3 and ask("get-summary", "src/sums.rs")[0]["summary"].startswith("File src/sums.rs")
    assert {r["language"] for r in ask("repo-overview")["languages"]} >= {"Rust", "Markdown", "TOML"}
    with pytest.raises(SystemExit, match="missing"):
        ask("callees-of", "nothing_of_this_name")
