"""The parser of Rust sources on our own small ones."""

from corvane.sources import rust

SOURCE = '''use std::{collections::{HashMap, hash_map::Entry as Slot}, fmt::{self}};
use crate::shape::Area;

/* a comment with fn not_code() { } */
/// Measures.
pub trait Measure: Area + Send {
    fn size(&self) -> u32;
    fn zero() -> Self where Self: Sized;
}

#[derive(Debug)]
pub(crate) struct Tile<'a, T> { pub side: u32, tag: &'a str, more: Vec<T> }

enum Side { Left, Right(u8) }

impl<'a, T: Clone> Measure for Tile<'a, T> {
    fn size(&self) -> u32 {
        let text = "braces { in } strings; fn x()";
        let mut total = self.side * 2;
        if total > LIMIT {
            total = clamp(total, text.len());
        } else {
            total += 1;
        }
        for k in 0..3 {
            total = step(total, k);
        }
        total
    }
    fn zero() -> Self { make() }
}

const LIMIT: u32 = 10;

mod inner {
    pub fn helper(x: &str) -> usize { x.len() }

    #[test]
    fn checks() { assert_eq!(helper("a"), 1); }
}
'''


def test_symbols_imports_and_statements(spark):
    files = spark.createDataFrame([("a.rs", "app", SOURCE), ("b.rs", "app::b", None), ("c.rs", "", "fn broken( {")], "path string, module string, source string")
    got = {(r.path, r.kind, r.qualified_name): r for r in rust.symbols(files).collect()}
    names = {k[1:] for k in got if k[0] == "a.rs"}
    assert names == {
        ("trait", "app::Measure"), ("method", "app::Measure::size"), ("associated_function", "app::Measure::zero"), ("struct", "app::Tile"), ("enum", "app::Side"), ("impl", "app::Tile"),
        ("method", "app::Tile::size"), ("associated_function", "app::Tile::zero"), ("const", "app::LIMIT"), ("module", "app::inner"), ("function", "app::inner::helper"), ("function", "app::inner::checks"),
    }
    assert got["a.rs", "trait", "app::Measure"].super_traits == ["Area", "Send"] and got["a.rs", "struct", "app::Tile"].visibility == "pub(crate)"
    held = got["a.rs", "impl", "app::Tile"]
    assert (held.impl_trait, held.impl_target) == ("Measure", "Tile") and (held.start_line, held.end_line) == (16, 31)
    assert got["a.rs", "function", "app::inner::checks"].is_test and not got["a.rs", "function", "app::inner::helper"].is_test
    assert [(r.target, r.alias) for r in rust.imports(files).collect()] == [("std::collections::HashMap", None), ("std::collections::hash_map::Entry", "Slot"), ("std::fmt", None), ("crate::shape::Area", None)]
    rows = [r for r in rust.all_statements(files).collect() if r.path == "a.rs" and 17 < r.line < 29]
    assert [(r.kind, r.depth) for r in rows] == [("let", 0), ("let", 0), ("if", 0), ("assign", 1), ("assign", 0), ("for", 0), ("assign", 1), ("expr", 0)]
    assert rows[1].defines == ["total"] and rows[3].writes == ["total"] and rows[3].calls[0] == "clamp"
    assert rows[6].parent == rows[5].ord and "k" in rows[6].reads


def test_code_keeps_lines_and_places():
    text = "a // x {\nb \"c } \\\" d\" e /* { \n */ f r#\"{\"# 'x' '\\''"
    code = rust.code_of(text)
    assert len(code) == len(text) and code.count("\n") == 2 and "{" not in code and "}" not in code


def test_use_declarations_nest():
    assert rust.use_targets("a::{b, c as d, e::{self, f::*}}") == [("a::b", None), ("a::c", "d"), ("a::e", None), ("a::e::f::*", None)]
