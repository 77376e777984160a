"""Staged retrieval over a small written store."""

import pytest

from corvane.operators import retrieval
from corvane.sources.store import Store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    out = Store(spark, f"file://{tmp_path_factory.mktemp('store')}/s")
    rows = [
        ("f1", "file", "src/ring/a.rs", "a.rs", None, None, "ring file", "rings of all sizes"), ("f2", "file", "src/bolt/b.rs", "b.rs", None, None, "bolt file", "bolts"),
        ("s1", "symbol", "src/ring/a.rs", "SmallRing", "app::ring::SmallRing", "sym:1", "struct SmallRing", "a small ring"), ("s2", "symbol", "src/ring/a.rs", "grow", "app::ring::grow", "sym:2", "fn grow", "makes a ring larger"),
        ("s3", "symbol", "src/bolt/b.rs", "Bolt", "app::bolt::Bolt", "sym:3", "struct Bolt", "holds"), ("b1", "type_body", "src/ring/a.rs", "SmallRing", "app::ring::SmallRing", "sym:1", "body", "pub struct SmallRing { size: u32 }"),
        ("d1", "doc", "docs/guide.md", "guide.md", None, None, "guide to rings", "how to use a ring"),
    ]
    out.write_search(spark.createDataFrame(rows, "doc_id string, kind string, path string, name string, qualified_name string, symbol_id string, title string, content string"))
    out.write_graph(spark.createDataFrame([(f"sym:{k}", "symbol") for k in (1, 2, 3)], "node_id string, kind string"), spark.createDataFrame([("e1", "CALLS", "sym:2", "sym:1"), ("e2", "CALLS", "sym:1", "sym:3")], "edge_id string, edge_type string, src string, dst string"))
    out.write_bundle(spark.createDataFrame([(f"sym:{k}", f"q{k}", f"n{k}") for k in (1, 2, 3)], "symbol_id string, qualified_name string, name string"), spark.createDataFrame([("sym:1", 1, "let x = 1")], "symbol_id string, ord int, text string"))
    return out


def test_profiles_and_plans(store):
    assert retrieval.profile(store, "SmallRing")["intent"] == "symbol" and retrieval.profile(store, "overview of the whole ring code")["intent"] == "docs"
    found = retrieval.plan(store, "where do rings get larger in this program")
    assert found["profile"]["intent"] == "exploration" and "graph_neighbors" in found["recipe"] and found["stopping"]["max_graph_expansions"] == 32
    assert retrieval.plan(store, "docs of rings")["recipe"][-1] == "answer_bundle" and "body_hydration" not in retrieval.plan(store, "docs of rings")["recipe"]


def test_retrieval_puts_the_named_symbol_first(store):
    got = retrieval.retrieve(store, "SmallRing", limit=5).collect()
    assert got[0].symbol_id == "sym:1" and "exact" in got[0].reasons and len({(r.kind, r.identity) for r in got}) == len(got)
    wide = retrieval.retrieve(store, "how does a small ring grow larger over there", limit=9).collect()
    assert {"sym:1", "sym:2", "sym:3"} <= {r.symbol_id for r in wide} and any("graph" in r.reasons for r in wide) and any(r.kind == "type_body" for r in wide)
    assert retrieval.retrieve(store, "zzzz qqqq wwww", limit=5).count() == 0


def test_bundles_and_refinement(store):
    one = retrieval.bundle(store, "how does a small ring grow larger over there")
    assert one["summary"]["selected_context"] == len(one["context"]) > 0 and one["neighbours"] and one["slices"][0]["statements"] == ["let x = 1"]
    assert all(c["explanation"].startswith("Included") for c in one["context"]) and len({tuple(e.values()) for e in one["evidence"]}) == len(one["evidence"])
    assert retrieval.hints_of(one) and retrieval.hints_of(None) == []
    assert retrieval.refine(store, "bolts", one)["task"] == "bolts"


def test_benchmark_of_cases_and_modes(spark, store):
    cases = spark.createDataFrame([("c1", "SmallRing", ["src/ring/a.rs"], ["app::ring::SmallRing"]), ("c2", "bolts", ["src/bolt/b.rs"], [])], "name string, query string, expected_paths array<string>, expected_symbols array<string>")
    got = {(r.case_id, r.mode): r for r in retrieval.benchmark(store, cases, limit=5).collect()}
    assert set(got) == {(c, m) for c in ("c1", "c2") for m in ("lexical", "staged")}
    assert got["c1", "staged"].first_rank == 1 and got["c1", "staged"].recall_at_5 == 1.0 and got["c2", "lexical"].mrr == 1.0
