"""Functions and operators on small rows, against hand-made results."""

from pyspark.sql import functions as F

from corvane.functions import numbers as N
from corvane.functions import text as T
from corvane.operators import graph, lexical, rollup, units


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_words_names_and_paths(spark):
    got = one(spark, T.tokens(F.lit("Foo::bar-Baz a.b/c_d  (x) é!")), T.identifier_terms(F.lit("parseHTTPServer2Go_x::y")), T.path_terms(F.lit("src/my-lib/lib.parser.rs")), T.path_prefixes(F.lit("a/b/c.rs")), T.parent(F.lit("a")))
    assert got[0] == ["foo", "bar", "baz", "a", "b", "c_d", "x", "é"] and got[1] == ["parse", "httpserver2", "go", "x", "y"]
    assert got[2] == ["src", "my", "lib", "parser"] and got[3] == [".", "a", "a/b"] and got[4] == "."
    assert lexical.words("Foo::bar-Baz a.b/c_d  (x) é!") == got[0]


def test_nulls_have_defined_results(spark):
    null = F.lit(None).cast("string")
    got = one(spark, T.tokens(null), T.estimate_tokens(null), T.line_count(null), T.preview(null), T.path_terms(null), N.confidence(F.lit(None).cast("double")))
    assert tuple(got) == ([], 0, 1, None, [], 0.5)


def test_previews_lines_and_keys(spark):
    got = one(spark, T.preview(F.lit("a  b " * 60)), T.preview(F.lit(" x\n y ")), T.line_slice(F.lit("a\nb\nc"), F.lit(2), F.lit(9)), T.line_count(F.lit("a\r\nb\n")), T.answer_key(F.lit("See `src/a.rs`: Foo::bar, ok?")), T.generated(F.lit("x/gen/y.rs")), T.generated(F.lit("x/y.pb.rs")), T.generated(F.lit("x/general.rs")))
    assert len(got[0]) <= 180 and got[0].endswith("...") and got[1] == "x y" and got[2] == "b\nc" and got[3] == 2
    assert got[4] == "see src/a.rs : foo::bar ok" or got[4] == "see src/a.rs: foo::bar ok"
    assert got[5:] == (True, True, False)


def test_variants_are_the_query_and_its_runs():
    assert lexical.variants("a b") == [["a", "b"]]
    assert [" ".join(v) for v in lexical.variants("a b c")] == ["a b c", "a b", "b c"]
    assert lexical.variants(" ?! ") == []


def test_code_windows_overlap_and_cover():
    lines = [f"let x{k} = {k};" for k in range(400)]
    spans = units.line_spans(lines)
    assert spans[0][0] == 0 and spans[-1][1] == 400 and all(b[0] < a[1] for a, b in zip(spans, spans[1:]))
    assert all(sum(len(units.TOKEN.findall(x)) for x in lines[a:b]) <= 350 for a, b in spans)
    assert units.code_units("fn a() {}") == [("fn a() {}", 1, 1)]
    long = "word " * 2000
    assert [len(units.TOKEN.findall(w)) for w in units.windows_of(long, 900)] == [900, 900, 900, 650]


def test_window_columns_equal_the_plain_ones(spark):
    texts = ["word " * 2000, "a b", "x" * 25_000, "", "é, ñ! " * 700]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", units.token_windows(F.col("t")).alias("w")).collect()
    for r in rows:
        assert [x for x in r.w if x.strip()] == [x for x in units.windows_of(texts[r.k], 900) if x.strip()] or len(texts[r.k]) > 10_000


EDGES = [("a", "b", "X"), ("b", "c", "X"), ("c", "a", "X"), ("b", "d", "Y"), ("d", "e", "X"), ("f", "g", "X"), ("c", "e", "Y")]


def test_traversal_on_a_graph_with_a_cycle(spark):
    links = spark.createDataFrame(EDGES, "src string, dst string, edge_type string")
    seeds = spark.createDataFrame([("a",)], "node string")
    met = {(r.neighbor, r.edge_type, r.depth) for r in graph.neighbors(links, seeds, direction="out", depth=3).collect()}
    assert met == {("b", "X", 1), ("c", "X", 2), ("d", "Y", 2), ("a", "X", 3), ("e", "X", 3), ("e", "Y", 3)}
    assert {(r.neighbor, r.depth) for r in graph.neighbors(links, seeds, direction="out", types=["X"], depth=9).collect()} == {("b", 1), ("c", 2), ("a", 3)}
    to = spark.createDataFrame([("e",), ("g",)], "node string")
    assert [tuple(r) for r in graph.shortest_paths(links, seeds, to, direction="out").collect()] == [("a", "e", 3, "a>b>c>e")]
    assert graph.shortest_paths(links, seeds, to.filter("node = 'g'")).count() == 0
    assert {tuple(r) for r in graph.hops(links, seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 2)}


def test_data_flow_leaves_out_the_statement_itself(spark):
    rows = spark.createDataFrame([(1, 1, True), (2, 2, True), (3, 3, False)], "id int, at int, w boolean").withColumn("g", F.lit(0))
    got = {(r.src, r.dst) for r in graph.data_flow(rows, by=["g"], order=["at"], id_col="id", writes=F.col("w")).collect()}
    assert got == {(1, 2), (2, 3)}


def test_upper_median_of_ties_and_single_rows(spark):
    rows = [("a", float(x)) for x in (5, 1, 3, 3)] + [("b", 7.0), ("c", None)] + [("d", float(k % 50)) for k in range(1000)]
    got = {r.k: (r.upper_median, r.most, r.n) for r in rollup.upper_median(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {"a": (3.0, 5.0, 4), "b": (7.0, 7.0, 1), "d": (25.0, 49.0, 1000)}
