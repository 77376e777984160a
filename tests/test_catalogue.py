"""Each query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from corvane import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = lambda found: sorted(map(repr, found))
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want.fetchall())


def test_units_hold_their_text_and_their_bounds(spark):
    rows = catalogue.QUERIES["chunk_units_lines"](spark, DATA).collect()
    assert rows and len({r.unit_id for r in rows}) == len(rows)
    for r in rows:
        assert r.content.strip() == r.content != "" and r.char_count <= 10_000
        assert r.token_estimate <= (350 if r.unit_kind in ("line_window", "function_body") else 900)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
