"""Registered queries against their SQL on the smallest tables, and their schemas."""

import os

import duckdb
import pytest

from srcquarry.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    rel = db.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    assert got == rows_of(rel.columns, rel.fetchall())


def test_lines_of_every_chunk(spark, tmp_path):
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    bodies = ["", "a", "\r\n", "a\n\r\n\rb"] + [f"a{e}b{e}{e}" for e in ends] + [f"a{e}b" for e in ends]
    rows = list(enumerate([*bodies, None]))
    spark.createDataFrame(rows, "chunk_id long, body string").write.parquet(f"{tmp_path}/chunk.parquet")
    got = {r.chunk_id: (r.lines, r.chars, r.blank) for r in registry.queries()["lines_of_all_chunks"](spark, str(tmp_path)).collect()}
    assert got == {i: (None, None, None) if b is None else (len(b.splitlines()), len(b), not b.strip()) for i, b in rows}


def test_fenced_texts_of_either_mark(spark, tmp_path):
    rows = [("tildes", "a\n~~~\nb\n~~~\nc\n"), ("ticks", "```\nb\n```\nc"), ("none", "a\nb\n")]
    spark.createDataFrame(rows, "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.lines, r.fenced) for r in registry.queries()["fenced_texts"](spark, str(tmp_path)).collect()}
    assert got == {"tildes": (5, 3), "ticks": (4, 3)}
