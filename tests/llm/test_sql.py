"""Operators that SQL can express give DuckDB's rows on the small tables and on awkward documents."""

import math
import os

import brute
import duckdb
import pytest

from readtrim.llm import queries

SF = "/root/testdata/sf0.001"


def cell(v):
    return ("nan" if math.isnan(v) else f"{v:.6g}") if isinstance(v, float) else str(v)


def compared(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) <= sorted(df.columns)
    want = sorted(tuple(cell(v) for v in r) for r in cur.fetchall())
    got = sorted(tuple(cell(r[c]) for c in names) for r in df.select(*names).collect())
    assert got == want
    return got


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", queries.SQL)
def test_small_tables(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    assert compared(df, duck, queries.SQL[name])
    names = [d[0] for d in duck.execute(queries.SQL[name]).description]
    assert sorted(names) == sorted(df.columns)


@pytest.mark.parametrize("name", [n for n in queries.SQL if n not in ("op1_warc_segments", "op5_html_template")])
@pytest.mark.parametrize("rows", [brute.ROWS, []], ids=["awkward", "empty"])
def test_awkward_documents(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, brute.SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    compared(queries.QUERIES[name](spark, str(tmp_path)), con, queries.SQL[name])
