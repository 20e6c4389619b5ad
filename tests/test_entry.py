"""The entry module, and the registered queries with SQL against DuckDB at the smallest scale."""

import collections
import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == cols
    assert got == collections.Counter(tuple(plain(r[at[c]]) for c in cols) for r in cur.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
