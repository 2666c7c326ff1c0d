"""Every registered query against its SQL counterpart on the smallest data set."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import canonical

COUNTERPARTS = entry.oracle_sql()
# learned and iterative operators have no counterpart in SQL; their own tests compare them with plain versions
QUERIES = {name: query for name, query in entry.queries().items() if name not in entry.TEXT_QUERIES or name in COUNTERPARTS}


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    got = sorted(canonical(r.asDict()) for r in df.collect())
    assert name in COUNTERPARTS
    cur = con.execute(COUNTERPARTS[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(canonical(dict(zip(names, r, strict=True))) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
