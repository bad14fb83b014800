"""Every registered query with an oracle matches DuckDB on sf0.001."""

from collections import Counter

import duckdb
import pytest

from ticketscope.plans.fixtures import TABLES
from ticketscope.plans.registry import all_queries

QS = all_queries()
ORACLE = sorted(n for n, q in QS.items() if q.sql is not None)


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ORACLE)
def test_matches_duckdb(spark, sf, con, name):
    q = QS[name]
    df = q.spark(spark, sf)
    s_cols = df.columns
    s_rows = _rows(s_cols, [tuple(r) for r in df.collect()])
    res = con.execute(q.oracle())
    d_cols = [d[0] for d in res.description]
    assert sorted(s_cols) == sorted(d_cols)
    assert s_rows == _rows(d_cols, res.fetchall())
