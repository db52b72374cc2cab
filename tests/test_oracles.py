"""Every query that SQL can express, against that SQL in DuckDB on the smallest tables."""

import math
import os

import pytest

from isoweave.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "nation orders lineitem"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        p = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _rows(names, rows, order):
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted(tuple(repr(clean(r[names.index(c)])) for c in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    assert _rows(df.columns, [tuple(r) for r in df.collect()], order) == _rows(list(want.columns), want.fetchall(), order)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
