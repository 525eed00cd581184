"""Every registered query of the engine against its SQL, on the smallest tables."""

import datetime as dt
import os
from decimal import Decimal

import duckdb
import pytest

from barloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (float, Decimal)):
        return round(float(x), 5) + 0.0
    return x.isoformat() if isinstance(x, (dt.date, dt.datetime)) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in rows), key=str)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name not in registry.ORACLE_SQL:
        assert df.columns
        return
    cur = db.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows_of(columns, cur.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=2e-5) if all(isinstance(x, (int, float)) for x in g + w) else g == w


def test_plans_keep_their_shape(spark):
    """The as-of join adds one exchange; scans prune and push down."""
    plan = registry.QUERIES["S5_projected_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_discount,0.05)" in plan and "l_comment" not in plan and "l_tax" not in plan
    every = [q(spark, SF)._jdf.queryExecution().executedPlan().toString() for q in registry.QUERIES.values()]
    assert not any("CartesianProduct" in p for p in every)
