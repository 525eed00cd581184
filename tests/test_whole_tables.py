"""Queries over all rows of a table, against brute force on small tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators.quality import QualityError
from barloom.plans import queries_joins, registry
from barloom.sources import tables as S

DAY = timedelta(days=1)
T0 = datetime(1996, 1, 1)


@pytest.fixture
def store(spark, tmp_path):
    """Line items of which no id or quantity is special, and their orders."""
    items = [(k % 3 + 100, 11.0 + k % 5, T0 + (k * k % 300) * DAY) for k in range(40)]
    orders = [(k, k % 7, "FOP"[k % 3], T0 + (k * 5 % 320) * DAY) for k in range(64)]
    spark.createDataFrame(items, "l_suppkey long, l_quantity double, l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path), items, orders


def run(spark, name, sf):
    return [tuple(r) for r in registry.QUERIES[name](spark, sf).collect()]


def test_intervals_of_all_line_items(spark, store):
    sf, items, orders = store
    assert sorted(run(spark, "P8_in_intervals", sf)) == sorted((k,) for k, _, _, at in orders if any(d <= at <= d + 2 * DAY for _, _, d in items))
    months = {((d + n * DAY).year, (d + n * DAY).month) for _, _, d in items for n in range(41)}
    assert sorted(run(spark, "S10_required_months", sf)) == sorted(months)


@pytest.mark.parametrize("name,gap", [("E8_merge_touching", 0), ("E8_merge_adjacent", 1)])
def test_merged_intervals_of_all_line_items(spark, store, name, gap):
    sf, items, _ = store
    want = []
    for key in sorted({k for k, _, _ in items}):
        for d in sorted(d for k, _, d in items if k == key):
            if want and want[-1][0] == key and d <= want[-1][2] + gap * DAY:
                want[-1] = (key, want[-1][1], max(want[-1][2], d + 3 * DAY))
            else:
                want.append((key, d, d + 3 * DAY))
    assert sorted(run(spark, name, sf)) == want
    if gap:
        keys = sorted({k for k, _, _ in want})
        assert sorted(run(spark, "E9_interval_keys", sf)) == [(k, sum((e - s) // timedelta(minutes=1) + 1 for q, s, e in want if q == k), sum(q == k for q, _, _ in want), sum((e - s).days + 1 for q, s, e in want if q == k)) for k in keys]


def test_snapshot_of_all_orders(spark, store, tmp_path):
    sf, _, orders = store
    want = sorted(((k, at, c, status) for k, c, status, at in orders), key=lambda r: (r[1], r[0]))
    assert run(spark, "S20_snapshot", sf) == want
    bad = [*orders, (5, 99, "F", T0)]  # another row under a known key
    spark.createDataFrame(bad, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "bad" / "orders.parquet"))
    with pytest.raises(QualityError):
        run(spark, "S20_snapshot", str(tmp_path / "bad"))


class Leaky:
    """A scan whose filter lets every row through."""

    def __init__(self, df):
        self.df = df

    def where(self, condition):
        return self

    def agg(self, *columns):
        return self.df.agg(*columns)

    def select(self, *columns):
        return self.df.select(*columns)


def test_bounded_scan_checks_what_comes_back(spark, monkeypatch):
    d = spark.createDataFrame([(1, 1, 5.0, datetime(1994, 6, 1)), (1, 2, 5.0, datetime(1994, 7, 1))], "l_orderkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz")
    for last in (datetime(1994, 6, 30), F.lit("1994-06-30 00:00:00").cast("timestamp_ntz")):
        with pytest.raises(S.SchemaError):
            S.bounded(Leaky(d), last_time=last, ts="l_shipdate")
        assert S.bounded(d, last_time=last, ts="l_shipdate").count() == 1
    with pytest.raises(S.SchemaError):
        S.bounded(Leaky(d.withColumn("day", F.to_date("l_shipdate"))), last_date=datetime(1994, 6, 30).date(), day="day")
    # the query's bound is 1996-06-30, so one row lies behind it
    late = d.withColumn("l_shipdate", F.col("l_shipdate") + F.expr("interval 2 years"))
    monkeypatch.setattr(queries_joins, "table", lambda *_: Leaky(late))
    with pytest.raises(S.SchemaError):
        registry.QUERIES["S7_bounded_scan"](spark, "")
