"""Window operators against plain recurrences and hand-made rows."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import features, targets
from barloom.operators import windows as W
from barloom.sources import fixtures

T0 = datetime(2024, 7, 2, 9, 30)


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, T0 + timedelta(minutes=k), v) for k, v in enumerate(values)], "k string, datetime timestamp_ntz, x double")


VALUES = [3.0, 1.0, 4.0, 1.5, 9.0, 2.5, 6.0, 5.0, 3.5, 8.0, 9.5, 7.0]


def test_ewm_equals_pandas(spark):
    got = [r.e for r in W.with_ewm(series(spark, VALUES), "e", F.col("x"), ["k"], 3).orderBy("datetime").collect()]
    want = pd.Series(VALUES).ewm(span=3, adjust=False, min_periods=3).mean()
    assert [g is None for g in got] == want.isna().tolist()
    assert [g for g in got if g is not None] == pytest.approx(want.dropna().tolist())


@pytest.mark.parametrize("span", [1, 2, 3, 50])
def test_long_ewm_over_many_blocks(spark, span):
    """Series of several blocks, signs mixed, with missing values of which some
    lie at the ends of blocks (74 values at span 3)."""
    for missing in ((), range(70, 90), (0, 1, 5, 74, 75, 76, 1500)):
        values = [None if k in missing else float((k * 7919) % 101) - 40 for k in range(2200 if span == 50 else 400)]
        got = [r.e for r in W.with_ewm(series(spark, values), "e", F.col("x"), ["k"], span, 1).orderBy("datetime").collect()]
        own = pd.Series(values, dtype=float).dropna()
        want = own.ewm(span=span, adjust=False).mean().reindex(range(len(values)))
        assert [g is None for g in got] == want.isna().tolist()
        assert [g for g in got if g is not None] == pytest.approx(want.dropna().tolist(), rel=1e-11, abs=1e-11)


def test_missing_values_hold_ewm_back(spark):
    got = [r.e for r in W.with_ewm(series(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0]), "e", F.col("x"), ["k"], 3).orderBy("datetime").collect()]
    assert got == [None, None, None, None, None, pytest.approx(0.5 * 6 + 0.5 * (0.5 * 5 + 0.5 * (0.5 * 4 + 0.5 * 1.5)))]


def test_long_wilder_over_many_blocks(spark):
    for p in (1, 2, 14):
        values = [None if k % 11 == 3 else float((k * 7919) % 101) for k in range(1300)]
        want, seen, e = [], [], None
        for v in values:
            if v is not None:
                seen.append(v)
                e = sum(seen) / p if len(seen) == p else ((p - 1) * e + v) / p if len(seen) > p else None
            want.append(e)
        got = [r.e for r in W.with_wilder(series(spark, values), "e", F.col("x"), ["k"], p).orderBy("datetime").collect()]
        assert [g is None for g in got] == [x is None for x in want]
        assert [g for g in got if g is not None] == pytest.approx([x for x in want if x is not None], rel=1e-11)


def test_wilder(spark):
    p, want = 3, []
    for k, v in enumerate(VALUES):
        want.append(None if k < p - 1 else sum(VALUES[:p]) / p if k == p - 1 else ((p - 1) * want[-1] + v) / p)
    got = [r.e for r in W.with_wilder(series(spark, VALUES), "e", F.col("x"), ["k"], p).orderBy("datetime").collect()]
    assert got[: p - 1] == [None] * (p - 1)
    assert got[p - 1 :] == pytest.approx(want[p - 1 :])


@pytest.mark.parametrize("op,f", [("mean", "mean"), ("median", "median"), ("skew", "skew"), ("kurt", "kurt"), ("min", "min"), ("max", "max")])
def test_rolling_equals_pandas(spark, op, f):
    for shift in (0, 1):
        got = [r.e for r in series(spark, VALUES).withColumn("e", W.rolling(F.col("x"), W.ordered(["k"], "datetime"), 5, op, shift)).orderBy("datetime").collect()]
        want = getattr(pd.Series(VALUES).shift(shift).rolling(5), f)()
        assert [g is None for g in got] == want.isna().tolist()
        assert [g for g in got if g is not None] == pytest.approx(want.dropna().tolist())


def test_rolling_needs_all_values(spark):
    d = series(spark, [1.0, None, 3.0, 4.0, 5.0])
    got = [r.e for r in d.withColumn("e", W.rolling(F.col("x"), W.ordered(["k"], "datetime"), 3, "mean")).orderBy("datetime").collect()]
    assert got == [None, None, None, None, 4.0]


def test_continuity_reasons(spark):
    bars = fixtures.minute_bars(spark, "xx.xxx", T0).withColumn("close", F.when(F.col("datetime") != T0 + timedelta(minutes=4), F.col("close")))
    rows = features.with_continuity(bars, 1).orderBy("datetime").collect()
    assert [r.break_reason for r in rows] == ["source_start", "contiguous", "time_gap", "current_unusable", "previous_unusable"]
    assert [r.contiguous_history for r in rows] == [1, 2, 1, 0, 1]


def test_history_is_capped(spark):
    bars = fixtures.minute_bars(spark, "x" * 20, T0)
    got = W.continuity(bars, F.lit(True), ["symbol"], "datetime", 1, cap=8).agg(F.max("contiguous_history")).first()[0]
    assert got == 8


def test_merge_intervals(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    df = spark.createDataFrame([("a", at(0), at(5)), ("a", at(5), at(7)), ("a", at(8), at(9)), ("a", at(20), at(21)), ("a", at(1), at(2))], "k string, s timestamp_ntz, e timestamp_ntz")
    touch = sorted((r.s, r.e) for r in W.merge_intervals(df, ["k"], "s", "e").collect())
    assert touch == [(at(0), at(7)), (at(8), at(9)), (at(20), at(21))]
    near = sorted((r.s, r.e) for r in W.merge_intervals(df, ["k"], "s", "e", adjacent=1).collect())
    assert near == [(at(0), at(9)), (at(20), at(21))]


def test_target_reasons_and_purge(spark):
    bars = fixtures.minute_bars(spark, "xxxxx.xxxx", T0).withColumns({"session": F.lit("regular"), "trading_date": F.to_date("datetime")})
    d = targets.add_target(features.with_continuity(bars, 1), 2, 1)
    got = [r.target_invalid_reason_2m for r in d.orderBy("datetime").collect()]
    assert got == ["valid", "valid", "valid", "future_not_exact_horizon", "future_not_exact_horizon", "valid", "valid", "future_not_exact_horizon", "future_not_exact_horizon"]
    rows = [("train", T0, T0 + timedelta(minutes=1)), ("train", T0 + timedelta(minutes=1), T0 + timedelta(minutes=2)), ("test", T0 + timedelta(minutes=5), T0 + timedelta(minutes=9))]
    p = targets.purge(spark.createDataFrame(rows, "split string, prediction_time timestamp_ntz, realized timestamp_ntz"), "realized")
    assert sorted((r.split, r.prediction_time) for r in p.collect()) == [("test", T0 + timedelta(minutes=5)), ("train", T0)]


@pytest.mark.parametrize("n,want", [(3, (1, 1, 1)), (4, (2, 1, 1)), (10, (7, 1, 2)), (20, (14, 3, 3))])
def test_split_plan(spark, n, want):
    days = spark.createDataFrame([((T0 + timedelta(days=k)).date(),) for k in range(n)] * 2, "trading_date date")
    got = {r["split"]: r["count"] for r in targets.split_plan(days).groupBy("split").count().collect()}
    assert (got["train"], got["validation"], got["test"]) == want


def test_even_sample(spark):
    d = spark.range(17).withColumn("g", F.lit(1))
    got = sorted(r.id for r in targets.even_sample(d, 5, ["id"], ["g"]).collect())
    assert got == [k * 16 // 4 for k in range(5)]
    assert targets.even_sample(d, 40, ["id"], ["g"]).count() == 17


def test_dense_index(spark):
    d = spark.range(1000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(10007)))
    rows = targets.dense_index(d, ["x", "id"]).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.sample_index)] == [r.id for r in sorted(rows, key=lambda r: (r.x, r.id))]
    assert sorted(r.sample_index for r in rows) == list(range(1000))


def test_prefix_sum(spark):
    rows = [(g, x, k) for k, (g, x) in enumerate((g, x) for g in ("a", "b", None) for x in (None, 5.0, 1.0, 5.0, -2.0, 7.5, 5.0))]
    d = spark.createDataFrame(rows, "g string, x double, k int")
    for by in ([], ["g"]):
        got = {r.k: r.s for r in W.prefix_sum(d, ["x", "k"], F.col("k"), "s", by, ranges=3).collect()}
        for g, x, k in rows:
            before = [j for h, y, j in rows if (not by or h == g) and ((y is not None, y or 0.0, j) < (x is not None, x or 0.0, k))]
            assert got[k] == sum(before)
    assert W.prefix_sum(d.limit(0), ["x"], F.lit(1), "s").count() == 0
