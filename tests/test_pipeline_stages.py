from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.plans.pipeline import Pipeline, Stage, bar_pipeline


def test_selection():
    p = Pipeline([Stage("a", None), Stage("b", None, enabled=False), Stage("c", None)])
    assert p.plan() == [("a", True), ("b", False), ("c", True)]
    assert p.plan(only="c") == [("a", False), ("b", False), ("c", True)]
    assert p.plan(first="a", last="b") == [("a", True), ("b", False), ("c", False)]
    assert p.run({}, dry_run=True) == {} and p.done == []
    with pytest.raises(KeyError):
        p.plan(only="z")
    with pytest.raises(ValueError):
        p.plan(first="c", last="a")


def test_bars_to_labels(spark):
    rows, windows = [], []
    for day in range(5):
        start = datetime(2024, 1, 8 + day, 9, 30)
        windows.append(("abc", start.date(), "regular", start, start + timedelta(minutes=90)))
        for k in range(90):
            if k % 37 != 20:
                x = 100 + day + ((k * 7919 + day) % 13) / 10
                rows.append(("abc", start + timedelta(minutes=k), x, x + 1, x - 1, x + 0.5, 10.0 + k, 3, x + 0.1, "regular", start.date()))
    bars = spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, bar_count long, wap double, session string, trading_date date")
    w = spark.createDataFrame(windows, "symbol string, trading_date date, session string, start timestamp_ntz, end timestamp_ntz")
    p = bar_pipeline(horizon=5, length=20, timeframe=30)
    out = p.run({"bars": bars, "windows": w})
    assert p.done == ["validate", "regularize", "resample", "features", "targets", "sequences", "matrix", "labels"]
    assert out["validate"].first().high_below_body == 0
    assert out["regularize"].count() == 450 and out["regularize"].where("is_imputed").count() == 5 * 2
    got = out["labels"].select("split", "label", "f_1m_log_return_1", "f_30m_close_anchor_bps", "datetime", "ctx_30m_available_at", "prediction_time").collect()
    assert {r.split for r in got} == {"train", "validation", "test"} and {r.label for r in got} <= {-1, 0, 1}
    assert all(r.ctx_30m_available_at is None or r.ctx_30m_available_at <= r.prediction_time for r in got)
    train = [r.f_1m_log_return_1 for r in got if r.split == "train"]
    assert abs(sum(train) / len(train)) < 1e-9
    # a window of 20 rows, then a target 5 rows on: only endpoints 20..85 of a session qualify
    assert all(19 <= (r.datetime.hour * 60 + r.datetime.minute - 570) <= 84 for r in got)
    assert out["features"].select(F.max("f_30m_age_minutes")).first()[0] is not None
