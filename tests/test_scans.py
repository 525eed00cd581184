"""Filtered scans, skipped months and settings."""

import datetime as dt

import pytest

from barloom.sources import scans as SC
from barloom.sources.settings import SequenceSettings, SettingsError, resolve
from barloom.sources.tables import SchemaError

ROWS = [("a", 2024, m, float(m)) for m in range(1, 13)] + [("b", 2023, 12, 1.5)]
SCHEMA = "symbol string, year int, month int, x double"


def test_whole_months_are_skipped(spark, tmp_path):
    root = str(tmp_path / "t")
    spark.createDataFrame(ROWS, SCHEMA).write.partitionBy("symbol", "year", "month").parquet(root)
    got = SC.until_month(spark.read.parquet(root), 2024, 2)
    assert sorted(r.x for r in got.collect()) == [1.0, 1.5, 2.0]
    assert len(got.select("x", "month").inputFiles()) == 13  # all files are known, but the plan prunes
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_filtered_table(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    assert [tuple(r) for r in SC.filtered(d, ["x"], "symbol", "b").collect()] == [(1.5,)]
    assert SC.filtered(d, ["x"]).count() == 13 and SC.filtered(d, ["x"], "symbol", "c").count() == 0
    with pytest.raises(SchemaError):
        SC.filtered(d, ["x"], "nothing", 1)


def test_finite_rows(spark):
    d = spark.createDataFrame([("1", "train", 1.0), ("inf", "train", 1.0), (None, "train", 1.0), ("x", "TRAIN", 1.0), ("2", "TRAIN", float("nan")), ("3", "Train", 2.0), ("4", "test", 2.0), ("5", None, 2.0)], "t string, split string, y double")
    assert sorted(r.t for r in SC.finite_rows(d, ["t", "y"], "train").collect()) == [1.0, 3.0]
    assert sorted(r.t for r in SC.finite_rows(d, ["t", "y"]).collect()) == [1.0, 3.0, 4.0, 5.0]


def test_feature_names_are_unique():
    manifest = {"s": {"encoded_columns": ["s_0", "s_1"]}}
    assert SC.feature_list(["a"], ["w"], manifest, "p_") == ["a", "p_w", "s_0", "s_1"]
    with pytest.raises(SchemaError):
        SC.feature_list(["a", "s_1"], [], manifest)


def test_daily_files_replace_only_their_days(spark, tmp_path):
    root, day = str(tmp_path / "d"), dt.date(2024, 1, 2)
    make = lambda rows: spark.createDataFrame(rows, "trading_date date, x long")
    SC.write_daily(make([(day, 1), (day, 2), (day + dt.timedelta(1), 3)]), root)
    SC.write_daily(make([(day, 9)]), root)
    assert sorted(r.x for r in spark.read.parquet(root).collect()) == [3, 9]


def test_unchanged_months_are_not_written(spark, tmp_path):
    root, manifest = str(tmp_path / "m"), str(tmp_path / "manifest")
    assert SC.write_changed(spark, spark.createDataFrame(ROWS, SCHEMA), root, manifest) == 13
    assert SC.write_changed(spark, spark.createDataFrame(ROWS[::-1], SCHEMA), root, manifest) == 0
    changed = [(s, y, m, 99.0 if m == 3 else x) for s, y, m, x in ROWS]
    assert SC.write_changed(spark, spark.createDataFrame(changed, SCHEMA), root, manifest) == 1
    assert SC.write_changed(spark, spark.createDataFrame(changed, SCHEMA), root, manifest) == 0
    assert SC.write_changed(spark, spark.createDataFrame(ROWS, SCHEMA), root, manifest) == 1
    assert sorted(r.x for r in spark.read.parquet(root).collect()) == sorted(x for *_, x in ROWS)
    assert SC.write_changed(spark, spark.createDataFrame([], SCHEMA), root, manifest) == 0


def test_settings_precedence_and_checks():
    got, origin = resolve(SequenceSettings, given={"horizon": "30", "stride": None}, file={"horizon": 5, "stride": 2, "sessions": "regular, premarket"})
    assert (got.horizon, got.stride, got.lookback, got.sessions) == (30, 2, 120, ("regular", "premarket"))
    assert origin["horizon"] == "given" and origin["stride"] == "file" and origin["lookback"] == "default"
    assert got.test_fraction == pytest.approx(0.15)
    for bad in ({"horizon": 0}, {"horizon": 1.5}, {"horizon": "x"}, {"sessions": "night"}, {"sessions": ""}, {"train_fraction": 0.9}, {"train_fraction": "nan"}, {"unknown": 1}, {"stride": True}):
        with pytest.raises(SettingsError):
            resolve(SequenceSettings, given=bad)
