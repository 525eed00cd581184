"""Grids, fills, resampling, sessions, calendars, joins, checks and stores."""

import datetime as dt
import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions import expr as X
from barloom.functions.calendar import Calendar, early_closes, easter, holidays
from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.operators import joins as J
from barloom.operators import metrics as M
from barloom.operators import quality as Q
from barloom.sources import fixtures
from barloom.sources import tables as S

T0 = datetime(2024, 7, 2, 9, 30)
GROUP = ["symbol", "trading_date", "session"]


def session(spark, pattern, minutes=20, start=T0, step=1):
    bars = fixtures.minute_bars(spark, pattern, start).withColumns({"trading_date": F.to_date("datetime"), "session": F.lit("regular")})
    windows = spark.createDataFrame([("abc", start.date(), "regular", start, start + timedelta(minutes=minutes))], "symbol string, trading_date date, session string, start timestamp_ntz, end timestamp_ntz")
    return bars, B.expected_grid(windows, step, carry=GROUP)


def test_fill_up_to_five(spark):
    bars, grid = session(spark, ".xx.....xx......x.x..")
    rows = B.regularize(bars, grid, GROUP, 1).orderBy("datetime").collect()
    assert len(rows) == 20
    got = "".join({"observed": "x", "imputed_internal": "i", "missing_internal_too_large": "L", "missing_leading": "l", "missing_trailing": "t", "missing_full_session": "f"}[r.quality_status] for r in rows)
    assert got == "lxxiiiiixxLLLLLLxixt"
    filled = rows[3]
    assert (filled.open, filled.close, filled.wap, filled.volume, filled.bar_count) == (rows[2].close, rows[2].close, rows[2].close, 0.0, 0)
    assert filled.imputation_source_datetime == rows[2].datetime


def test_full_session_gap(spark):
    bars, grid = session(spark, "x" * 5)
    other = grid.withColumn("symbol", F.lit("zzz"))
    rows = B.regularize(bars, other, GROUP, 1).collect()
    assert {r.quality_status for r in rows} == {"missing_full_session"}
    audit = B.gap_audit(B.regularize(bars, grid.unionByName(other), GROUP, 1), GROUP, 1).collect()
    assert sorted((r.symbol, r.gap_type, r.run_length) for r in audit) == [("abc", "trailing", 15), ("zzz", "full_session", 20)]


def test_resample_is_anchored_and_cut(spark):
    bars, grid = session(spark, "x" * 20)
    reg = B.regularize(bars, grid, GROUP, 1).withColumns({"session_start": F.lit(T0), "session_end": F.lit(T0 + timedelta(minutes=20))})
    rows = B.resample(reg, 15, 1, GROUP).orderBy("datetime").collect()
    assert [(r.datetime, r.bar_end, r.expected_minutes, r.is_complete) for r in rows] == [(T0, T0 + timedelta(minutes=15), 15, True), (T0 + timedelta(minutes=15), T0 + timedelta(minutes=20), 5, True)]
    assert rows[0].open == 100.0 and rows[0].close == 114.5 and rows[0].high == 115.0


def test_calendar():
    assert easter(2024) == date(2024, 3, 31) and easter(2025) == date(2025, 4, 20) and easter(2000) == date(2000, 4, 23)
    assert holidays(2021) >= {date(2021, 7, 5), date(2021, 12, 24)} and date(2021, 6, 18) not in holidays(2021)
    assert date(2024, 7, 3) in early_closes(2024) and date(2021, 12, 24) not in early_closes(2021)
    c = Calendar()
    assert c.next_session(date(2024, 7, 4)) == date(2024, 7, 5) and c.next_session(date(2024, 7, 5), True) == date(2024, 7, 8)
    w = {s: (a, b) for s, a, b, _, _ in c.windows(date(2024, 7, 3))}
    assert w["regular"][1] == datetime(2024, 7, 3, 13) and w["aftermarket"] == (datetime(2024, 7, 3, 13), datetime(2024, 7, 3, 17))


def test_session_boundaries(spark):
    times = {"04:00": "premarket", "09:29": "premarket", "09:30": "regular", "15:59": "regular", "16:00": "aftermarket", "19:59": "aftermarket", "20:00": "overnight"}
    rows = [(datetime.fromisoformat(f"2019-05-06 {t}"), s) for t, s in times.items()] + [(datetime(2019, 5, 7, 3, 59), "overnight"), (datetime(2019, 5, 10, 21), "unknown"), (datetime(2019, 5, 12, 21), "overnight")]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, want string")
    got = J.interval_label(df, "datetime", Calendar().session_windows(spark, date(2019, 5, 1), date(2019, 5, 17))).collect()
    assert len(got) == len(rows) and all(r.session == r.want for r in got)
    assert {r.trading_date for r in got if r.datetime == datetime(2019, 5, 12, 21)} == {date(2019, 5, 13)}


def test_strict_local_time(spark):
    zone = "America/New_York"
    ok = spark.createDataFrame([(datetime(2024, 1, 15, 9, 30),), (datetime(2024, 7, 15, 9, 30),), (datetime(2024, 3, 11, 9, 30),)], "t timestamp_ntz")
    assert [r[0].hour for r in ok.select(X.local_to_instant(F.col("t"), zone)).collect()] == [14, 13, 13]
    assert [r[0].hour for r in ok.select(X.instant_to_local(X.local_to_instant(F.col("t"), zone), zone)).collect()] == [9, 9, 9]
    for bad in (datetime(2024, 3, 10, 2, 30), datetime(2024, 11, 3, 1, 30)):
        with pytest.raises(Exception, match="skipped or ambiguous"):
            spark.createDataFrame([(bad,)], "t timestamp_ntz").select(X.local_to_instant(F.col("t"), zone)).collect()


def test_asof_edges(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    left = spark.createDataFrame([("a", at(0)), ("a", at(5)), ("a", at(7)), ("b", at(5)), (None, at(5))], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", at(5), 1, 1), ("a", at(5), 2, 2), ("a", at(9), 3, 3), (None, at(1), 4, 4)], "k string, r timestamp_ntz, v int, o int")
    got = {(r.k, r.t): r.v for r in J.asof_join(left, right, ["k"], "t", "r", ["v"], tie=["o"]).collect()}
    assert got == {("a", at(0)): None, ("a", at(5)): 2, ("a", at(7)): 2, ("b", at(5)): None, (None, at(5)): 4}


def test_checked_join_refuses(spark):
    d = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(J.CardinalityError):
        J.checked_join(spark.createDataFrame([(1,)], "k int"), d, ["k"])
    assert J.checked_join(d, spark.createDataFrame([(1, 5)], "k int, w int"), ["k"], validate="many_to_one", matched="m").where("m").count() == 2
    one = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    with pytest.raises(J.MissingPartnerError):
        J.checked_join(one.where("k > 0"), d.select("k").distinct(), ["k"], validate="many_to_one", complete=True)
    with pytest.raises(J.MissingPartnerError):
        J.checked_join(one, one, ["k"], complete=True)
    assert J.checked_join(one.where("k > 0"), one, ["k"], complete=True).count() == 2


def test_candle_edges(spark):
    d = fixtures.candle_shapes(spark)
    c = X.candle(F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("volume"), F.col("close"))
    rows = {r.scenario: r for r in d.select("scenario", *[v.alias(k) for k, v in c.items()]).collect()}
    assert rows["flat_no_volume"].inactive_flat_candle == 1 and rows["flat_no_volume"].body_to_range == 0.0
    assert rows["flat_with_volume"].strange_flat_candle == 1 and rows["zero_open"].body_bps is None and rows["zero_close"].range_bps is None
    assert rows["doji"].body_to_range == 0.0 and rows["full_body_up"].bullish == 1
    issues = Q.row_issues(d.withColumns({"bar_count": F.lit(1), "wap": F.col("close")}), ["scenario"]).collect()
    assert {"high_below_body", "low_above_body", "high_below_low"} <= {r.issue for r in issues if r.scenario.startswith(("high", "low"))}


def test_time_blocks(spark):
    d = spark.createDataFrame([(570,), (629,), (630,), (945,)], "m int")
    assert [r[0] for r in d.select(X.time_block(F.col("m"))).collect()] == ["09:30-10:30", "09:30-10:30", "10:30-11:30", "14:30-15:45"]
    for bad in (569, 946):
        with pytest.raises(Exception, match="outside the blocks"):
            spark.createDataFrame([(bad,)], "m int").select(X.time_block(F.col("m"))).collect()


def test_feature_count(spark):
    from barloom.operators import features

    bars, grid = session(spark, "x" * 20)
    reg = B.regularize(bars, grid, GROUP, 1).withColumns({"session_start": F.lit(T0), "session_end": F.lit(T0 + timedelta(minutes=20))})
    made = [c for c in features.one_minute_features(reg, 1).columns if c.startswith("f_")]
    assert len(made) == len(set(made)) == 61
    hours = features.higher_timeframe_features(B.resample(reg, 5, 1, GROUP), "5m", GROUP)
    assert len([c for c in hours.columns if c.startswith("f_5m_")]) == 14


def test_strict_bool(spark):
    d = spark.createDataFrame([(" Yes",), ("0",)], "v string")
    assert [r[0] for r in d.select(X.strict_bool(F.col("v"))).collect()] == [True, False]
    for bad in ("maybe", None):
        with pytest.raises(Exception, match="no boolean"):
            spark.createDataFrame([(bad,)], "v string").select(X.strict_bool(F.col("v"))).collect()


def test_auc_ties(spark):
    d = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert M.roc_auc(d, "y", "p").first().auc == pytest.approx(0.875)
    assert M.roc_auc(d.where("y = 1"), "y", "p").first().auc is None


def test_calibration_last_bin_is_closed(spark):
    d = spark.createDataFrame([(1, 1.0), (0, 0.95), (0, 0.0)], "y int, p double")
    assert sorted(r.bin for r in M.calibration(d, "y", "p").collect()) == [0, 19]


def test_scaler_constant(spark):
    d = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    got = {r.feature: (r["mean"], r.scale, r.constant) for r in M.scaler(d, ["a", "b"]).collect()}
    assert got == {"a": (2.0, 1.0, False), "b": (2.0, 1.0, True)}


def test_store_roundtrip(spark, tmp_path):
    bars = fixtures.minute_bars(spark, "xxxx", T0)
    root = str(tmp_path / "store")
    S.write_monthly(bars, root)
    back = S.read_monthly(spark, root, " ABC ").drop("year", "month")
    assert S.frames_equal(bars.withColumn("symbol", F.col("symbol")), back.select(*bars.columns))
    assert S.fingerprint(bars).first() == S.fingerprint(bars.orderBy(F.desc("datetime"))).first()
    path, keys = str(tmp_path / "t"), ["symbol", "datetime"]
    assert S.upsert(spark, path, bars, keys)["new_rows"] == 4
    more = fixtures.minute_bars(spark, "xxxxxx", T0)
    assert S.upsert(spark, path, more, keys) == {"new_rows": 2, "identical": 4, "conflicts": 0}
    assert S.upsert(spark, path, more, keys)["new_rows"] == 0 and spark.read.parquet(path).count() == 6
    with pytest.raises(S.MergeConflict):
        S.upsert(spark, path, more.withColumn("close", F.col("close") + 1), keys)
    with pytest.raises(Exception, match="(?i)already exists"):
        S.write_once(bars, path)


def test_merge_keeps_null_keys_apart_and_raises_among_incoming_rows(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["k", "j"]
    rows = spark.createDataFrame([(1, "a", 1.0), (None, "a", 2.0), (1, None, None), (1, "a", 1.0)], "k int, j string, x double")
    assert S.upsert(spark, path, rows, keys) == {"new_rows": 3, "identical": 0, "conflicts": 0}
    assert S.upsert(spark, path, rows, keys) == {"new_rows": 0, "identical": 3, "conflicts": 0} and spark.read.parquet(path).count() == 3
    twice = spark.createDataFrame([(7, "a", 1.0), (7, "a", None)], rows.schema)
    with pytest.raises(S.MergeConflict):
        S.upsert(spark, path, twice, keys)
    with pytest.raises(S.MergeConflict):
        S.upsert(spark, str(tmp_path / "new"), twice, keys)
    assert spark.read.parquet(path).count() == 3 and not (tmp_path / "new").exists()
    merged, report = S.merge_insert(rows, twice, keys)
    assert report.first().conflicts == 1 and merged.count() == 4


def test_merge_reads_touched_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "symbol string, k int, x double")
    assert S.upsert(spark, path, rows, ["symbol", "k"], ["symbol"])["new_rows"] == 3
    more = spark.createDataFrame([("b", 1, 3.0), ("b", 2, 4.0)], rows.schema)
    assert S.upsert(spark, path, more, ["symbol", "k"], ["symbol"]) == {"new_rows": 1, "identical": 1, "conflicts": 0}
    assert spark.read.parquet(path).count() == 4


def test_months_are_local_and_folders_are_checked(spark, tmp_path):
    root = tmp_path / "store"
    late = spark.createDataFrame([("abc", dt.datetime(2024, 2, 1, 2, 0), 1.0), ("abc", dt.datetime(2024, 2, 1, 14, 0), 2.0)], "symbol string, datetime timestamp_ntz, close double")
    S.write_monthly(late, str(root))
    assert [x[:3] for x in S.discover_monthly(spark, str(root))] == [("abc", 2024, 1), ("abc", 2024, 2)]
    assert S.read_monthly(spark, str(root), "abc").where("month = 1").count() == 1
    (root / "symbol=abc/year=2024/month=02").mkdir()
    with pytest.raises(S.SchemaError, match="twice"):
        S.read_monthly(spark, str(root))
    (root / "symbol=abc/year=2024/month=02").rmdir()
    (root / "symbol=abc/year=24/month=3").mkdir(parents=True)
    with pytest.raises(S.SchemaError, match="not a partition"):
        S.discover_monthly(spark, str(root))


def test_a_class_without_rows_has_no_recall(spark):
    d = spark.createDataFrame([(1, 0.9), (1, 0.2)], "y int, p double")
    r = M.threshold_sweep(d, "y", "p", [0.5]).first()
    assert math.isnan(r.recall_down) and math.isnan(r.balanced_accuracy) and r.recall_up == 0.5 and r.accuracy == 0.5
    assert M.best_threshold(M.threshold_sweep(d, "y", "p", [0.1, 0.5, 0.7])).first().threshold == 0.5


def test_coverage_below_one_row_and_ties(spark):
    d = spark.createDataFrame([(k, int(k % 3 == 0), 0.9 if k < 6 else 0.4) for k in range(20)], "k long, y int, p double")
    got = {r.coverage: r for r in M.precision_at_coverage(d, "y", "p", [0.01, 0.2, 0.5], ["k"]).collect()}
    # four of the six tied rows, by key: 0 and 3 are right; then six and four of those at 0.4 (7, 8 of 6..9)
    assert got.keys() == {0.2, 0.5} and (got[0.2].n, got[0.2].precision, got[0.2].predicted_up_pct) == (4, 0.5, 100.0)
    assert got[0.5].n == 10 and got[0.5].precision == pytest.approx((2 + 2) / 10) and got[0.5].predicted_up_pct == 60.0


def test_csv_scan(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text(" DateTime ,open,High,low,close,volume,wap,bar_count\n2024-01-15 09:30:00,1,2,0.5,1.5,10,1.2,3\n2024-07-15T09:30:00-04:00,1,2,x,1.5,10,1.2,3\nbad,1,2,0.5,1.5,,1.2,3\n")
    rows, bad = S.read_bars_csv(spark, str(p))
    assert [r.datetime for r in rows.collect()] == [datetime(2024, 1, 15, 14, 30), datetime(2024, 7, 15, 13, 30), None]
    b = bad.first()
    assert (b.invalid_datetime, b.invalid_low, b.invalid_volume) == (1, 1, 0)
    q = tmp_path / "b.csv"
    q.write_text("datetime,open,high,low,close,volume,wap\n")
    with pytest.raises(S.SchemaError):
        S.read_bars_csv(spark, str(q))


def test_sealed_scan(spark):
    d = spark.createDataFrame([("train",), ("test",)], "split string")
    with pytest.raises(S.SchemaError):
        S.sealed(d)
    with pytest.raises(S.SchemaError):
        S.sealed(spark.createDataFrame([("train",), (None,)], "split string"))
    assert S.sealed(d.where("split = 'train'")).count() == 1


def test_one_hot_sums_to_one(spark):
    d = spark.createDataFrame([("a",), ("b",), ("zz",), (None,), ("unavailable",)], "c string")
    v = I.fit_vocabularies(d.where("c in ('a', 'b', 'unavailable')"), ["c"])
    rows = I.encode_categories(d, v).collect()
    assert v == {"c": ["a", "b"]} and all(sum(r) == 1 for r in rows)


def test_quality_gates(spark):
    assert Q.gate(["pass", "fail", "blocked"]) == "blocked" and Q.gate(["pass"]) == "pass" and Q.gate(["error", "fail"]) == "error"
    with pytest.raises(Q.QualityError):
        Q.require(spark.createDataFrame([(0, 2)], "a int, b int"), ["a", "b"])
    with pytest.raises(Q.QualityError):
        Q.dedupe_or_raise(spark.createDataFrame([(1, 1), (1, 2)], "k int, v int"), ["k"])


def test_names_and_paths():
    assert S.path_number(0.75) == "0p75" and S.path_number(1.0) == "1" and S.signature({"b": 1, "a": 2}) == S.signature({"a": 2, "b": 1})
    assert S.artifact_path("/r/", symbol="x", year=2024) == "/r/symbol=x/year=2024"
