"""Streams give what their batch forms give."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barloom.sources import tables as S
from barloom.streaming import streams as ST

T0 = datetime(2024, 1, 2, 9, 30)


def files(spark, df, path, n=3, order="datetime"):
    """Several files in time order, so that several micro-batches run."""
    rows = df.orderBy(order).collect()
    for k in range(n):
        part = rows[k * len(rows) // n : (k + 1) * len(rows) // n]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    return path


def signals(spark):
    x = [0.0, 0.01, 0.02, -0.001, -0.03, -0.02, 0.0, 0.05, 0.05, -0.5]
    return spark.createDataFrame([(s, T0 + timedelta(minutes=k), v * (1 if s == "a" else -1)) for s in "ab" for k, v in enumerate(x)], "symbol string, datetime timestamp_ntz, predicted_return double")


def test_positions(spark, tmp_path):
    d = signals(spark)
    path = files(spark, d, str(tmp_path / "in"))
    stream = ST.file_stream(spark, path, d.schema.simpleString()[7:-1].replace(":", " "), files=10)
    got = ST.drain(ST.stream_positions(stream, 0.01), "positions")
    want = ST.positions(d, 0.01)
    assert sorted(map(tuple, got.select("symbol", "datetime", "action", "position").collect())) == sorted(map(tuple, want.select("symbol", "datetime", "action", "position").collect()))
    a = [r.action for r in want.where("symbol = 'a'").orderBy("datetime").collect()]
    assert a == ["HOLD", "OPEN", "HOLD", "HOLD", "REVERSE", "HOLD", "HOLD", "REVERSE", "HOLD", "REVERSE"]


def test_last_n(spark, tmp_path):
    d = signals(spark).select("symbol", "datetime", (F.col("predicted_return") + 10).alias("close"))
    path = files(spark, d, str(tmp_path / "in"), n=2)
    stream = ST.file_stream(spark, path, "symbol string, datetime timestamp_ntz, close double")
    got = ST.drain(ST.last_n_features(stream, 4), "last_n")
    key = lambda rows: sorted((r.symbol, r.datetime, round(r.mean_close, 9), round(r.window_return, 9)) for r in rows)
    assert key(got.collect()) == key(ST.last_n_batch(d, 4).collect())


def test_windowed_bars(spark, tmp_path):
    rows = [(k, T0 + timedelta(minutes=4 * k), "a" if k % 3 else "b", float(k % 7)) for k in range(40)]
    d = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double")
    path = files(spark, d, str(tmp_path / "in"), order="ts")
    stream = ST.file_stream(spark, path, "event_id long, ts timestamp_ntz, event_type string, value double", files=10)
    got = ST.drain(ST.windowed_bars(stream), "bars", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ST.windowed_bars(d).collect()))


def test_merge_sink_is_idempotent(spark, tmp_path):
    d = signals(spark)
    path = files(spark, d, str(tmp_path / "in"))
    root = str(tmp_path / "out")
    schema = "symbol string, datetime timestamp_ntz, predicted_return double"
    for k in range(2):  # a second query with a new checkpoint replays everything
        ST.merge_sink(ST.file_stream(spark, path, schema), root, ["symbol", "datetime"], str(tmp_path / f"ck{k}")).awaitTermination()
    assert S.frames_equal(spark.read.parquet(root), d)


def test_messages(spark):
    d = spark.createDataFrame([('{"datetime": 1700000000, "open": 1, "close": 2}',), ("broken",)], "value string")
    rows = ST.parse_messages(d, ST.CANDLE).collect()
    assert rows[0].datetime == 1.7e9 and rows[0].close == 2.0 and rows[1].datetime is None


def test_sides(spark):
    d = spark.createDataFrame([(5, 1), (-5, -1), (0, 0)], "q int, t int")
    rows = d.select(ST.broker_side(F.col("q")).alias("s"), ST.needs_action(F.signum("q").cast("int"), F.col("t")).alias("n")).collect()
    assert [(r.s, r.n) for r in rows] == [("LONG", False), ("SHORT", False), ("FLAT", False)]
