"""Structured Streaming: bars from events, a buffer of the last candles, and a
position state machine. Each has a batch form with equal results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bars import exact_sum
from ..sources.tables import upsert

#: Schemas of messages (times are epoch seconds).
CANDLE = "datetime double, open double, high double, low double, close double, volume double"
PREDICTION = "timestamp double, ticker string, current_close double, predicted_close double, predicted_return double"


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: str, offsets: str = "latest") -> DataFrame:
    """JSON messages of a topic, as columns. Needs the Kafka connector's jar."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", offsets).load()
    return parse_messages(raw.select(F.col("value").cast("string").alias("value")), schema)


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    out = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("topic", topic).option("checkpointLocation", checkpoint).start()


def parse_messages(df: DataFrame, schema: str) -> DataFrame:
    """JSON text in ``value`` to columns; a broken message becomes NULLs."""
    return df.select(F.from_json("value", schema).alias("m")).select("m.*")


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream gets a watermark, which needs instants (session zone UTC)."""
    if not events.isStreaming:
        return events
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed_bars(events: DataFrame, minutes: int = 15, late: str = "30 minutes", symbol: str = "event_type", ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """Tumbling bars with a watermark: events that are later than it are
    dropped, state of closed windows goes. Also runs on a batch."""
    order = F.struct(ts, tie)
    d = _timed(events, ts, late)
    return (
        d.groupBy(F.window(ts, f"{minutes} minutes").alias("w"), F.col(symbol).alias("symbol"))
        .agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), exact_sum(F.col(value)).alias("volume"), F.count("*").alias("bar_count"))
        .select("symbol", F.col("w.start").cast("timestamp_ntz").alias("datetime"), "open", "high", "low", "close", "volume", "bar_count")
    )


def gap_sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", ts: str = "ts", late: str = "30 minutes") -> DataFrame:
    """Sessions that end after a time without events."""
    d = _timed(events, ts, late)
    return d.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def last_n_features(candles: DataFrame, n: int, key: str = "symbol", ts: str = "datetime") -> DataFrame:
    """Stateful: a buffer of the last n closes per key; once it is full, every
    candle gives the buffer's mean and the return over it. Candles of a batch
    go in time order."""
    out = f"{key} string, {ts} timestamp_ntz, mean_close double, window_return double"

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState):
        kept = list(state.get[0]) if state.exists else []
        rows = []
        new = pd.concat(list(parts)).sort_values(ts, kind="stable")
        for at, close in zip(new[ts], new["close"], strict=True):
            kept = [*kept, float(close)][-n:]
            if len(kept) == n:
                rows.append((name[0], at, sum(kept) / n, kept[-1] / kept[0] - 1 if kept[0] else None))
        state.update((kept,))
        yield pd.DataFrame(rows, columns=[key, ts, "mean_close", "window_return"])

    return candles.select(key, ts, "close").groupBy(key).applyInPandasWithState(step, out, "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def last_n_batch(candles: DataFrame, n: int, key: str = "symbol", ts: str = "datetime") -> DataFrame:
    w = Window.partitionBy(key).orderBy(ts)
    frame = w.rowsBetween(-(n - 1), 0)
    d = candles.withColumns({"mean_close": F.avg("close").over(frame), "window_return": F.try_divide(F.col("close"), F.lag("close", n - 1).over(w)) - 1, "_n": F.count("*").over(frame)})
    return d.where(F.col("_n") == n).select(key, ts, "mean_close", "window_return")


def signal(expected: Column, threshold: float) -> Column:
    """1, -1, or NULL to hold."""
    return F.when(expected >= threshold, 1).when(expected <= -threshold, -1)


def _action(before: Column, now: Column) -> Column:
    return F.when(now.isNull() | (now == before), "HOLD").when(before == 0, "OPEN").otherwise("REVERSE")


def positions(signals: DataFrame, threshold: float, key: str = "symbol", ts: str = "datetime", value: str = "predicted_return") -> DataFrame:
    """Batch form: the position is the sign of the last signal that was not a
    hold. ``action`` is HOLD, OPEN (from flat) or REVERSE."""
    w = Window.partitionBy(key).orderBy(ts)
    d = signals.withColumn("_s", signal(F.col(value), threshold))
    d = d.withColumn("_before", F.coalesce(F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.withColumn("action", _action(F.col("_before"), F.col("_s"))).withColumn("position", F.coalesce("_s", "_before")).drop("_s", "_before")


def stream_positions(signals: DataFrame, threshold: float, key: str = "symbol", ts: str = "datetime", value: str = "predicted_return") -> DataFrame:
    """Streaming form: state is the present position."""
    out = f"{key} string, {ts} timestamp_ntz, {value} double, action string, position int"

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState):
        held = state.get[0] if state.exists else 0
        rows = []
        for at, x in pd.concat(list(parts)).sort_values(ts, kind="stable")[[ts, value]].itertuples(index=False):
            now = 1 if x >= threshold else -1 if x <= -threshold else None
            action = "HOLD" if now is None or now == held else "OPEN" if held == 0 else "REVERSE"
            held = held if now is None else now
            rows.append((name[0], at, x, action, held))
        state.update((held,))
        yield pd.DataFrame(rows, columns=[key, ts, value, "action", "position"])

    return signals.select(key, ts, value).groupBy(key).applyInPandasWithState(step, out, "held int", "append", GroupStateTimeout.NoTimeout)


def needs_action(position: Column, target: Column) -> Column:
    return F.coalesce(position, F.lit(0)) != F.coalesce(target, F.lit(0))


def broker_side(quantity: Column) -> Column:
    return F.when(quantity > 0, "LONG").when(quantity < 0, "SHORT").otherwise("FLAT")


def merge_sink(stream: DataFrame, root: str, keys: list[str], checkpoint: str, prune: list[str] | None = None) -> StreamingQuery:
    """Micro-batches go through the insert-only merge; a replayed batch is
    identical and writes nothing. With ``prune`` (partition columns) a batch reads
    only the partitions that it touches."""

    def put(batch: DataFrame, _: int) -> None:
        upsert(batch.sparkSession, root, batch, keys, prune)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str = "append", setup: Callable | None = None) -> DataFrame:
    """Run a query over what is there now, into a table in memory."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
