"""Small synthetic tables for tests and demos: candle shapes, price gaps, gap
patterns. Made from rules, so their size is a parameter."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "datetime timestamp_ntz, scenario string, open double, high double, low double, close double, volume long"


def candle_shapes(spark: SparkSession, start: datetime = datetime(2024, 1, 2, 9)) -> DataFrame:
    """Hourly candles of every shape that ratios stumble over."""
    price = 100.0
    shapes = {
        "normal_up": (0, 2, -1, 1), "normal_down": (0, 1, -2, -1), "doji": (0, 1, -1, 0), "doji_near_high": (1, 1.01, -1, 1), "doji_near_low": (-1, 1, -1.01, -1),
        "full_body_up": (0, 2, 0, 2), "full_body_down": (0, 0, -2, -2), "long_upper": (0, 5, -0.1, 0.2), "long_lower": (0, 0.2, -5, 0.1), "tiny_range": (0, 1e-4, -1e-4, 5e-5),
        "at_high": (0, 1, -1, 1), "at_low": (0, 1, -1, -1), "spinning": (0.1, 2, -2, -0.1),
    }
    rows = [(name, *(price + x for x in shape), 1000) for name, shape in shapes.items()]
    rows += [("flat_no_volume", price, price, price, price, 0), ("flat_with_volume", price, price, price, price, 500), ("zero_volume", price, price + 1, price - 1, price, 0), ("zero_open", 0.0, 1.0, 0.0, 1.0, 10), ("zero_close", 1.0, 1.0, 0.0, 0.0, 10), ("tiny_price", 1e-4, 2e-4, 1e-4, 2e-4, 10), ("huge_price", 1e9, 2e9, 1e9, 2e9, 10)]
    rows += [("high_below_body", price, price - 1, price - 2, price, 10), ("low_above_body", price, price + 2, price + 1, price, 10), ("high_below_low", price, price - 1, price + 1, price, 10), ("negative_price", -1.0, 1.0, -2.0, 0.5, 10)]
    return spark.createDataFrame([(start + timedelta(hours=k), *r) for k, r in enumerate(rows)], SCHEMA)


def price_gaps(spark: SparkSession, start: datetime = datetime(2024, 1, 2)) -> DataFrame:
    """Four-hourly candles with jumps of several sizes between them."""
    close, rows = 100.0, []
    for k, jump in enumerate((0.0, 2.0, -2.0, 1e-4, -1e-4, 25.0, -25.0, 0.0, 5.0, -5.0, 0.5, 0.0)):
        o = close + jump
        close = o + (1 if k % 2 else -1)
        rows.append((start + timedelta(hours=4 * k), f"gap_{jump:+g}", o, max(o, close) + 0.5, min(o, close) - 0.5, close, 100 + k))
    return spark.createDataFrame(rows, SCHEMA)


def scenario_log(spark: SparkSession, scenarios: int = 6, rows: int = 10, start: datetime = datetime(2024, 1, 2)) -> DataFrame:
    """Random-free walks: scenario s moves by s - 2 each step and swings."""
    out = []
    for s in range(scenarios):
        close = 100.0
        for k in range(rows):
            o, close = close, close + (s - 2) + (1.5 if k % 2 else -1.5)
            out.append((start + timedelta(minutes=s * rows + k), f"scenario_{s}", o, max(o, close) + 0.25, min(o, close) - 0.25, close, 10 * (k + 1)))
    return spark.createDataFrame(out, SCHEMA)


def minute_bars(spark: SparkSession, pattern: str, start: datetime, symbol: str = "abc") -> DataFrame:
    """Bars of one symbol by a pattern: ``x`` is a bar, ``.`` a missing one."""
    rows = [(symbol, start + timedelta(minutes=k), 100.0 + k, 101.0 + k, 99.0 + k, 100.5 + k, 10.0 + k, 5, 100.25 + k) for k, c in enumerate(pattern) if c == "x"]
    return spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, bar_count long, wap double")
