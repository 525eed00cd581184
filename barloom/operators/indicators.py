"""Indicators of daily and intraday bars: opening ranges, pivots, bands,
crosses, and features of a location state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import availability_gate, flag, one_hot, safe_ratio
from .joins import checked_join, in_any_interval
from .windows import minutes_between, ordered, rolling, run_position, true_range, with_ewm, with_rsi, with_wilder


def daily(bars: DataFrame, key: str = "symbol", day: str = "trading_date") -> DataFrame:
    return bars.groupBy(key, day).agg(F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "datetime").alias("close"))


def opening_range(bars: DataFrame, minutes: int, start: str, key: str = "symbol", day: str = "trading_date") -> DataFrame:
    """High and low of the first minutes of the session, per date."""
    early = minutes_between(F.col("datetime"), F.col(start)).between(0, minutes - 1)
    return bars.where(early).groupBy(key, day).agg(F.max("high").alias("or_high"), F.min("low").alias("or_low"))


def daily_atr(days: DataFrame, period: int, key: str = "symbol", day: str = "trading_date") -> DataFrame:
    """Wilder's range of daily bars, and that of the day before."""
    w = ordered([key], day)
    tr = F.coalesce(true_range(F.col("high"), F.col("low"), F.lag("close").over(w)), F.col("high") - F.col("low"))
    d = with_wilder(days, "atr", tr, [key], period, day)
    return d.withColumn("prev_atr", F.lag("atr").over(w))


def acd_levels(ranges: DataFrame, atr: DataFrame, a: float = 0.1, c: float = 0.15, key: str = "symbol", day: str = "trading_date") -> DataFrame:
    """Opening range widened by shares of the range of the day before."""
    d = ranges.join(atr.select(key, day, "prev_atr"), [key, day], "left")
    up, down, r = F.col("or_high"), F.col("or_low"), F.col("prev_atr")
    return d.withColumns({"a_up": up + a * r, "a_down": down - a * r, "c_up": up + c * r, "c_down": down - c * r})


def pivots(days: DataFrame, key: str = "symbol", day: str = "trading_date", n: int = 3) -> DataFrame:
    """Pivot of the n days before: mean of high, low and last close, its
    distance to the middle, and the band that spans."""
    w = ordered([key], day)
    past = w.rowsBetween(-n, -1)
    full = F.count("*").over(past) == n
    hi, lo, c = F.max("high").over(past), F.min("low").over(past), F.lag("close").over(w)
    d = days.withColumns({"pivot": F.when(full, (hi + lo + c) / 3), "_mid": F.when(full, (hi + lo) / 2)})
    d = d.withColumn("pivot_distance", F.abs(F.col("pivot") - F.col("_mid")))
    return d.withColumns({"pivot_high": F.col("pivot") + F.col("pivot_distance"), "pivot_low": F.col("pivot") - F.col("pivot_distance")}).drop("_mid")


def bollinger(bars: DataFrame, span: int = 36, width: float = 2.0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    spread = rolling(F.col("close"), ordered(list(keys), "datetime"), span, "std")
    d = with_ewm(bars, "basis", F.col("close"), list(keys), span).withColumn("_s", width * spread)
    return d.withColumns({"upper": F.col("basis") + F.col("_s"), "lower": F.col("basis") - F.col("_s")}).drop("_s")


def momentum(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """RSI(14), means over 5 and 20, relative change, MACD(12, 26, 9)."""
    w, c = ordered(list(keys), "datetime"), F.col("close")
    d = bars.withColumn("_d", c - F.lag(c).over(w))
    d = d.withColumns({"sma_5": rolling(c, w, 5, "mean"), "sma_20": rolling(c, w, 20, "mean"), "pct_change": safe_ratio(F.col("_d"), F.lag(c).over(w))})
    d = with_rsi(d, "rsi_14", F.col("_d"), list(keys))
    for span in (12, 26):
        d = with_ewm(d, f"_e{span}", c, list(keys), span, 1)
    d = with_ewm(d.withColumn("macd", F.col("_e12") - F.col("_e26")), "macd_signal", F.col("macd"), list(keys), 9, 1)
    return d.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop("_d", "_e12", "_e26")


def crosses(bars: DataFrame, level: Column, keys: list[str], confirm: int = 5, ts: str = "datetime") -> DataFrame:
    """Upward crosses of a level, and whether the close has stayed above it for
    ``confirm`` rows since."""
    w = ordered(keys, ts)
    d = bars.withColumn("_above", F.coalesce(F.col("close") > level, F.lit(False)))
    before = F.lag("_above").over(w)
    d = d.withColumn("cross_up", flag(F.col("_above") & ~before))
    d = run_position(d.withColumn("_br", F.coalesce(F.col("_above") != before, F.lit(True))), F.col("_br"), keys, ts, "_k")
    d = d.withColumn("rows_above", F.when(F.col("_above"), F.col("_k")).otherwise(0))
    return d.withColumn("confirmed", flag(F.col("rows_above") >= confirm)).drop("_above", "_br", "_k")


def location_features(bars: DataFrame, low: Column, high: Column, keys: list[str], half_life: float = 10.0, ts: str = "datetime") -> DataFrame:
    """Location against a zone (-1 below, 0 inside, 1 above), distances in zone
    widths, leaves and rejections so far, rows since the last change and its decay."""
    w = ordered(keys, ts)
    c = F.col("close")
    d = bars.withColumn("location", F.when(c < low, -1).when(c > high, 1).when(low.isNotNull() & high.isNotNull(), 0))
    d = d.withColumns({"distance_low": safe_ratio(c - low, high - low), "distance_high": safe_ratio(c - high, high - low), "_p": F.lag("location").over(w)})
    d = d.withColumns({"leave_up": flag((F.col("location") == 1) & (F.col("_p") < 1)), "leave_down": flag((F.col("location") == -1) & (F.col("_p") > -1)), "rejection": flag((F.col("location") == 0) & (F.col("_p") != 0))})
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"leaves_today": F.sum(F.col("leave_up") + F.col("leave_down")).over(so_far), "rejections_today": F.sum("rejection").over(so_far)})
    d = run_position(d.withColumn("_br", F.coalesce(~F.col("location").eqNullSafe(F.col("_p")), F.lit(True))), F.col("_br"), keys, ts, "streak")
    return d.withColumn("streak_decay", F.exp(-(F.col("streak") - 1) / half_life)).drop("_p", "_br")


def reliability(events: DataFrame, days: int, key: str = "symbol", day: str = "trading_date", hit: str = "hits", tried: str = "tries", a: float = 1.0, b: float = 1.0) -> DataFrame:
    """Share of hits over the days before, smoothed by a Beta(a, b) prior."""
    w = ordered([key], day).rowsBetween(-days, -1)
    h, n = F.coalesce(F.sum(hit).over(w), F.lit(0)), F.coalesce(F.sum(tried).over(w), F.lit(0))
    return events.withColumn(f"reliability_{days}d", (h + a) / (n + a + b))


def state_features(base: DataFrame, state: DataFrame, context: DataFrame, environment: DataFrame, regime: DataFrame, gates: dict[str, dict[str, object]]) -> DataFrame:
    """The state-machine layer on a base of rows, whose universe does not change.

    State, context and regime join one to one on (symbol, datetime), the daily
    environment many to one on (symbol, trading_date). ``sm_available``,
    ``sm_env_available`` and ``sm_regime_available`` gate the value columns that
    ``gates`` names under each flag, with a sentinel for each column.
    """
    key = ["symbol", "datetime"]
    d = checked_join(base, state, key, matched="_state")
    d = checked_join(d, context, key, matched="_context")
    d = checked_join(d, regime, key, matched="sm_regime_available")
    d = checked_join(d, environment, ["symbol", "trading_date"], validate="many_to_one", matched="_env")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    d = d.withColumns({"sm_available": yes("opening_range_finalized") & yes("zone_available") & yes("acd_available"), "sm_env_available": F.coalesce(F.col("prediction_time") >= F.col("or_finalized_at"), F.lit(False)) & yes("atr_valid") & yes("or_width_valid")})
    made = {f"f_sm_{c}": availability_gate(F.col(flag_), F.col(c), sentinel) for flag_, columns in gates.items() for c, sentinel in columns.items()}
    return d.withColumns(made).drop("_state", "_context", "_env")


def fit_vocabularies(df: DataFrame, columns: list[str], intervals: DataFrame | None = None, ts: str = "datetime") -> dict[str, list[str]]:
    """Distinct values of each categorical over train rows (those in the
    intervals), without ``unavailable``. A vocabulary is small by contract."""
    if intervals is not None:
        df = in_any_interval(df, ts, intervals, "start", "end")
    one = df.agg(*[F.array_sort(F.collect_set(F.when(F.col(c) != "unavailable", F.col(c)))).alias(c) for c in columns]).first()
    return {c: list(one[c]) for c in columns}


def encode_categories(df: DataFrame, vocabularies: dict[str, list[str]]) -> DataFrame:
    """One-hot columns in place of the raw strings; exactly one is 1 a column."""
    made = {}
    for c, v in vocabularies.items():
        made |= one_hot(F.col(c), c, v)
    return df.withColumns(made).drop(*vocabularies)
