"""Causal features of bars, of one frame and of longer frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expr import candle, cyclic_time, flag, log1p_clipped, log_positive, safe_bps, safe_ratio
from .joins import asof_join
from .windows import continuity, minutes_between, ordered, rolling, true_range, with_ewm

MARKET = ("open", "high", "low", "close", "volume", "bar_count", "wap")


def usable_bar():
    """All market columns are there."""
    out = F.lit(True)
    for c in MARKET:
        out = out & F.col(c).isNotNull()
    return out


def with_continuity(bars: DataFrame, step: int, key: str = "symbol") -> DataFrame:
    return continuity(bars, usable_bar(), [key], "datetime", step)


def candle_features(bars: DataFrame, prefix: str = "f_1m_") -> DataFrame:
    made = candle(*(F.col(c) for c in ("open", "high", "low", "close", "volume", "wap")))
    return bars.withColumns({prefix + k: v for k, v in made.items()})


def return_features(bars: DataFrame, key: str = "symbol", lags: tuple[int, ...] = (1, 5, 15, 30, 60), prefix: str = "f_1m_") -> DataFrame:
    """Log returns over k rows and the true range in bps, inside segments."""
    w = ordered([key, "segment_id"], "datetime")
    now = log_positive(F.col("close"))
    before = F.lag("close").over(w)
    made = {f"{prefix}log_return_{k}": now - F.lag(now, k).over(w) for k in lags}
    made[f"{prefix}true_range_bps"] = safe_bps(true_range(F.col("high"), F.col("low"), before), before)
    return bars.withColumns(made)


def session_keys(key: str = "symbol") -> list[str]:
    return [key, "trading_date", "session", "segment_id"]


def session_window(key: str = "symbol"):
    return ordered(session_keys(key), "datetime")


def volatility_features(bars: DataFrame, key: str = "symbol", windows: tuple[int, ...] = (5, 15, 30, 60), window: int = 20, prefix: str = "f_1m_") -> DataFrame:
    """Rolling deviation of the one-row return, and its distribution."""
    w, r = session_window(key), F.col(f"{prefix}log_return_1")
    made = {f"{prefix}session_volatility_{n}": rolling(r, w, n, "std") for n in windows}
    made |= {f"{prefix}session_return_{op}_{window}": rolling(r, w, window, op) for op in ("mean", "std", "skew", "kurt")}
    made[f"{prefix}session_return_iqr_{window}"] = rolling(r, w, window, "q75") - rolling(r, w, window, "q25")
    made[f"{prefix}session_return_z_{window}"] = safe_ratio(r - rolling(r, w, window, "mean"), rolling(r, w, window, "std"))
    return bars.withColumns(made)


def activity_features(bars: DataFrame, key: str = "symbol", windows: tuple[int, ...] = (20, 60), prefix: str = "f_1m_") -> DataFrame:
    """Volume, trades and turnover against the rows before this one."""
    w = session_window(key)
    base = {"volume": F.col("volume"), "bar_count": F.col("bar_count").cast("double"), "dollar_volume": F.col("volume") * F.col("wap")}
    made = {f"{prefix}log_{c}": log1p_clipped(x) for c, x in base.items()}
    for n in windows:
        for c, x in base.items():
            mean, std = rolling(x, w, n, "mean", 1), rolling(x, w, n, "std", 1)
            made[f"{prefix}session_relative_{c}_{n}"] = safe_ratio(x, mean)
            made[f"{prefix}session_{c}_z_{n}"] = safe_ratio(x - mean, std)
    return bars.withColumns(made)


def ema_features(bars: DataFrame, key: str = "symbol", spans: tuple[int, int] = (20, 50), prefix: str = "f_1m_session_") -> DataFrame:
    """Price against its exponential means, the two against each other, and
    their slopes, in bps."""
    w, c = session_window(key), F.col("close")
    a, b = spans
    d = bars
    for n in spans:
        d = with_ewm(d, f"_ema{n}", c, session_keys(key), n)
    made = {f"{prefix}price_vs_ema{n}_bps": safe_bps(c - F.col(f"_ema{n}"), F.col(f"_ema{n}")) for n in spans}
    made[f"{prefix}ema{a}_vs_ema{b}_bps"] = safe_bps(F.col(f"_ema{a}") - F.col(f"_ema{b}"), F.col(f"_ema{b}"))
    for n in spans:
        last = F.lag(f"_ema{n}").over(w)
        made[f"{prefix}ema{n}_slope_bps"] = safe_bps(F.col(f"_ema{n}") - last, last)
    return d.withColumns(made).drop(*[f"_ema{n}" for n in spans])


def quality_features(bars: DataFrame, key: str = "symbol", windows: tuple[int, ...] = (20, 60)) -> DataFrame:
    w = session_window(key)
    made = {}
    for n in windows:
        made[f"f_quality_session_imputed_fraction_{n}"] = rolling(F.col("is_imputed").cast("double"), w, n, "mean")
        made[f"f_quality_session_observed_fraction_{n}"] = rolling(F.col("is_observed").cast("double"), w, n, "mean")
    return bars.withColumns(made)


def session_features(bars: DataFrame, start: str, end: str, step: int) -> DataFrame:
    """Position in the session at prediction time, clock angles, one-hots."""
    at = F.timestamp_add("MINUTE", F.lit(step), F.col("datetime"))
    gone = minutes_between(at, F.col(start)).cast("double")
    whole = minutes_between(F.col(end), F.col(start)).cast("double")
    made = {"f_session_elapsed_minutes": gone, "f_session_remaining_minutes": whole - gone, "f_session_progress": safe_ratio(gone, whole)}
    made |= {f"f_time_{k}": v for k, v in cyclic_time(at, F.col("trading_date")).items()}
    made |= {f"f_session_is_{s}": flag(F.col("session") == s) for s in ("premarket", "regular", "aftermarket", "overnight")}
    return bars.withColumns(made)


def one_minute_features(bars: DataFrame, step: int, key: str = "symbol") -> DataFrame:
    """All 61 features of one frame, in the order in which they build on each
    other. Needs regularized bars with ``session_start`` and ``session_end``;
    everything partitions by session where it may, so a single long source
    still spreads over tasks."""
    d = with_continuity(bars, step, key)
    d = candle_features(d)
    d = return_features(d, key)
    d = volatility_features(d, key)
    d = activity_features(d, key)
    d = quality_features(ema_features(d, key), key)
    return session_features(d, "session_start", "session_end", step)


def higher_timeframe_features(bars: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The 14 features of longer bars: complete ones only, contiguous if a bar starts
    where the one before ended, within source, date and session."""
    d = bars.where(F.col("is_complete") & F.col("close").isNotNull())
    w = ordered(keys, "datetime")
    broken = F.coalesce(F.lag("bar_end").over(w) != F.col("datetime"), F.lit(True))
    d = d.withColumn("_b", broken.cast("long")).withColumn("_segment", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = ordered([*keys, "_segment"], "datetime")
    p = f"f_{name}_"
    now, before = log_positive(F.col("close")), F.lag("close").over(s)
    shape = candle(*(F.col(c) for c in ("open", "high", "low", "close", "volume", "wap")))
    shape = {k: v for k, v in shape.items() if k not in ("bullish", "flat_candle", "inactive_flat_candle", "strange_flat_candle")}
    shape |= {"has_imputation": flag(F.col("has_imputation")), "expected_minutes": F.col("expected_minutes").cast("double")}
    d = d.withColumns({p + k: v for k, v in shape.items()} | {p + "log_return_1": now - F.lag(now).over(s), p + "log_return_3": now - F.lag(now, 3).over(s), p + "true_range_bps": safe_bps(true_range(F.col("high"), F.col("low"), before), before), p + "log_volume": log1p_clipped(F.col("volume")), p + "log_bar_count": log1p_clipped(F.col("bar_count").cast("double"))})
    return d.withColumn(p + "volatility_3", rolling(F.col(p + "log_return_1"), s, 3, "std")).drop("_b", "_segment")


def merge_higher_timeframe(base: DataFrame, context: DataFrame, name: str, columns: list[str], key: str = "symbol", at: str = "prediction_time") -> DataFrame:
    """Attach the latest longer bar that was complete at prediction time, its
    age, whether it shares date and session, and the move since its close."""
    wanted = [*columns, "close", "trading_date", "session"]
    right = context.select(key, "available_at", *[F.col(c).alias(f"_c_{c}") for c in wanted])
    d = asof_join(base, right, [key], at, "available_at", [f"_c_{c}" for c in wanted])
    made = {
        f"f_{name}_age_minutes": minutes_between(F.col(at), F.col("available_at")).cast("double"),
        f"f_{name}_same_trading_date": flag(F.col("_c_trading_date") == F.col("trading_date")),
        f"f_{name}_same_session": flag((F.col("_c_session") == F.col("session")) & (F.col("_c_trading_date") == F.col("trading_date"))),
        f"f_{name}_close_anchor_bps": safe_bps(F.col("close") - F.col("_c_close"), F.col("_c_close")),
        f"ctx_{name}_available_at": F.col("available_at"),
    }
    return d.withColumns(made | {c: F.col(f"_c_{c}") for c in columns}).drop("available_at", *[f"_c_{c}" for c in wanted])


def leaks(df: DataFrame, available: str, at: str) -> DataFrame:
    """Rows whose context was not available yet; must be none."""
    return df.agg(F.count_if(F.col(available) > F.col(at)).alias("leaks"), F.count("*").alias("n_rows"))
