"""Targets at exact horizons, sequences, splits and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import atr_label, direction, finite
from .windows import minutes_between, ordered, prefix_sum, run_position, true_range, with_wilder


def add_target(df: DataFrame, horizon: int, step: int, key: str = "symbol", threshold: float = 0.0, same_session: bool = False) -> DataFrame:
    """Target ``horizon`` rows ahead, which must lie exactly that many steps
    later. Needs ``is_usable, contiguous_history, close, session, trading_date``.
    The first reason that applies is kept."""
    w, h = ordered([key], "datetime"), horizon
    ahead = lambda c: F.lead(c, h).over(w)
    d = df.withColumns({"_ts": ahead("datetime"), "_use": F.coalesce(ahead("is_usable"), F.lit(False)), "_close": ahead("close"), "_hist": ahead("contiguous_history"), "_session": ahead("session"), "_date": ahead("trading_date")})
    exact = F.coalesce(minutes_between(F.col("_ts"), F.col("datetime")) == h * step, F.lit(False))
    same = F.coalesce((F.col("_session") == F.col("session")) & (F.col("_date") == F.col("trading_date")), F.lit(False))
    reason = F.when(~F.col("is_usable"), "current_unusable").when(~exact, "future_not_exact_horizon").when(~F.col("_use"), "future_unusable").when(F.col("_hist") < h + 1, "continuity_break").when(F.coalesce(F.col("close") <= 0, F.lit(True)), "invalid_current_close").when(F.coalesce(F.col("_close") <= 0, F.lit(True)), "invalid_future_close")
    if same_session:
        reason = reason.when(~same, "crosses_session")
    d = d.withColumn(f"target_invalid_reason_{h}m", reason.otherwise("valid")).withColumn(f"target_valid_{h}m", F.col(f"target_invalid_reason_{h}m") == "valid")
    ok = lambda c: F.when(F.col(f"target_valid_{h}m"), c)
    simple = F.col("_close") / F.col("close") - 1
    made = {f"target_realized_at_{h}m": ok(F.timestamp_add("MINUTE", F.lit(step), F.col("_ts"))), f"target_close_{h}m": ok(F.col("_close")), f"target_simple_return_{h}m": ok(simple), f"target_log_return_{h}m": ok(F.ln(F.col("_close") / F.col("close"))), f"target_return_bps_{h}m": ok(simple * 10000), f"target_same_session_{h}m": same}
    d = d.withColumns(made).drop("_ts", "_use", "_close", "_hist", "_session", "_date")
    return d.withColumn(f"target_direction_{h}m", direction(F.col(f"target_return_bps_{h}m"), threshold))


def scope_history(df: DataFrame, sessions: tuple[str, ...], scope: str = "continuous", key: str = "symbol") -> DataFrame:
    """Length of the run of eligible rows (usable and in an allowed session)
    that ends here; a run also ends at a gap, and at a change of session if the
    scope is ``same_session``."""
    w = ordered([key], "datetime")
    d = df.withColumn("_ok", F.coalesce(F.col("is_usable") & F.col("session").isin(*sessions), F.lit(False)))
    breaks = ~F.col("_ok") | ~F.coalesce(F.lag("_ok").over(w), F.lit(False)) | (F.col("contiguous_history") <= 1)
    if scope == "same_session":
        breaks = breaks | (F.lag("session").over(w) != F.col("session")) | (F.lag("trading_date").over(w) != F.col("trading_date"))
    d = run_position(d.withColumn("_br", breaks), F.col("_br"), [key], "datetime", "scope_history")
    return d.withColumn("scope_history", F.when(F.col("_ok"), F.col("scope_history")).otherwise(0)).drop("_ok", "_br")


def window_eligible(length: int, stride: int = 1) -> Column:
    """Whether a window of ``length`` rows may end here, in stride phase."""
    hist = F.col("scope_history")
    return F.col("is_usable") & (F.col("contiguous_history") >= length) & (hist >= length) & ((hist - length) % stride == 0)


def window_finite(df: DataFrame, features: list[str], length: int, key: str = "symbol") -> DataFrame:
    """Whether all features are finite in all of the last ``length`` rows, by a
    difference of prefix sums: constant work a row whatever the length."""
    good = F.lit(True)
    for c in features:
        good = good & finite(F.col(c))
    w = ordered([key], "datetime")
    d = df.withColumn("_sum", F.sum(good.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("window_finite", F.coalesce(F.col("_sum") - F.coalesce(F.lag("_sum", length).over(w), F.when(F.row_number().over(w) == length, F.lit(0))) == length, F.lit(False))).drop("_sum")


def split_plan(df: DataFrame, train: float = 0.70, validation: float = 0.15, day: str = "trading_date") -> DataFrame:
    """``trading_date, split`` by floor fractions of the distinct dates, each
    part at least one date (three dates or more)."""
    days = df.select(day).distinct()
    w = Window.orderBy(day)
    n = F.count("*").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = days.withColumn("_k", F.row_number().over(w)).withColumn("_n", n)
    t = F.least(F.greatest(F.floor(F.col("_n") * train), F.lit(1)), F.col("_n") - 2)
    v = F.least(F.greatest(F.floor(F.col("_n") * validation), F.lit(1)), F.col("_n") - t - 1)
    return d.select(day, F.when(F.col("_k") <= t, "train").when(F.col("_k") <= t + v, "validation").otherwise("test").alias("split"))


def assign_split(df: DataFrame, plan: DataFrame, day: str = "trading_date") -> DataFrame:
    return df.join(F.broadcast(plan), day)  # one row a trading date


def purge(df: DataFrame, realized: str, at: str = "prediction_time") -> DataFrame:
    """Drop train and validation rows whose target is realised after the last
    prediction of their split; an equal time stays."""
    cutoff = df.groupBy("split").agg(F.max(at).alias("_cut"))
    return df.join(F.broadcast(cutoff), "split").where((F.col("split") == "test") | (F.col(realized) <= F.col("_cut"))).drop("_cut")


def embargo(df: DataFrame, realized: str, at: str = "prediction_time") -> DataFrame:
    """Drop train rows whose target is realised at or after the first
    prediction of validation."""
    first = df.where("split = 'validation'").agg(F.min(at).alias("_first"))
    return df.join(F.broadcast(first)).where((F.col("split") != "train") | F.col("_first").isNull() | (F.col(realized) < F.col("_first"))).drop("_first")


def dense_index(df: DataFrame, order: list[str], name: str = "sample_index") -> DataFrame:
    """Dense global numbers in a given (total) order, without one task that
    sorts everything."""
    return prefix_sum(df, order, F.lit(1), name).withColumn(name, F.col(name).cast("long"))


def wilder_atr(df: DataFrame, period: int, step: int, key: str = "symbol") -> DataFrame:
    """Wilder's average true range over usable rows with positive prices; it
    starts anew behind every gap, where the first range is high - low."""
    w = ordered([key], "datetime")
    d = df.withColumn("_ok", F.coalesce(F.col("is_usable") & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0), F.lit(False))).where("_ok")
    gap = F.coalesce(minutes_between(F.col("datetime"), F.lag("datetime").over(w)) != step, F.lit(True))
    d = d.withColumn("_b", gap.cast("long")).withColumn("_block", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = ordered([key, "_block"], "datetime")
    tr = F.coalesce(true_range(F.col("high"), F.col("low"), F.lag("close").over(b)), F.col("high") - F.col("low"))
    d = d.withColumn("true_range", tr)
    return with_wilder(d, f"atr_{period}", F.col("true_range"), [key, "_block"], period).drop("_ok", "_b", "_block")


def labelled(df: DataFrame, value: str, atr: str, close: str = "close", multiplier: float = 0.75) -> DataFrame:
    return df.withColumn("threshold", multiplier * F.try_divide(F.col(atr), F.col(close))).withColumn("label", atr_label(F.col(value), F.col(atr), F.col(close), multiplier))


def even_sample(df: DataFrame, k: int, order: list[str], by: list[str]) -> DataFrame:
    """k rows of each group at even distances, the first and last included."""
    every = Window.partitionBy(*by)
    d = df.withColumn("_n", F.count("*").over(every)).withColumn("_r", F.row_number().over(every.orderBy(*order)) - 1)
    n, r = F.col("_n") - 1, F.col("_r")
    # row r is taken if some i < k has floor(i * (n - 1) / (k - 1)) = r
    i = F.ceil(r * (k - 1) / F.greatest(n, F.lit(1)))
    return d.where((F.col("_n") <= k) | ((i < k) & (F.floor(i * n / (k - 1)) == r))).drop("_n", "_r")


def window_rows(df: DataFrame, columns: list[str], length: int, key: str = "symbol") -> DataFrame:
    """The last ``length`` rows as an array of feature arrays, oldest first;
    NULL until there are that many."""
    w = ordered([key], "datetime").rowsBetween(-(length - 1), 0)
    rows = F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(w)
    return df.withColumn("window", F.when(F.count("*").over(w) == length, rows))


def tabular_features(df: DataFrame, columns: list[str], length: int, lags: tuple[int, ...], key: str = "symbol") -> DataFrame:
    """Flat form of a window: lagged values, window mean and deviation."""
    w = ordered([key], "datetime")
    frame = w.rowsBetween(-(length - 1), 0)
    made = {}
    for c in columns:
        made |= {f"{c}_lag{k}": F.lag(c, k).over(w) if k else F.col(c) for k in lags}
        made |= {f"{c}_mean": F.when(F.count(c).over(frame) == length, F.avg(c).over(frame)), f"{c}_std": F.when(F.count(c).over(frame) == length, F.stddev_pop(c).over(frame))}
    return df.withColumns(made)
