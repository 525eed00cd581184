"""Window operators over regularly sampled series.

Every function takes the partition keys, the time column and the step, so it
serves any table. Windows that share keys and order are computed together by
Catalyst in one shuffle and one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def ordered(keys: list[str], ts: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ts)


def minutes_between(later: Column, earlier: Column) -> Column:
    """Whole minutes between two NTZ timestamps."""
    return F.timestamp_diff("MINUTE", earlier, later)


def continuity(df: DataFrame, usable: Column, keys: list[str], ts: str = "datetime", step: int = 1, cap: int = 512) -> DataFrame:
    """Gaps and islands: ``is_usable, break_reason, segment_id,
    contiguous_history`` (rows so far in the segment, 0 if not usable, at most
    ``cap``). A row goes on with a segment if it and the row before are usable
    and exactly one step apart."""
    w = ordered(keys, ts)
    d = df.withColumn("is_usable", F.coalesce(usable, F.lit(False)))
    d = d.withColumn("_pts", F.lag(ts).over(w)).withColumn("_pu", F.lag("is_usable").over(w))
    gap = minutes_between(F.col(ts), F.col("_pts")) != step
    reason = F.when(F.col("_pts").isNull(), "source_start").when(~F.col("is_usable"), "current_unusable").when(gap, "time_gap").when(~F.col("_pu"), "previous_unusable").otherwise("contiguous")
    d = d.withColumn("break_reason", reason)
    d = d.withColumn("segment_id", F.sum((F.col("break_reason") != "contiguous").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(ordered([*keys, "segment_id"], ts))
    return d.withColumn("contiguous_history", F.when(F.col("is_usable"), F.least(place, F.lit(cap))).otherwise(0)).drop("_pts", "_pu")


def rolling(value: Column, w: WindowSpec, n: int, op: str, shift: int = 0) -> Column:
    """Statistic over the last n rows, ``shift`` rows back; NULL unless all n
    are there and not NULL. Deviations are of the population; skewness and
    kurtosis are bias-corrected; quantiles interpolate."""
    frame = w.rowsBetween(-(n - 1) - shift, -shift)
    made = {
        "mean": lambda: F.avg(value),
        "sum": lambda: F.sum(value),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "std": lambda: F.stddev_pop(value),
        "skew": lambda: F.skewness(value),
        "kurt": lambda: F.kurtosis(value),
        "median": lambda: F.percentile(value, F.lit(0.5)),
        "q25": lambda: F.percentile(value, F.lit(0.25)),
        "q75": lambda: F.percentile(value, F.lit(0.75)),
    }[op]().over(frame)
    if op == "skew":
        made = made * math.sqrt(n * (n - 1)) / (n - 2)
    if op == "kurt":
        made = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * made + 6)
    return F.when(F.count(value).over(frame) == n, made)


def _recurrence(df: DataFrame, name: str, value: Column, keys: list[str], ts: str, alpha: float, seed: int, enough: Column) -> DataFrame:
    """Adds e = alpha * x + (1 - alpha) * e over the values that are not NULL,
    seeded by the mean of the first ``seed`` ones; a NULL value keeps the last
    e. ``enough`` tells by ``_n``, the number of values so far, where e is given.

    As e is a sum of values weighted by powers of 1 - alpha, rows are cut into
    blocks of ln(1e16) / alpha values: a running sum of scaled values within a
    block, and the total of the block before, whose weights reach down to what a
    double holds. Work a row is constant and no list is kept, however long the
    partition is; blocks stay on the task of their keys, without a shuffle more.
    """
    w = ordered(keys, ts)
    so_far, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    back, keep = math.ceil(37 / alpha), 1 - alpha
    d = df.withColumn("_x", value.cast("double"))
    d = d.withColumn("_n", F.count("_x").over(so_far))
    at = F.col("_n") - 1
    place = F.pmod(at, F.lit(back))
    if keep > 0:
        scaled = F.when(at < seed, F.lit(keep ** (1 - seed) / seed)).otherwise(alpha * F.pow(F.lit(keep), -place)) * F.col("_x")
        block = Window.partitionBy(*keys, "_b").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("_b", F.floor(at / back))
        d = d.withColumn("_p", F.pow(F.lit(keep), place) * F.sum(scaled).over(block))
        ended = F.last(F.when(F.col("_x").isNotNull() & (place == back - 1), F.col("_p")), ignorenulls=True).over(past)
        d = d.withColumn("_e", F.when(F.col("_x").isNotNull(), F.col("_p") + F.pow(F.lit(keep), place + 1) * F.coalesce(ended, F.lit(0.0))))
    else:
        d = d.withColumn("_e", F.col("_x"))
    d = d.withColumn(name, F.when(enough, F.last("_e", ignorenulls=True).over(so_far)))
    return d.drop("_x", "_n", "_b", "_p", "_e")


def with_ewm(df: DataFrame, name: str, value: Column, keys: list[str], span: int, least: int | None = None, ts: str = "datetime") -> DataFrame:
    """Exponentially weighted mean with alpha = 2 / (span + 1), seeded by the
    first value; NULL unless the last ``least`` (span) rows all have a value."""
    least = least or span
    before = F.lag("_n", least, 0).over(ordered(keys, ts))
    return _recurrence(df, name, value, keys, ts, 2.0 / (span + 1), 1, F.col("_n") - before >= least)


def with_wilder(df: DataFrame, name: str, value: Column, keys: list[str], period: int, ts: str = "datetime") -> DataFrame:
    """Wilder's mean: the plain mean of the first ``period`` values of the
    partition, then ((p - 1) * last + value) / p; NULL before that."""
    return _recurrence(df, name, value, keys, ts, 1.0 / period, period, F.col("_n") >= period)


def islands(df: DataFrame, keys: list[str], ts: str = "datetime", step: int = 1, more: dict[str, Column] | None = None) -> DataFrame:
    """Runs of rows that follow each other by one step: ``keys, run_start,
    run_end, run_length`` and further aggregates. Rows of a run share the time
    that lies their row number of steps back, so one sort finds all runs."""
    number = F.row_number().over(ordered(keys, ts))
    d = df.withColumn("_anchor", F.timestamp_add("MINUTE", -(number * step), F.col(ts)))
    return d.groupBy(*keys, "_anchor").agg(F.min(ts).alias("run_start"), F.max(ts).alias("run_end"), F.count("*").alias("run_length"), *[c.alias(n) for n, c in (more or {}).items()]).drop("_anchor")


def order_number(df: DataFrame, column: str) -> Column:
    """A number that sorts like the column (numeric, date or time)."""
    kind = df.schema[column].dataType.simpleString()
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if kind in ("timestamp", "date"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def prefix_sum(df: DataFrame, order: list[str], value: Column, name: str, by: list[str] | None = None, ranges: int = 64) -> DataFrame:
    """Sum of ``value`` over the rows before each row, without one task that
    sorts everything.

    The first order column (numeric or time) is cut into ranges at approximate
    quantiles, which one action fetches (``ranges`` numbers); sums per range
    give offsets, and only ranges are sorted. NULLs come first. The cuts move
    work, not results. That action runs when the plan is built, not when it is
    executed: of all functions here, this one and those that rank or cut by it are
    not lazy.
    """
    by = by or []
    x = order_number(df, order[0])
    cuts = df.agg(F.percentile_approx(x, [k / ranges for k in range(1, ranges)], 1000).alias("c")).first().c or []
    bucket = sum((F.coalesce(x >= c, F.lit(False)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    d = df.withColumn("_b", bucket)
    totals = d.groupBy(*by, "_b").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(by)], F.col("_b").alias("_kb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.sum(value).over(Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    same = F.col("_b") == F.col("_kb")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{k}"))
    d = d.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    # without groups there are at most ``ranges`` totals
    d = d.join(totals if by else F.broadcast(totals), same)
    return d.withColumn(name, F.col("_inside") + F.col("_o")).drop("_b", "_kb", "_o", "_inside", *[f"_k{k}" for k in range(len(by))])


def run_position(df: DataFrame, breaks: Column, keys: list[str], ts: str, name: str) -> DataFrame:
    """Number of the row in its run; a row where ``breaks`` holds begins one."""
    w = ordered(keys, ts)
    d = df.withColumn("_run", F.sum(F.coalesce(breaks, F.lit(True)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn(name, F.row_number().over(ordered([*keys, "_run"], ts))).drop("_run")


def true_range(h: Column, l: Column, previous_close: Column) -> Column:
    """Greatest of the three ranges; NULL without a close before."""
    return F.when(previous_close.isNotNull(), F.greatest(h - l, F.abs(h - previous_close), F.abs(l - previous_close)))


def with_rsi(df: DataFrame, name: str, change: Column, keys: list[str], period: int = 14, ts: str = "datetime") -> DataFrame:
    """Relative strength index with Wilder smoothing of gains and losses."""
    d = with_wilder(df, "_gain", F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), keys, period, ts)
    d = with_wilder(d, "_loss", F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))), keys, period, ts)
    strength = F.when(F.col("_loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("_gain", "_loss")))
    return d.withColumn(name, strength).drop("_gain", "_loss")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, adjacent: int = 0) -> DataFrame:
    """Union of intervals; those that touch, or lie ``adjacent`` minutes apart,
    become one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | (F.col(start) > F.timestamp_add("MINUTE", F.lit(adjacent), reach))
    d = df.withColumn("_new", new.cast("long"))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")
