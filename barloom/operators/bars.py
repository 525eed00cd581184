"""Bars: building, labelling, gridding, filling and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import flag
from .windows import islands, minutes_between

EPOCH = "1970-01-01 00:00:00"


def bucket_start(ts: Column, minutes: int, anchor: Column | None = None) -> Column:
    """Start of the bucket that holds the time, counted from an anchor."""
    anchor = F.lit(EPOCH).cast("timestamp_ntz") if anchor is None else anchor
    return F.timestamp_add("MINUTE", (F.floor(minutes_between(ts, anchor) / minutes) * minutes).cast("int"), anchor)


def exact_sum(c: Column, scale: int = 6) -> Column:
    """A sum whose result does not depend on the order of rows."""
    return F.sum(c.cast(f"decimal(28,{scale})")).cast("double")


def bars_from_events(events: DataFrame, symbol: str = "event_type", ts: str = "ts", value: str = "value", tie: str = "event_id", minutes: int = 15) -> DataFrame:
    """Point events to bars: ``symbol, datetime, open..close, volume,
    bar_count, wap``. Equal times go by ``tie``."""
    order = F.struct(ts, tie)
    return (
        events.withColumn("_v", F.col(value))
        .groupBy(F.col(symbol).alias("symbol"), bucket_start(F.col(ts), minutes).alias("datetime"))
        .agg(F.min_by("_v", order).alias("open"), F.max("_v").alias("high"), F.min("_v").alias("low"), F.max_by("_v", order).alias("close"), exact_sum(F.col("_v")).alias("volume"), F.count("*").alias("bar_count"))
        .withColumn("wap", F.col("volume") / F.col("bar_count"))
    )


#: Hours at which the sessions of continuous data begin.
def session_of_clock(ts: Column) -> Column:
    """Session by clock alone, for data that trades every day."""
    m = F.hour(ts) * 60 + F.minute(ts)
    return F.when((m < 240) | (m >= 1200), "overnight").when(m < 570, "premarket").when(m < 960, "regular").otherwise("aftermarket")


def trading_date_of_clock(ts: Column) -> Column:
    """The evening belongs to the next day."""
    return F.when(F.hour(ts) >= 20, F.date_add(F.to_date(ts), 1)).otherwise(F.to_date(ts))


def with_clock_sessions(df: DataFrame, ts: str = "datetime") -> DataFrame:
    return df.withColumn("session", session_of_clock(F.col(ts))).withColumn("trading_date", trading_date_of_clock(F.col(ts)))


def expected_grid(windows: DataFrame, step: int, lower: Column | None = None, upper: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """Every expected bar start of half-open windows (``start``, ``end``),
    clipped to [lower, upper]; an empty window gives none."""
    start, end = F.col("start"), F.col("end")
    if lower is not None:
        start = F.greatest(start, lower)
    if upper is not None:
        end = F.least(end, F.timestamp_add("MINUTE", F.lit(step), upper))
    last = F.timestamp_add("MINUTE", F.lit(-step), end)
    every = F.expr(f"interval {step} minutes")
    w = windows.withColumn("_s", start).withColumn("_e", last).where("_e >= _s")
    return w.select(*(carry or []), F.explode(F.sequence("_s", "_e", every)).alias("datetime")).distinct()


def regularize(observed: DataFrame, grid: DataFrame, group: list[str], step: int, most: int = 5, ts: str = "datetime") -> DataFrame:
    """Align observed bars with the grid and fill short inner gaps causally.

    ``group`` names one session of one source. A run of missing rows is
    full_session, leading, trailing or internal. Internal runs of up to ``most``
    rows become flat bars at the last observed close of the session, volume 0.
    Adds ``is_observed, is_imputed, quality_status, gap_type, gap_length,
    imputation_source_datetime``.
    """
    prices = ["open", "high", "low", "close", "wap"]
    g = grid.select(*group, ts).join(observed.withColumn("is_observed", F.lit(True)), [*group, ts], "left").withColumn("is_observed", F.coalesce("is_observed", F.lit(False)))
    every = Window.partitionBy(*group)
    w = every.orderBy(ts)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.col("is_observed")
    g = g.withColumns({
        "_first": F.min(F.when(seen, F.col(ts))).over(every),
        "_last": F.max(F.when(seen, F.col(ts))).over(every),
        "_prev": F.last(F.when(seen, F.struct(F.col("close").alias("close"), F.col(ts).alias("at"))), True).over(past),
        # the rows of a gap share the number of observed rows before them
        "_gap": F.sum(seen.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })
    # runs also end where the grid itself is not contiguous
    jump = minutes_between(F.col(ts), F.lag(ts).over(w)) != step
    g = g.withColumn("_part", F.sum(F.coalesce(jump, F.lit(False)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*group, "_gap", "_part", "is_observed")
    kind = F.when(F.col("_first").isNull(), "full_session").when(F.col(ts) < F.col("_first"), "leading").when(F.col(ts) > F.col("_last"), "trailing").otherwise("internal")
    g = g.withColumns({"gap_type": F.when(~seen, kind), "gap_length": F.when(~seen, F.count("*").over(run))})
    fill = (F.col("gap_type") == "internal") & (F.col("gap_length") <= most) & F.col("_prev").isNotNull()
    fill = F.coalesce(fill, F.lit(False))
    status = F.when(seen, "observed").when(fill, F.concat(F.lit("imputed_"), F.col("gap_type"))).when(F.col("gap_type") == "internal", "missing_internal_too_large").otherwise(F.concat(F.lit("missing_"), F.col("gap_type")))
    filled = {c: F.when(fill, F.col("_prev.close")).otherwise(F.col(c)) for c in prices}
    filled |= {"volume": F.when(fill, F.lit(0.0)).otherwise(F.col("volume")), "bar_count": F.when(fill, F.lit(0).cast("long")).otherwise(F.col("bar_count"))}
    return g.withColumns(filled | {"is_imputed": fill, "quality_status": status, "imputation_source_datetime": F.when(fill, F.col("_prev.at"))}).drop("_first", "_last", "_prev", "_gap", "_part")


def gap_audit(regular: DataFrame, group: list[str], step: int, ts: str = "datetime") -> DataFrame:
    """One row per run of rows that were not observed: its bounds and length,
    and the type and filling that all its rows share."""
    return islands(regular.where(~F.col("is_observed")), group, ts, step, {"gap_type": F.min("gap_type"), "is_imputed": F.min("is_imputed")})


def resample(df: DataFrame, minutes: int, step: int, group: list[str], ts: str = "datetime") -> DataFrame:
    """Bars of a longer frame, anchored at the session start and cut at its end.

    Needs ``session_start, session_end, is_observed, is_imputed``. Of the rows
    with a close: first valid open, highest high, lowest low, last close, sums
    that stay NULL if all is NULL, ``wap`` weighted by all volume above 0 (a
    missing one adds nothing), else the last valid one. Counters and a quality
    status over all rows.
    """
    at, n = F.col(ts), F.col
    start = bucket_start(at, minutes, n("session_start"))
    market = n("close").isNotNull()
    own = lambda c: F.when(market, n(c))
    valid = lambda c: F.when(market & n(c).isNotNull(), at)
    paid = (n("volume") > 0) & market
    weight = exact_sum(F.when(paid, n("volume")))
    worth = F.coalesce(F.sum(F.when(paid, n("wap") * n("volume"))), F.lit(0.0))
    out = df.withColumn("_start", start).groupBy(*group, "session_start", "session_end", "_start").agg(
        F.min_by("open", valid("open")).alias("open"), F.max(own("high")).alias("high"), F.min(own("low")).alias("low"), F.max_by("close", valid("close")).alias("close"),
        exact_sum(own("volume")).alias("volume"), F.sum(own("bar_count")).alias("bar_count"),
        F.coalesce(F.try_divide(worth, weight), F.max_by("wap", valid("wap"))).alias("wap"),
        (F.count("*") * step).alias("source_grid_minutes"), (F.count_if("is_observed") * step).alias("observed_minutes"), (F.count_if("is_imputed") * step).alias("imputed_minutes"),
    )
    out = out.withColumn("bar_end", F.least(F.timestamp_add("MINUTE", F.lit(minutes), n("_start")), n("session_end"))).withColumn("available_at", n("bar_end"))
    out = out.withColumn("expected_minutes", minutes_between(n("bar_end"), n("_start")).cast("long"))
    out = out.withColumn("missing_minutes", F.greatest(n("expected_minutes") - n("observed_minutes") - n("imputed_minutes"), F.lit(0).cast("long")))
    out = out.withColumn("is_complete", (n("source_grid_minutes") == n("expected_minutes")) & (n("missing_minutes") == 0)).withColumn("has_imputation", n("imputed_minutes") > 0)
    quality = F.when(~n("is_complete"), "incomplete").when(n("has_imputation"), "complete_with_imputation").otherwise("complete_observed")
    return out.withColumn("quality_status", quality).withColumnRenamed("_start", ts).drop("session_start", "session_end")


def coverage(grid: DataFrame, observed: DataFrame, keys: list[str], ts: str, by: list[str]) -> DataFrame:
    """Expected, actual and missing bars, and their share in percent."""
    j = grid.join(observed.select(*keys, ts).distinct().withColumn("_seen", F.lit(1)), [*keys, ts], "left")
    out = j.groupBy(*by).agg(F.count("*").alias("expected"), F.count("_seen").alias("actual"), F.min(ts).alias("first_expected"), F.max(ts).alias("last_expected"))
    return out.withColumn("missing", F.col("expected") - F.col("actual")).withColumn("coverage_percent", F.round(F.col("actual") / F.col("expected") * 100, 6))


def observed_conserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: observed bars going in and coming out, and whether they agree."""
    return before.agg(F.count("*").alias("n_in")).join(after.agg(F.count_if("is_observed").alias("n_out"))).withColumn("conserved", flag(F.col("n_in") == F.col("n_out")))
