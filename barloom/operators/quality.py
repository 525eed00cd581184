"""Data-quality checks: each is one pass that returns counters, rows with
issues, or raises through ``require``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .windows import minutes_between, ordered

TOLERANCE = 0.005 + 1e-12


class QualityError(ValueError):
    """A check that must hold does not."""


def issues() -> dict[str, Column]:
    """Kinds of row issues of an OHLCV bar; an unknown comparison is no issue."""
    o, h, l, c, v, n, w = (F.col(x) for x in ("open", "high", "low", "close", "volume", "bar_count", "wap"))
    return {
        "missing_price": o.isNull() | h.isNull() | l.isNull() | c.isNull(),
        "high_below_body": h < F.greatest(o, c),
        "low_above_body": l > F.least(o, c),
        "high_below_low": h < l,
        "non_positive_price": F.least(o, h, l, c) <= 0,
        "negative_volume": v < 0,
        "negative_bar_count": n < 0,
        "wap_outside_range": F.greatest(l - w, w - h) > TOLERANCE,
    }


def row_issues(bars: DataFrame, key: list[str]) -> DataFrame:
    """One row per row and issue."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in issues().items()]))
    return bars.select(*key, F.explode(found).alias("issue"))


def integrity(bars: DataFrame) -> DataFrame:
    """All issues counted in one row."""
    return bars.agg(F.count("*").alias("n_rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in issues().items()])


def wap_distance(low: Column, high: Column, wap: Column) -> Column:
    """How far the average price lies outside the bar; 0 inside."""
    return F.greatest(low - wap, wap - high, F.lit(0.0))


def wap_diagnostics(bars: DataFrame) -> DataFrame:
    d = wap_distance(F.col("low"), F.col("high"), F.col("wap"))
    return bars.agg(F.count_if(d > 0).alias("outside"), F.count_if(d > TOLERANCE).alias("beyond_tolerance"), F.max(d).alias("max_excess"))


def duplicate_audit(df: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """Keys that repeat: with one payload (exact) or several (conflicting)."""
    g = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})).alias("kinds")).where("n > 1")
    return g.agg(F.count_if(F.col("kinds") == 1).alias("exact_keys"), F.count_if(F.col("kinds") > 1).alias("conflicting_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def dedupe_or_raise(df: DataFrame, key: list[str]) -> DataFrame:
    """Distinct rows; raises if a key still repeats."""
    d = df.distinct()
    bad = d.groupBy(*key).count().where("count > 1").limit(1).collect()
    if bad:
        raise QualityError(f"conflicting rows for {bad[0].asDict()}")
    return d


def snapshot(parts: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """All parts in one ordered table: equal rows become one, and rows that
    differ under one key raise."""
    return dedupe_or_raise(reduce(DataFrame.unionByName, parts), key).orderBy(*order)


def status(n_fail: Column, n_warn: Column) -> Column:
    return F.when(n_fail > 0, "FAIL").when(n_warn > 0, "WARN").otherwise("PASS")


def outside_expected(observed: DataFrame, grid: DataFrame, keys: list[str], ts: str, first: Column, last: Column) -> DataFrame:
    """Observed rows that the grid does not expect, with a reason."""
    out = observed.join(grid.select(*keys, ts), [*keys, ts], "left_anti")
    reason = F.when(F.col(ts) < first, "before_coverage").when(F.col(ts) > last, "after_coverage").when(F.col("session") == "unknown", "outside_sessions").otherwise("off_grid")
    return out.withColumn("reason", reason)


def carried_close(bars: DataFrame, key: list[str], step: int) -> DataFrame:
    """Marks rows without trades that repeat the close of the row before, one
    step earlier in the same session."""
    w = ordered(key, "datetime")
    last = lambda c: F.lag(c).over(w)
    same = (F.col("volume") == 0) & (F.col("bar_count") == 0) & (minutes_between(F.col("datetime"), last("datetime")) == step) & (last("session") == F.col("session")) & (last("close") == F.col("close"))
    return bars.withColumn("carried_close", F.coalesce(same, F.lit(False)))


def microstructure(bars: DataFrame, by: list[str]) -> DataFrame:
    """Activity counters and exact medians by group."""
    per = F.try_divide(F.col("volume"), F.col("bar_count"))
    return bars.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(F.col("volume") == 0).alias("zero_volume"), F.count_if(F.col("bar_count") == 0).alias("zero_count"), F.count_if(F.col("high") == F.col("low")).alias("flat"), F.avg(per).alias("mean_volume_per_count"), F.median(per).alias("median_volume_per_count"), F.median("volume").alias("median_volume"), F.avg((F.col("volume") > 0).cast("double")).alias("active_share"))


def monotone(df: DataFrame, keys: list[str], order: str, ts: str) -> DataFrame:
    """Steps back in time along the given order; must be none."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_p", F.lag(ts).over(w)).agg(F.count_if(F.col("_p") >= F.col(ts)).alias("steps_back"), F.count("*").alias("n_rows"))


def label_table(df: DataFrame, key: list[str], label: str, threshold: str, domain: tuple = (-1, 0, 1)) -> DataFrame:
    """Rows, repeated keys, labels outside the domain, bad thresholds."""
    t = F.col(threshold)
    counts = df.agg(F.count("*").alias("n_rows"), F.count_if(~F.coalesce(F.col(label).isin(*domain), F.lit(False))).alias("bad_labels"), F.count_if(t.isNull() | F.isnan(t) | (t < 0)).alias("bad_thresholds"))
    return counts.join(df.groupBy(*key).count().agg(F.count_if(F.col("count") > 1).alias("repeated_keys")))


def aligned_dates(df: DataFrame, key: str, day: str) -> DataFrame:
    """Distinct dates of each series against all dates: whether none is missing."""
    every = df.agg(F.count_distinct(day).alias("all_dates"))
    return df.groupBy(key).agg(F.count_distinct(day).alias("dates")).join(F.broadcast(every)).withColumn("aligned", F.col("dates") == F.col("all_dates"))


def require(counts: DataFrame, zero: list[str]) -> None:
    """Raise unless the named counters of a one-row result are 0."""
    row = counts.select(*zero).first()
    bad = {c: row[c] for c in zero if row[c]}
    if bad:
        raise QualityError(f"checks failed: {bad}")


def gate(states: list[str]) -> str:
    """Worst of several states: error, then blocked, then fail, then pass."""
    for worst in ("error", "blocked", "fail"):
        if worst in states:
            return worst
    return "pass"
