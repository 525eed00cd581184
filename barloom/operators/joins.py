"""Joins with declared cardinality, as-of joins and interval labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


class CardinalityError(ValueError):
    """A declared key is not unique."""


class MissingPartnerError(ValueError):
    """A row that must have a partner has none."""


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str], name: str = "table") -> None:
    """Raise if a key repeats. Stops at the first one found."""
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise CardinalityError(f"{name}: key {keys} repeats, e.g. {bad[0].asDict()}")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "one_to_one", matched: str | None = None, complete: bool = False) -> DataFrame:
    """Equi-join that first proves the declared cardinality (``one_to_one``,
    ``many_to_one``); ``matched`` names a flag of found partners. With
    ``complete`` a left row without a partner raises, NULL keys included."""
    if validate == "one_to_one":
        require_unique(left, on, "left")
    if validate in ("one_to_one", "many_to_one"):
        require_unique(right, on, "right")
    if complete:
        alone = left.select(*on).join(right.select(*on), on, "left_anti").limit(1).collect()
        if alone:
            raise MissingPartnerError(f"no partner for {alone[0].asDict()}")
    if matched:
        right = right.withColumn(matched, F.lit(True))
    out = left.join(right, on, how)
    return out.withColumn(matched, F.coalesce(matched, F.lit(False))) if matched else out


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, columns: list[str], tie: list[str] | None = None) -> DataFrame:
    """Latest right row at or before each left row, an equal time included.

    Both sides go in one stream per key, right rows first at equal times; the
    last right row seen is carried on. One shuffle, no range join. Equal right
    times: the last by ``tie`` counts. Left rows without a match get NULLs.
    """
    side = F.struct(F.col(right_ts).alias(right_ts), *[F.col(c).alias(c) for c in columns])
    kept = [c for c in left.columns]
    l = left.select(*kept, F.col(left_ts).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(side).schema[0].dataType).alias("_right"), *[F.lit(None).cast(right.schema[t].dataType).alias(f"_t{k}") for k, t in enumerate(tie or [])])
    r = right.select(*[F.col(k).alias(k) if k in keys else F.lit(None).cast(left.schema[k].dataType).alias(k) for k in kept], F.col(right_ts).alias("_at"), F.lit(0).alias("_side"), side.alias("_right"), *[F.col(t).alias(f"_t{k}") for k, t in enumerate(tie or [])])
    w = Window.partitionBy(*keys).orderBy("_at", "_side", *[f"_t{k}" for k in range(len(tie or []))]).rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_m", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*kept, *[F.col(f"_m.{c}").alias(c if c not in kept else f"right_{c}") for c in [right_ts, *columns]])


def interval_label(df: DataFrame, ts: str, windows: DataFrame, start: str = "start", end: str = "end", order: str = "priority", columns: tuple[str, ...] = ("session", "trading_date"), unknown: str = "unknown") -> DataFrame:
    """Label rows by the half-open window that holds them.

    Windows are cut by calendar day, so the join is an equi-join on the day
    with the range as a residual; of several the lowest ``order`` wins; rows in
    none keep NULL, their first label becomes ``unknown``. The calendar has a
    few rows a day, so it is broadcast.
    """
    days = windows.select("*", F.explode(F.sequence(F.to_date(start), F.to_date(F.col(end) - F.expr("interval 1 microsecond")))).alias("_day"))
    own = F.struct(F.col(order), F.col(start), F.col(end), *[F.col(c) for c in columns])
    by_day = days.groupBy("_day").agg(F.array_sort(F.collect_list(own)).alias("_w"))
    d = df.withColumn("_day", F.to_date(ts)).join(F.broadcast(by_day), "_day", "left")
    hit = F.filter("_w", lambda x: (F.col(ts) >= x[start]) & (F.col(ts) < x[end]))
    d = d.withColumn("_h", F.when(F.size(hit) > 0, F.try_element_at(hit, F.lit(1))))
    first, *others = columns
    return d.withColumn(first, F.coalesce(F.col(f"_h.{first}"), F.lit(unknown))).withColumns({c: F.col(f"_h.{c}") for c in others} | {"window_start": F.col(f"_h.{start}"), "window_end": F.col(f"_h.{end}")}).drop("_day", "_w", "_h")


def in_any_interval(df: DataFrame, ts: str, intervals: DataFrame, start: str, end: str, bucket_minutes: int = 1440) -> DataFrame:
    """Rows inside any closed interval: a left-semi join on time buckets with
    the range as a residual, so it never becomes a nested loop."""
    number = lambda c: F.floor(F.timestamp_diff("MINUTE", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c) / bucket_minutes)
    i = intervals.select(F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(F.sequence(number(F.col(start)), number(F.col(end)))).alias("_b"))
    d = df.withColumn("_b", number(F.col(ts)))
    return d.join(i, (d["_b"] == i["_b"]) & (F.col(ts) >= F.col("_s")) & (F.col(ts) <= F.col("_e")), "left_semi").drop("_b")


def differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full comparison of two tables by key, in one row: keys only left, only
    right, in both, and for each column the pairs that differ (NULLs equal)."""
    l = left.select(*keys, F.struct(*columns).alias("_l"))
    r = right.select(*keys, F.struct(*columns).alias("_r"))
    j = l.join(r, keys, "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    unlike = {f"diff_{c}": F.count_if(both & ~F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}"))) for c in columns}
    return j.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"), F.count_if(both).alias("both"), *[c.alias(n) for n, c in unlike.items()])


def numeric_identity(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """For each column the matched rows that differ by more than a tolerance,
    and the largest difference."""
    j = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in columns]).join(right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in columns]), keys)
    gap = lambda c: F.abs(F.col(f"l_{c}") - F.col(f"r_{c}"))
    return j.agg(F.count("*").alias("matched"), *[F.count_if(gap(c) > tolerance).alias(f"over_{c}") for c in columns], *[F.max(gap(c)).alias(f"max_{c}") for c in columns])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
