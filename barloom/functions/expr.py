"""Column builders with the null rules of the engine: missing is NULL, a
comparison with NULL is false, and no division ever raises."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d; NULL where either is NULL or d is 0."""
    return F.try_divide(n, d)


def safe_ratio_zero(n: Column, d: Column) -> Column:
    """As ``safe_ratio``, but 0 / 0 is 0."""
    return F.when((n == 0) & (d == 0), F.lit(0.0)).otherwise(F.try_divide(n, d))


def safe_bps(n: Column, d: Column) -> Column:
    return F.try_divide(n, d) * 10000.0


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def norm_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def strict_bool(c: Column, name: str = "value") -> Column:
    """Boolean of the accepted words; anything else raises when evaluated."""
    word = norm_key(c.cast("string"))
    bad = F.raise_error(F.concat(F.lit(f"{name} is no boolean: "), F.coalesce(word, F.lit("NULL"))))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False)).otherwise(bad.cast("boolean"))


def to_double(c: Column) -> Column:
    """Numeric coercion: what is no finite number becomes NULL."""
    x = c.try_cast("double")
    return F.when(finite(x), x)


def log_positive(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def log1p_clipped(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def candle(o: Column, h: Column, l: Column, c: Column, v: Column, wap: Column) -> dict[str, Column]:
    """Shape of a candle."""
    span, body = h - l, c - o
    flat = (o == h) & (o == l) & (o == c)
    return {
        "body_bps": safe_bps(body, o),
        "range_bps": safe_bps(span, c),
        "upper_shadow_fraction": safe_ratio_zero(h - F.greatest(o, c), span),
        "lower_shadow_fraction": safe_ratio_zero(F.least(o, c) - l, span),
        "body_to_range": safe_ratio_zero(F.abs(body), span),
        "bullish": flag(c > o),
        "flat_candle": flag(flat),
        "inactive_flat_candle": flag(flat & (v == 0)),
        "strange_flat_candle": flag(flat & (v > 0)),
        "close_wap_bps": safe_bps(c - wap, wap),
    }


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def cyclic_time(ts: Column, day: Column) -> dict[str, Column]:
    """Angles of the minute of the day and of the weekday (Monday 0, of 5)."""
    minute, dow = minute_of_day(ts) * (2 * math.pi / 1440), F.weekday(day) * (2 * math.pi / 5)
    return {"minute_sin": F.sin(minute), "minute_cos": F.cos(minute), "dow_sin": F.sin(dow), "dow_cos": F.cos(dow)}


#: Blocks of the regular session, first minute and name; the last ends before 15:46.
TIME_BLOCKS = ((570, "09:30-10:30"), (630, "10:30-11:30"), (690, "11:30-12:30"), (750, "12:30-13:30"), (810, "13:30-14:30"), (870, "14:30-15:45"))
BLOCKS_END = 946


def time_block(minute: Column, strict: bool = True) -> Column:
    """Block of a prediction minute. Outside: an error, or NULL."""
    outside = F.raise_error(F.concat(F.lit("minute outside the blocks: "), minute.cast("string"))).cast("string") if strict else F.lit(None).cast("string")
    block = F.when((minute < TIME_BLOCKS[0][0]) | (minute >= BLOCKS_END), outside)
    for start, name in reversed(TIME_BLOCKS):
        block = block.when(minute >= start, F.lit(name))
    return block


def local_to_instant(ntz: Column, zone: str) -> Column:
    """Wall time to instant. A time that the clock skips, or shows twice,
    raises, as a silent shift would move the row."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), ntz)
    back = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    later = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc + F.expr("interval 1 hour"))
    earlier = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc - F.expr("interval 1 hour"))
    wrong = F.raise_error(F.concat(F.lit("wall time is skipped or ambiguous: "), ntz.cast("string"))).cast("timestamp_ntz")
    return F.when((back != ntz) | (later == ntz) | (earlier == ntz), wrong).otherwise(utc)


def instant_to_local(utc: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def epoch_or_text(c: Column) -> Column:
    """Instant (NTZ, UTC) of epoch seconds in [1e9, 4e9] or of a text."""
    number = c.try_cast("double")
    return F.when(number.between(1e9, 4e9), F.timestamp_seconds(number).cast("timestamp_ntz")).otherwise(F.try_to_timestamp(c).cast("timestamp_ntz"))


def direction(bps: Column, threshold: float = 0.0) -> Column:
    """-1, 0 or 1 outside a neutral band; NULL stays NULL."""
    return F.when(bps > threshold, 1).when(bps < -threshold, -1).when(bps.isNotNull(), 0)


def atr_label(value: Column, atr: Column, close: Column, multiplier: float = 0.75) -> Column:
    """Three classes around a band of ``multiplier * atr / close``."""
    tau = multiplier * safe_ratio(atr, close)
    return F.when(value < -tau, -1).when(value > tau, 1).when(tau.isNotNull() & value.isNotNull(), 0)


def softmax_up(down: Column, up: Column) -> Column:
    """Probability of the second of two logits, stable for large ones."""
    top = F.greatest(down, up)
    return F.exp(up - top) / (F.exp(down - top) + F.exp(up - top))


def position_size(expected: Column, unit: float = 0.005, most: int = 1000) -> Column:
    return F.least((100 * F.abs(expected) / unit).cast("int"), F.lit(most))


def split_list(c: Column) -> Column:
    """Parts of a list that is separated by |, comma or semicolon."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[|,;]"), lambda x: F.lower(F.trim(x)))
    return F.filter(parts, lambda x: x != "")


def safe_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9._-]+", "_"), F.lit("_"))


def timeframe_minutes(c: Column) -> Column:
    """Minutes of ``15m``, ``1h`` and the like; NULL if it is none."""
    text = F.lower(F.trim(c))
    n = F.regexp_extract(text, r"^(\d+)\s*(m|min|h)$", 1).try_cast("int")
    return F.when(text.rlike(r"h$"), n * 60).otherwise(n)


def timeframe_name(minutes: Column) -> Column:
    return F.when(minutes == 60, F.lit("1h")).otherwise(F.concat(minutes.cast("string"), F.lit("m")))


def duration_start(end: Column, text: str) -> Column:
    """First day of a duration such as ``10 D``, ``2 W``, ``6 M``, ``1 Y``."""
    n, unit = text.split()
    n = int(n)
    return {"D": lambda: F.date_sub(end, n), "W": lambda: F.date_sub(end, 7 * n), "M": lambda: F.add_months(end, -n), "Y": lambda: F.add_months(end, -12 * n)}[unit.upper()]()


def one_hot(c: Column, name: str, vocabulary: list[str]) -> dict[str, Column]:
    """A column for each known value, one for unseen ones, one for missing."""
    known = [v for v in vocabulary if v != "unavailable"]
    gone = c.isNull() | (c == "unavailable")
    out = {f"{name}_{v}": flag(c == v) for v in known}
    out[f"{name}_unavailable"] = flag(gone)
    out[f"{name}_unseen"] = flag(~gone & ~c.isin(*known)) if known else flag(~gone)
    return out


def availability_gate(available: Column, value: Column, sentinel) -> Column:
    """The value where available, otherwise (and where it is NULL) a sentinel."""
    return F.when(F.coalesce(available, F.lit(False)), F.coalesce(value, F.lit(sentinel))).otherwise(F.lit(sentinel))
