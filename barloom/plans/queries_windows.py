"""Window operators: continuity, returns, rolling and exponential statistics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import features as FE
from ..operators import indicators as I
from ..operators.windows import merge_intervals, ordered, rolling, with_ewm, with_wilder
from .data import STEP, bars, r6, raw_bars, returns, rounded, segmented, sql, table, with_windows
from .queries_bars import GRID, HOURS
from .registry import query

K = "symbol, datetime, "
SW = "PARTITION BY symbol, trading_date, session, segment_id ORDER BY datetime"


def frame(n, shift=0):
    return f"({SW} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {'CURRENT ROW' if not shift else f'{shift} PRECEDING'})"


def roll(expr, value, n, shift=0):
    return f"CASE WHEN count({value}) OVER {frame(n, shift)} = {n} THEN {expr} OVER {frame(n, shift)} END"


@query("W1_lag_lead", sql("sb", f"SELECT {K}lag(close) OVER w AS prev_close, lead(close, 2) OVER w AS next_close FROM sb WINDOW w AS (PARTITION BY symbol ORDER BY datetime)"))
def _(spark, sf):
    w = ordered(["symbol"], "datetime")
    return bars(spark, sf).select("symbol", "datetime", F.lag("close").over(w).alias("prev_close"), F.lead("close", 2).over(w).alias("next_close"))


@query("W2_W4_continuity", sql("cb", f"SELECT {K}is_usable, break_reason, segment_id, contiguous_history FROM cb"))
def _(spark, sf):
    return segmented(spark, sf).select("symbol", "datetime", "is_usable", "break_reason", "segment_id", "contiguous_history")


@query("P9_usable", sql("sb", "SELECT symbol, count(*) AS n, count(close) AS usable FROM sb GROUP BY 1"))
def _(spark, sf):
    return bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(FE.usable_bar()).alias("usable"))


@query("W5_W6_returns", sql("rr", f"SELECT {K}round(r1, 6) AS r1, round(r5, 6) AS r5, round(r15, 6) AS r15, round(CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) / nullif(pc, 0) * 10000 END, 6) AS true_range_bps FROM rr"))
def _(spark, sf):
    d = returns(spark, sf)
    return rounded(d.select("symbol", "datetime", *[F.col(f"f_1m_log_return_{k}").alias(f"r{k}") for k in (1, 5, 15)], F.col("f_1m_true_range_bps").alias("true_range_bps")))


@query("W7_rolling", sql("rr", f"SELECT {K}round({roll('avg(r1)', 'r1', 5)}, 6) AS mean_5, round({roll('stddev_pop(r1)', 'r1', 5)}, 6) AS std_5, round({roll('median(r1)', 'r1', 5)}, 6) AS median_5, round({roll('min(r1)', 'r1', 5)}, 6) AS min_5, round({roll('max(r1)', 'r1', 5)}, 6) AS max_5, round({roll('stddev_pop(r1)', 'r1', 10)}, 6) AS std_10 FROM rr"))
def _(spark, sf):
    w, r = FE.session_window(), F.col("f_1m_log_return_1")
    return rounded(returns(spark, sf).select("symbol", "datetime", *[rolling(r, w, 5, op).alias(f"{op}_5") for op in ("mean", "std", "median", "min", "max")], rolling(r, w, 10, "std").alias("std_10")))


@query("W8_skew_kurt", sql("sb", f"SELECT {K}round(CASE WHEN count(high) OVER v = 10 THEN skewness(high) OVER v END, 5) AS skew_10, round(CASE WHEN count(high) OVER v = 10 THEN kurtosis(high) OVER v END, 5) AS kurt_10 FROM sb WINDOW v AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"))
def _(spark, sf):
    w = ordered(["symbol"], "datetime")
    return rounded(bars(spark, sf).select("symbol", "datetime", rolling(F.col("high"), w, 10, "skew").alias("skew_10"), rolling(F.col("high"), w, 10, "kurt").alias("kurt_10")), 5)


@query("W9_quantiles", sql("rr", f"SELECT {K}round({roll('quantile_cont(r1, 0.25)', 'r1', 6)}, 6) AS q25, round({roll('quantile_cont(r1, 0.75)', 'r1', 6)}, 6) AS q75 FROM rr"))
def _(spark, sf):
    w, r = FE.session_window(), F.col("f_1m_log_return_1")
    return rounded(returns(spark, sf).select("symbol", "datetime", rolling(r, w, 6, "q25").alias("q25"), rolling(r, w, 6, "q75").alias("q75")))


@query("W10_volatility", sql("rr", f"SELECT {K}round({roll('stddev_pop(r1)', 'r1', 5)}, 6) AS v5, round({roll('avg(r1)', 'r1', 8)}, 6) AS mean_8, round({roll('quantile_cont(r1, 0.75)', 'r1', 8)} - {roll('quantile_cont(r1, 0.25)', 'r1', 8)}, 6) AS iqr_8, round((r1 - {roll('avg(r1)', 'r1', 8)}) / nullif({roll('stddev_pop(r1)', 'r1', 8)}, 0), 5) AS z_8 FROM rr"))
def _(spark, sf):
    d = FE.volatility_features(returns(spark, sf), windows=(5,), window=8)
    return rounded(d.select("symbol", "datetime", F.round("f_1m_session_volatility_5", 6).alias("v5"), F.round("f_1m_session_return_mean_8", 6).alias("mean_8"), F.round("f_1m_session_return_iqr_8", 6).alias("iqr_8"), F.round("f_1m_session_return_z_8", 5).alias("z_8")))


@query("W11_activity", sql("cb", f"SELECT {K}round(ln(1 + volume), 6) AS log_volume, round(volume / nullif({roll('avg(volume)', 'volume', 5, 1)}, 0), 6) AS relative_volume_5, round((volume - {roll('avg(volume)', 'volume', 5, 1)}) / nullif({roll('stddev_pop(volume)', 'volume', 5, 1)}, 0), 5) AS volume_z_5, round(bar_count / nullif({roll('avg(bar_count)', 'bar_count', 5, 1)}, 0), 6) AS relative_count_5 FROM cb"))
def _(spark, sf):
    d = FE.activity_features(segmented(spark, sf), windows=(5,))
    return rounded(d.select("symbol", "datetime", F.col("f_1m_log_volume").alias("log_volume"), F.col("f_1m_session_relative_volume_5").alias("relative_volume_5"), F.round("f_1m_session_volume_z_5", 5).alias("volume_z_5"), F.col("f_1m_session_relative_bar_count_5").alias("relative_count_5")))


EMA = """, e0 AS (SELECT symbol, trading_date, session, segment_id, datetime, close, row_number() OVER w AS rn FROM cb WHERE is_usable WINDOW w AS (PARTITION BY symbol, trading_date, session, segment_id ORDER BY datetime)),
 e AS (SELECT a.symbol, a.datetime, a.close, a.trading_date, a.session, a.segment_id, a.rn, sum(CASE WHEN b.rn = 1 THEN pow(1 - 2.0 / 5, a.rn - 1) ELSE 2.0 / 5 * pow(1 - 2.0 / 5, a.rn - b.rn) END * b.close) AS m FROM e0 a JOIN e0 b USING (symbol, trading_date, session, segment_id) WHERE b.rn <= a.rn GROUP BY ALL),
 ee AS (SELECT *, CASE WHEN rn >= 4 THEN m END AS ema4 FROM e)"""


@query("W12_ema", sql("cb", EMA + " SELECT symbol, datetime, round(ema4, 5) AS ema4, round((close - ema4) / nullif(ema4, 0) * 10000, 3) AS price_vs_ema4, round((ema4 - lag(ema4) OVER w) / nullif(lag(ema4) OVER w, 0) * 10000, 3) AS slope FROM ee WINDOW w AS (PARTITION BY symbol, trading_date, session, segment_id ORDER BY datetime)"))
def _(spark, sf):
    w = FE.session_window()
    d = with_ewm(segmented(spark, sf).where("is_usable"), "ema4", F.col("close"), FE.session_keys(), 4)
    last = F.lag("ema4").over(w)
    return d.select("symbol", "datetime", F.round("ema4", 5).alias("ema4"), F.round(F.try_divide(F.col("close") - F.col("ema4"), F.col("ema4")) * 10000, 3).alias("price_vs_ema4"), F.round(F.try_divide(F.col("ema4") - last, last) * 10000, 3).alias("slope"))


def ema_sql(span: int) -> str:
    """The weighted sum itself, over whole symbols."""
    a = f"2.0 / {span + 1}"
    return f"e{span} AS (SELECT a.symbol, a.rn, sum(CASE WHEN b.rn = 1 THEN pow(1 - {a}, a.rn - 1) ELSE {a} * pow(1 - {a}, a.rn - b.rn) END * b.close) AS m FROM n0 a JOIN n0 b USING (symbol) WHERE b.rn <= a.rn AND a.rn >= {span} GROUP BY ALL)"


@query("W12_ema_production_spans", sql("rb", ", n0 AS (SELECT symbol, datetime, close, row_number() OVER (PARTITION BY symbol ORDER BY datetime) AS rn FROM rb), " + ema_sql(20) + ", " + ema_sql(50) + " SELECT symbol, datetime, round(e20.m, 5) AS ema_20, round(e50.m, 5) AS ema_50 FROM n0 LEFT JOIN e20 USING (symbol, rn) LEFT JOIN e50 USING (symbol, rn)"))
def _(spark, sf):
    d = with_ewm(raw_bars(spark, sf).select("symbol", "datetime", "close"), "ema_20", F.col("close"), ["symbol"], 20)
    d = with_ewm(d, "ema_50", F.col("close"), ["symbol"], 50)
    return d.select("symbol", "datetime", F.round("ema_20", 5).alias("ema_20"), F.round("ema_50", 5).alias("ema_50"))


@query("W23_wilder_period_14", sql("rb", ", n0 AS (SELECT symbol, datetime, high - low AS tr, row_number() OVER (PARTITION BY symbol ORDER BY datetime) AS rn FROM rb), a14 AS (SELECT a.symbol, a.rn, sum(CASE WHEN b.rn <= 14 THEN pow(13.0 / 14, a.rn - 14) / 14 ELSE pow(13.0 / 14, a.rn - b.rn) / 14 END * b.tr) AS m FROM n0 a JOIN n0 b USING (symbol) WHERE b.rn <= a.rn AND a.rn >= 14 GROUP BY ALL) SELECT symbol, datetime, round(m, 5) AS wilder_14 FROM n0 LEFT JOIN a14 USING (symbol, rn)"))
def _(spark, sf):
    d = with_wilder(raw_bars(spark, sf).select("symbol", "datetime", "high", "low"), "wilder_14", F.col("high") - F.col("low"), ["symbol"], 14)
    return d.select("symbol", "datetime", F.round("wilder_14", 5).alias("wilder_14"))


@query("W14_W15_higher_timeframe", sql("ss", HOURS + """, c0 AS (SELECT *, CASE WHEN lag(bar_end) OVER w = datetime THEN 0 ELSE 1 END AS b FROM h60 WHERE is_complete AND close IS NOT NULL WINDOW w AS (PARTITION BY symbol, trading_date, session ORDER BY datetime)),
 c1 AS (SELECT *, sum(b) OVER (PARTITION BY symbol, trading_date, session ORDER BY datetime) AS seg FROM c0),
 c2 AS (SELECT *, lag(close) OVER w AS pc, ln(close) - ln(lag(close) OVER w) AS r1, ln(close) - ln(lag(close, 3) OVER w) AS r3 FROM c1 WINDOW w AS (PARTITION BY symbol, trading_date, session, seg ORDER BY datetime))
 SELECT symbol, trading_date, session, datetime, round(r1, 6) AS log_return_1, round(r3, 6) AS log_return_3, round(greatest(high - low, abs(high - pc), abs(low - pc)) / pc * 10000, 4) AS true_range_bps, round(ln(1 + greatest(volume, 0)), 6) AS log_volume, round(ln(1 + bar_count), 6) AS log_bar_count, has_imputation::INT::DOUBLE AS has_imputation, expected_minutes::DOUBLE AS expected_minutes,
 round(CASE WHEN count(r1) OVER f = 3 THEN stddev_pop(r1) OVER f END, 6) AS volatility_3 FROM c2 WINDOW f AS (PARTITION BY symbol, trading_date, session, seg ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""))
def _(spark, sf):
    """What longer bars add; their candle shape is compared in F5 to F7."""
    from .queries_bars import GROUP, resampled

    d = FE.higher_timeframe_features(resampled(spark, sf), "1h", GROUP)
    f = lambda c, places=6: F.round(F.col(f"f_1h_{c}").cast("double"), places).alias(c)
    return d.select(*GROUP, "datetime", *[f(c) for c in ("log_return_1", "log_return_3", "log_volume", "log_bar_count", "has_imputation", "expected_minutes", "volatility_3")], f("true_range_bps", 4))


@query("W14_W15_all_columns")
def _(spark, sf):
    from .queries_bars import GROUP, resampled

    return rounded(FE.higher_timeframe_features(resampled(spark, sf), "1h", GROUP))


ATR = """, a0 AS (SELECT *, CASE WHEN datediff('minute', lag(datetime) OVER w, datetime) = 15 THEN 0 ELSE 1 END AS b FROM cb WHERE is_usable AND high > 0 AND low > 0 AND close > 0 WINDOW w AS (PARTITION BY symbol ORDER BY datetime)),
 a1 AS (SELECT *, sum(b) OVER (PARTITION BY symbol ORDER BY datetime) AS blk FROM a0),
 a2 AS (SELECT *, row_number() OVER w AS rn, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM a1 WINDOW w AS (PARTITION BY symbol, blk ORDER BY datetime)),
 atr_t AS (SELECT a.symbol, a.datetime, a.close, a.tr, a.rn, CASE WHEN a.rn >= 3 THEN sum(CASE WHEN b.rn <= 3 THEN pow(2.0 / 3, a.rn - 3) / 3 ELSE pow(2.0 / 3, a.rn - b.rn) / 3 END * b.tr) END AS atr_3 FROM a2 a JOIN a2 b USING (symbol, blk) WHERE b.rn <= a.rn GROUP BY a.symbol, a.datetime, a.close, a.tr, a.rn)"""


@query("W23_wilder_atr", sql("cb", ATR + " SELECT symbol, datetime, round(tr, 6) AS true_range, round(atr_3, 5) AS atr_3 FROM atr_t"))
def _(spark, sf):
    from ..operators.targets import wilder_atr

    return wilder_atr(segmented(spark, sf), 3, STEP).select("symbol", "datetime", F.round("true_range", 6).alias("true_range"), F.round("atr_3", 5).alias("atr_3"))


def regular(spark, sf):
    """Regularized bars with segments and session bounds."""
    from .queries_bars import gridded

    return FE.with_continuity(with_windows(gridded(spark, sf)[2]), STEP)


@query("W13_quality_fraction", sql("ss", GRID + """, u1 AS (SELECT *, close IS NOT NULL AND open IS NOT NULL AS ok FROM reg), u2 AS (SELECT *, lag(datetime) OVER w AS pt2, lag(ok) OVER w AS pok FROM u1 WINDOW w AS (PARTITION BY symbol ORDER BY datetime)),
 u3 AS (SELECT *, sum(CASE WHEN pt2 IS NULL OR NOT ok OR datediff('minute', pt2, datetime) <> 15 OR NOT pok THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY datetime) AS seg FROM u2)
 SELECT symbol, datetime, round(CASE WHEN count(*) OVER f = 4 THEN avg(is_imputed::INT) OVER f END, 6) AS imputed, round(CASE WHEN count(*) OVER f = 4 THEN avg(is_observed::INT) OVER f END, 6) AS observed FROM u3 WINDOW f AS (PARTITION BY symbol, trading_date, session, seg ORDER BY datetime ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""))
def _(spark, sf):
    d = FE.quality_features(regular(spark, sf), windows=(4,))
    return rounded(d.select("symbol", "datetime", F.col("f_quality_session_imputed_fraction_4").alias("imputed"), F.col("f_quality_session_observed_fraction_4").alias("observed")))


@query("W29_momentum", sql("rb", f"SELECT {K}round(CASE WHEN count(*) OVER v5 = 5 THEN avg(close) OVER v5 END, 6) AS sma_5, round(CASE WHEN count(*) OVER v20 = 20 THEN avg(close) OVER v20 END, 6) AS sma_20, round(close / nullif(lag(close) OVER w, 0) - 1, 6) AS pct_change FROM rb WINDOW w AS (PARTITION BY symbol ORDER BY datetime), v5 AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), v20 AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def _(spark, sf):
    return rounded(I.momentum(raw_bars(spark, sf)).select("symbol", "datetime", "sma_5", "sma_20", "pct_change"))


def weighted(value: str, a: str, seed: int = 1) -> str:
    """The recurrence at row a.rn as a weighted sum over rows b, seeded by a mean."""
    return f"sum(CASE WHEN b.rn <= {seed} THEN pow(1 - {a}, a.rn - {seed}) / {seed} ELSE {a} * pow(1 - {a}, a.rn - b.rn) END * b.{value})"


@query("W30_rsi_macd", sql("rb", f""", n0 AS (SELECT symbol, datetime, close, row_number() OVER w AS rn, close - lag(close) OVER w AS d FROM rb WINDOW w AS (PARTITION BY symbol ORDER BY datetime)),
 m0 AS (SELECT symbol, a.rn, {weighted("close", "2.0 / 13")} - {weighted("close", "2.0 / 27")} AS macd FROM n0 a JOIN n0 b USING (symbol) WHERE b.rn <= a.rn GROUP BY ALL),
 m1 AS (SELECT symbol, a.rn, {weighted("macd", "2.0 / 10")} AS signal FROM m0 a JOIN m0 b USING (symbol) WHERE b.rn <= a.rn AND a.rn >= 1 GROUP BY ALL),
 g0 AS (SELECT symbol, rn - 1 AS rn, greatest(d, 0) AS up, greatest(-d, 0) AS down FROM n0 WHERE rn > 1),
 g1 AS (SELECT symbol, a.rn + 1 AS rn, {weighted("up", "1.0 / 14", 14)} AS gain, {weighted("down", "1.0 / 14", 14)} AS loss FROM g0 a JOIN g0 b USING (symbol) WHERE b.rn <= a.rn AND a.rn >= 14 GROUP BY ALL)
 SELECT symbol, datetime, round(CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END, 5) AS rsi_14, round(macd, 5) AS macd, round(signal, 5) AS macd_signal, round(macd - signal, 5) AS macd_histogram FROM n0 JOIN m0 USING (symbol, rn) JOIN m1 USING (symbol, rn) LEFT JOIN g1 USING (symbol, rn)"""))
def _(spark, sf):
    return rounded(I.momentum(raw_bars(spark, sf)).select("symbol", "datetime", "rsi_14", "macd", "macd_signal", "macd_histogram"), 5)


DAYS = ", dd AS (SELECT symbol, trading_date, first(open ORDER BY datetime) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY datetime) AS close FROM ss GROUP BY 1, 2)"


def daily(spark, sf):
    return I.daily(with_windows(raw_bars(spark, sf)))


@query("W31_opening_range", sql("ss", ", o AS (SELECT symbol, trading_date, max(high) AS or_high, min(low) AS or_low FROM ss WHERE session = 'regular' AND datediff('minute', session_start, datetime) BETWEEN 0 AND 59 GROUP BY 1, 2) SELECT * FROM o"))
def _(spark, sf):
    return I.opening_range(with_windows(raw_bars(spark, sf)).where("session = 'regular'"), 60, "session_start")


@query("W31_acd_levels", sql("ss", DAYS + f""", o AS (SELECT symbol, trading_date, max(high) AS or_high, min(low) AS or_low FROM ss WHERE session = 'regular' AND datediff('minute', session_start, datetime) BETWEEN 0 AND 59 GROUP BY 1, 2),
 t0 AS (SELECT symbol, trading_date, high, low, lag(close) OVER w AS c, row_number() OVER w AS rn FROM dd WINDOW w AS (PARTITION BY symbol ORDER BY trading_date)),
 t1 AS (SELECT symbol, trading_date, rn, CASE WHEN c IS NULL THEN high - low ELSE greatest(high - low, abs(high - c), abs(low - c)) END AS tr FROM t0),
 t2 AS (SELECT symbol, a.rn + 1 AS rn, {weighted("tr", "1.0 / 5", 5)} AS prev_atr FROM t1 a JOIN t1 b USING (symbol) WHERE b.rn <= a.rn AND a.rn >= 5 GROUP BY ALL)
 SELECT symbol, trading_date, {r6("or_high or_low")}, round(prev_atr, 6) AS prev_atr, round(or_high + 0.1 * prev_atr, 6) AS a_up, round(or_low - 0.1 * prev_atr, 6) AS a_down, round(or_high + 0.15 * prev_atr, 6) AS c_up, round(or_low - 0.15 * prev_atr, 6) AS c_down FROM o LEFT JOIN t1 USING (symbol, trading_date) LEFT JOIN t2 USING (symbol, rn)"""))
def _(spark, sf):
    days = daily(spark, sf)
    ranges = I.opening_range(with_windows(raw_bars(spark, sf)).where("session = 'regular'"), 60, "session_start")
    return rounded(I.acd_levels(ranges, I.daily_atr(days, 5)))


@query("W32_pivots", sql("ss", DAYS + ", q AS (SELECT *, count(*) OVER p AS n, max(high) OVER p AS h, min(low) OVER p AS l, lag(close) OVER (PARTITION BY symbol ORDER BY trading_date) AS c FROM dd WINDOW p AS (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)), z AS (SELECT symbol, trading_date, CASE WHEN n = 3 THEN (h + l + c) / 3 END AS pv, CASE WHEN n = 3 THEN abs((h + l + c) / 3 - (h + l) / 2) END AS d FROM q) SELECT symbol, trading_date, round(pv, 6) AS \"pivot\", round(d, 6) AS pivot_distance, round(pv + d, 6) AS pivot_high, round(pv - d, 6) AS pivot_low FROM z"))
def _(spark, sf):
    return rounded(I.pivots(daily(spark, sf)).select("symbol", "trading_date", "pivot", "pivot_distance", "pivot_high", "pivot_low"))


@query("W33_bollinger", sql("rb", ", n0 AS (SELECT symbol, datetime, close, row_number() OVER w AS rn, 2 * stddev_pop(close) OVER (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) AS sd FROM rb WINDOW w AS (PARTITION BY symbol ORDER BY datetime)), " + ema_sql(36) + " SELECT symbol, datetime, round(m, 5) AS basis, round(m + sd, 5) AS upper, round(m - sd, 5) AS lower FROM n0 LEFT JOIN e36 USING (symbol, rn)"))
def _(spark, sf):
    return rounded(I.bollinger(raw_bars(spark, sf)).select("symbol", "datetime", "basis", "upper", "lower"), 5)


@query("W34_crosses", sql("ss", ", x AS (SELECT symbol, trading_date, datetime, coalesce(close > 60, false) AS above FROM ss), y AS (SELECT *, lag(above) OVER w AS p FROM x WINDOW w AS (PARTITION BY symbol, trading_date ORDER BY datetime)), z AS (SELECT *, sum(CASE WHEN above IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, trading_date ORDER BY datetime) AS run FROM y), v AS (SELECT *, CASE WHEN above THEN row_number() OVER (PARTITION BY symbol, trading_date, run ORDER BY datetime) ELSE 0 END::INT AS rows_above FROM z) SELECT symbol, datetime, coalesce(above AND NOT p, false)::INT AS cross_up, rows_above, (rows_above >= 3)::INT AS confirmed FROM v"))
def _(spark, sf):
    d = I.crosses(with_windows(raw_bars(spark, sf)), F.lit(60.0), ["symbol", "trading_date"], confirm=3)
    return d.select("symbol", "datetime", "cross_up", "rows_above", "confirmed")


@query("W35_location", sql("ss", ", x AS (SELECT symbol, trading_date, datetime, close, CASE WHEN close < 30 THEN -1 WHEN close > 70 THEN 1 WHEN close IS NOT NULL THEN 0 END AS loc FROM ss), y AS (SELECT *, lag(loc) OVER w AS p FROM x WINDOW w AS (PARTITION BY symbol, trading_date ORDER BY datetime)), z AS (SELECT *, coalesce(loc = 1 AND p < 1, false)::INT AS up, coalesce(loc = -1 AND p > -1, false)::INT AS dn, coalesce(loc = 0 AND p <> 0, false)::INT AS rej, sum(CASE WHEN loc IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, trading_date ORDER BY datetime) AS run FROM y) SELECT symbol, datetime, loc AS location, up AS leave_up, dn AS leave_down, rej AS rejection, sum(up + dn) OVER w::BIGINT AS leaves_today, sum(rej) OVER w::BIGINT AS rejections_today, row_number() OVER (PARTITION BY symbol, trading_date, run ORDER BY datetime)::INT AS streak, round(exp(-(row_number() OVER (PARTITION BY symbol, trading_date, run ORDER BY datetime) - 1) / 10.0), 6) AS streak_decay FROM z WINDOW w AS (PARTITION BY symbol, trading_date ORDER BY datetime)"))
def _(spark, sf):
    d = I.location_features(with_windows(raw_bars(spark, sf)), F.lit(30.0), F.lit(70.0), ["symbol", "trading_date"])
    return rounded(d.select("symbol", "datetime", "location", "leave_up", "leave_down", "rejection", "leaves_today", "rejections_today", "streak", "streak_decay"))


@query("W35_reliability", sql("ss", ", t AS (SELECT symbol, trading_date, count(CASE WHEN close > open THEN 1 END) AS hits, count(*) AS tries FROM ss GROUP BY 1, 2) SELECT symbol, trading_date, hits, tries, round((coalesce(sum(hits) OVER w, 0) + 1) / (coalesce(sum(tries) OVER w, 0) + 2), 6) AS reliability_10d FROM t WINDOW w AS (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"))
def _(spark, sf):
    d = with_windows(raw_bars(spark, sf)).groupBy("symbol", "trading_date").agg(F.count_if(F.col("close") > F.col("open")).alias("hits"), F.count("*").alias("tries"))
    return rounded(I.reliability(d, 10))


@query("W37_one_minute_features")
def _(spark, sf):
    from .queries_bars import gridded

    return rounded(FE.one_minute_features(with_windows(gridded(spark, sf)[2]), STEP).drop("session_start", "session_end"))


#: Distinct, as equal rows may come in another order in each window.
MERGE = """, iv AS (SELECT DISTINCT l_suppkey AS k, l_shipdate AS s, l_shipdate + INTERVAL 3 DAY AS e FROM lineitem),
 q AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
 g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + INTERVAL {gap} MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM q),
 m AS (SELECT k, min(s) AS start, max(e) AS "end" FROM g GROUP BY k, run)"""


def intervals(spark, sf, gap):
    li = table(spark, sf, "lineitem")
    return merge_intervals(li.select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("start"), (F.col("l_shipdate") + F.expr("interval 3 days")).alias("end")), ["k"], "start", "end", gap)


def interval_keys(m):
    each = m.select("k", F.timestamp_diff("MINUTE", "start", "end").alias("n"), F.size(F.sequence("start", "end", F.expr("interval 1 day"))).alias("d"))
    return each.groupBy("k").agg(F.sum(F.col("n") + 1).alias("minutes"), F.count("*").alias("n"), F.sum("d").alias("days"))


@query("E8_merge_touching", "WITH " + MERGE.format(gap=0)[2:] + ' SELECT k, start, "end" FROM m')
def _(spark, sf):
    return intervals(spark, sf, 0)


@query("E8_merge_adjacent", "WITH " + MERGE.format(gap=1440)[2:] + ' SELECT k, start, "end" FROM m')
def _(spark, sf):
    return intervals(spark, sf, 1440)


@query("E9_interval_keys", "WITH " + MERGE.format(gap=1440)[2:] + " SELECT k, sum(datediff('minute', start, \"end\") + 1)::BIGINT AS minutes, count(*) AS n, sum(len(generate_series(start, \"end\", INTERVAL 1 DAY)))::BIGINT AS days FROM m GROUP BY k")
def _(spark, sf):
    return interval_keys(intervals(spark, sf, 1440))


@query("W24_carried_close", sql("ss", GRID + ", c0 AS (SELECT symbol, session, volume = 0 AND bar_count = 0 AND datediff('minute', lag(datetime) OVER w, datetime) = 15 AND lag(session) OVER w = session AND lag(close) OVER w = close AS carried FROM reg WINDOW w AS (PARTITION BY symbol ORDER BY datetime)) SELECT symbol, session, count(CASE WHEN carried THEN 1 END) AS carried, count(*) AS n FROM c0 GROUP BY 1, 2"))
def _(spark, sf):
    from ..operators.quality import carried_close
    from .queries_bars import gridded

    reg = gridded(spark, sf)[2]
    return carried_close(reg, ["symbol"], STEP).groupBy("symbol", "session").agg(F.count_if("carried_close").alias("carried"), F.count("*").alias("n"))


@query("W26_reverse_purge", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r > 2")
def _(spark, sf):
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return table(spark, sf, "orders").withColumn("r", r).where("r > 2").select("o_orderkey", "o_custkey")


@query("O4_head_tail", "SELECT o_custkey, o_orderkey, CASE WHEN a <= 2 THEN 'head' ELSE 'tail' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS b FROM orders) WHERE a <= 2 OR b <= 2")
def _(spark, sf):
    w = Window.partitionBy("o_custkey")
    d = table(spark, sf, "orders").withColumns({"a": F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")), "b": F.row_number().over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))})
    return d.where("a <= 2 OR b <= 2").select("o_custkey", "o_orderkey", F.when(F.col("a") <= 2, "head").otherwise("tail").alias("part"))


@query("O3_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
