"""Bars, grids, filling, resampling, scalar functions, and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import bars as B
from ..operators.features import candle_features, merge_higher_timeframe, return_features, session_window, with_continuity
from ..operators.windows import islands, rolling
from .data import STEP, bars, r6, raw_bars, rounded, sql, table, with_windows
from .registry import query


def groups(df):
    """Sessions that occur, with window."""
    return df.select("symbol", "trading_date", "session", F.col("session_start").alias("start"), F.col("session_end").alias("end")).distinct()


GROUP = ["symbol", "trading_date", "session"]


def gridded(spark, sf):
    obs = with_windows(raw_bars(spark, sf))
    # bucketing is monotone, so the span comes from a scan of one column: one row
    at = lambda f: B.bucket_start(f("ts"), STEP)
    span = table(spark, sf, "events").agg(at(F.min).alias("lo"), at(F.max).alias("hi"))
    w = groups(obs).join(F.broadcast(span))
    g = B.expected_grid(w, STEP, F.col("lo"), F.col("hi"), GROUP)
    return obs, g, B.regularize(obs.drop("session_start", "session_end"), g, GROUP, STEP, most=2)


GRID = """, mm AS (SELECT min(datetime) AS lo, max(datetime) AS hi FROM ss),
 w AS (SELECT DISTINCT symbol, trading_date, session, greatest(session_start, lo) AS s, least(session_end, hi + INTERVAL 15 MINUTE) - INTERVAL 15 MINUTE AS e FROM ss, mm),
 grid AS (SELECT symbol, trading_date, session, unnest(generate_series(s, e, INTERVAL 15 MINUTE)) AS datetime FROM w WHERE e >= s),
 j AS (SELECT g.*, o.open, o.high, o.low, o.close, o.volume, o.bar_count, o.wap, o.symbol IS NOT NULL AS is_observed FROM grid g LEFT JOIN ss o USING (symbol, trading_date, session, datetime)),
 k AS (SELECT *, min(CASE WHEN is_observed THEN datetime END) OVER p AS f, max(CASE WHEN is_observed THEN datetime END) OVER p AS l, max(CASE WHEN is_observed THEN datetime END) OVER (PARTITION BY symbol, trading_date, session ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt,
   datetime - 15 * INTERVAL 1 MINUTE * row_number() OVER (PARTITION BY symbol, trading_date, session, is_observed ORDER BY datetime) AS isl FROM j WINDOW p AS (PARTITION BY symbol, trading_date, session)),
 t AS (SELECT *, CASE WHEN is_observed THEN NULL WHEN f IS NULL THEN 'full_session' WHEN datetime < f THEN 'leading' WHEN datetime > l THEN 'trailing' ELSE 'internal' END AS gap_type,
   CASE WHEN NOT is_observed THEN count(*) OVER (PARTITION BY symbol, trading_date, session, is_observed, isl) END AS gap_length FROM k),
 u AS (SELECT t.*, coalesce(gap_type = 'internal' AND gap_length <= 2 AND pt IS NOT NULL, false) AS is_imputed, pv.close AS pc FROM t LEFT JOIN ss pv ON pv.symbol = t.symbol AND pv.datetime = t.pt AND pv.session = t.session AND pv.trading_date = t.trading_date),
 reg AS (SELECT symbol, trading_date, session, datetime, is_observed, is_imputed, gap_type, gap_length, CASE WHEN is_imputed THEN pc ELSE open END AS open, CASE WHEN is_imputed THEN pc ELSE high END AS high, CASE WHEN is_imputed THEN pc ELSE low END AS low,
   CASE WHEN is_imputed THEN pc ELSE close END AS close, CASE WHEN is_imputed THEN pc ELSE wap END AS wap, CASE WHEN is_imputed THEN 0.0 ELSE volume END AS volume, CASE WHEN is_imputed THEN 0 ELSE bar_count END AS bar_count, CASE WHEN is_imputed THEN pt END AS imputation_source_datetime,
   CASE WHEN is_observed THEN 'observed' WHEN is_imputed THEN 'imputed_internal' WHEN gap_type = 'internal' THEN 'missing_internal_too_large' ELSE 'missing_' || gap_type END AS quality_status FROM u)"""


@query("A1_bars", sql("rb", f"SELECT symbol, datetime, open, high, low, close, bar_count, {r6('volume wap')} FROM rb"))
def _(spark, sf):
    return rounded(raw_bars(spark, sf))


@query("J10_clock_sessions", sql("ss", "SELECT symbol, datetime, session, trading_date, session_start, session_end FROM ss"))
def _(spark, sf):
    return with_windows(raw_bars(spark, sf)).select("symbol", "datetime", "session", "trading_date", "session_start", "session_end")


@query("S26_expected_grid", sql("ss", GRID + " SELECT symbol, trading_date, session, datetime FROM grid"))
def _(spark, sf):
    return gridded(spark, sf)[1].select(*GROUP, "datetime")


@query("J13_missing_bars", sql("ss", GRID + " SELECT symbol, trading_date, session, datetime FROM j WHERE NOT is_observed"))
def _(spark, sf):
    obs, g, _ = gridded(spark, sf)
    return g.join(obs.select(*GROUP, "datetime"), [*GROUP, "datetime"], "left_anti").select(*GROUP, "datetime")


@query("W17_causal_fill", sql("ss", GRID + f" SELECT symbol, trading_date, session, datetime, is_observed, is_imputed, gap_type, gap_length, quality_status, imputation_source_datetime, bar_count::BIGINT AS bar_count, {r6('open high low close wap volume')} FROM reg"))
def _(spark, sf):
    return rounded(gridded(spark, sf)[2].select(*GROUP, "datetime", "is_observed", "is_imputed", "gap_type", "gap_length", "quality_status", "imputation_source_datetime", "bar_count", "open", "high", "low", "close", "wap", "volume"))


@query("J12_grid_align", sql("ss", GRID + " SELECT session, count(*) AS n_grid, count(CASE WHEN is_observed THEN 1 END) AS n_observed FROM j GROUP BY 1"))
def _(spark, sf):
    return gridded(spark, sf)[2].groupBy("session").agg(F.count("*").alias("n_grid"), F.count_if("is_observed").alias("n_observed"))


@query("W16_gap_runs", sql("ss", GRID + " SELECT symbol, trading_date, session, min(datetime) AS run_start, max(datetime) AS run_end, count(*) AS run_length, gap_type, is_imputed FROM (SELECT reg.*, datetime - 15 * INTERVAL 1 MINUTE * row_number() OVER (PARTITION BY symbol, trading_date, session ORDER BY datetime) AS i FROM reg WHERE NOT is_observed) GROUP BY symbol, trading_date, session, i, gap_type, is_imputed"))
def _(spark, sf):
    return B.gap_audit(gridded(spark, sf)[2], GROUP, STEP)


@query("W16_islands", sql("ss", ", i AS (SELECT symbol, datetime, datetime - 15 * INTERVAL 1 MINUTE * row_number() OVER (PARTITION BY symbol ORDER BY datetime) AS a FROM ss) SELECT symbol, min(datetime) AS run_start, max(datetime) AS run_end, count(*) AS run_length FROM i GROUP BY symbol, a"))
def _(spark, sf):
    return islands(raw_bars(spark, sf), ["symbol"], "datetime", STEP)


@query("A11_regularization_summary", sql("ss", GRID + " SELECT session, quality_status, count(*) AS n_rows, count(DISTINCT trading_date) AS dates FROM reg GROUP BY 1, 2"))
def _(spark, sf):
    return gridded(spark, sf)[2].groupBy("session", "quality_status").agg(F.count("*").alias("n_rows"), F.count_distinct("trading_date").alias("dates"))


@query("A34_gap_totals", sql("ss", GRID + " SELECT gap_type, count(*) AS missing_bars, count(*) * 15 AS missing_minutes FROM reg WHERE NOT is_observed GROUP BY 1"))
def _(spark, sf):
    return gridded(spark, sf)[2].where(~F.col("is_observed")).groupBy("gap_type").agg(F.count("*").alias("missing_bars"), (F.count("*") * STEP).alias("missing_minutes"))


@query("V6_observed_conserved", sql("ss", GRID + " SELECT (SELECT count(*) FROM ss) AS n_in, (SELECT count(*) FROM reg WHERE is_observed) AS n_out, CASE WHEN (SELECT count(*) FROM ss) = (SELECT count(*) FROM reg WHERE is_observed) THEN 1 ELSE 0 END AS conserved"))
def _(spark, sf):
    obs, _, reg = gridded(spark, sf)
    return B.observed_conserved(obs, reg)


@query("A6_coverage", sql("ss", GRID + " SELECT trading_date, session, count(*) AS expected, count(CASE WHEN is_observed THEN 1 END) AS actual, min(datetime) AS first_expected, max(datetime) AS last_expected, count(*) - count(CASE WHEN is_observed THEN 1 END) AS missing, round(count(CASE WHEN is_observed THEN 1 END) / count(*) * 100, 6) AS coverage_percent FROM j GROUP BY 1, 2"))
def _(spark, sf):
    obs, g, _ = gridded(spark, sf)
    return B.coverage(g, obs, ["symbol"], "datetime", ["trading_date", "session"])


@query("A7_session_coverage", sql("ss", GRID + " SELECT session, sum(e)::BIGINT AS expected, sum(a)::BIGINT AS actual, count(DISTINCT trading_date) AS dates FROM (SELECT trading_date, session, count(*) AS e, count(CASE WHEN is_observed THEN 1 END) AS a FROM j GROUP BY 1, 2) GROUP BY 1"))
def _(spark, sf):
    obs, g, _ = gridded(spark, sf)
    daily = B.coverage(g, obs, ["symbol"], "datetime", ["trading_date", "session"])
    return daily.groupBy("session").agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual"), F.count_distinct("trading_date").alias("dates"))


def resampled(spark, sf, minutes=60):
    _, _, reg = gridded(spark, sf)
    return B.resample(with_windows(reg), minutes, STEP, GROUP)


HOURS = GRID + """, rs AS (SELECT reg.*, CASE session WHEN 'overnight' THEN trading_date::TIMESTAMP - INTERVAL 240 MINUTE WHEN 'premarket' THEN trading_date::TIMESTAMP + INTERVAL 240 MINUTE WHEN 'regular' THEN trading_date::TIMESTAMP + INTERVAL 570 MINUTE ELSE trading_date::TIMESTAMP + INTERVAL 960 MINUTE END AS a,
   CASE session WHEN 'overnight' THEN trading_date::TIMESTAMP + INTERVAL 240 MINUTE WHEN 'premarket' THEN trading_date::TIMESTAMP + INTERVAL 570 MINUTE WHEN 'regular' THEN trading_date::TIMESTAMP + INTERVAL 960 MINUTE ELSE trading_date::TIMESTAMP + INTERVAL 1200 MINUTE END AS z FROM reg),
 hb AS (SELECT symbol, trading_date, session, z, a + INTERVAL 60 MINUTE * (datediff('minute', a, datetime) // 60) AS h, first(open ORDER BY datetime) FILTER (open IS NOT NULL AND close IS NOT NULL) AS open, max(high) FILTER (close IS NOT NULL) AS high, min(low) FILTER (close IS NOT NULL) AS low, last(close ORDER BY datetime) FILTER (close IS NOT NULL) AS close,
   (sum(volume::DECIMAL(28,6)) FILTER (close IS NOT NULL))::DOUBLE AS volume, (sum(bar_count) FILTER (close IS NOT NULL))::BIGINT AS bar_count, coalesce(coalesce(sum(wap * volume) FILTER (volume > 0 AND close IS NOT NULL), 0) / sum(volume) FILTER (volume > 0 AND close IS NOT NULL), last(wap ORDER BY datetime) FILTER (wap IS NOT NULL AND close IS NOT NULL)) AS wap,
   count(*) * 15 AS source_grid_minutes, count(CASE WHEN is_observed THEN 1 END) * 15 AS observed_minutes, count(CASE WHEN is_imputed THEN 1 END) * 15 AS imputed_minutes FROM rs GROUP BY ALL),
 hc AS (SELECT * EXCLUDE (z, h), h AS datetime, least(h + INTERVAL 60 MINUTE, z) AS bar_end FROM hb),
 hd AS (SELECT *, datediff('minute', datetime, bar_end) AS expected_minutes, greatest(datediff('minute', datetime, bar_end) - observed_minutes - imputed_minutes, 0) AS missing_minutes FROM hc),
 h60 AS (SELECT *, source_grid_minutes = expected_minutes AND missing_minutes = 0 AS is_complete, imputed_minutes > 0 AS has_imputation, CASE WHEN NOT (source_grid_minutes = expected_minutes AND missing_minutes = 0) THEN 'incomplete' WHEN imputed_minutes > 0 THEN 'complete_with_imputation' ELSE 'complete_observed' END AS quality_status FROM hd)"""


@query("A4_resample", sql("ss", HOURS + f" SELECT symbol, trading_date, session, datetime, bar_end, bar_end AS available_at, bar_count, source_grid_minutes, observed_minutes, imputed_minutes, expected_minutes, missing_minutes, is_complete, has_imputation, quality_status, open, high, low, close, round(volume, 9) AS volume, round(wap, 9) AS wap FROM h60"))
def _(spark, sf):
    return rounded(resampled(spark, sf), 9)


@query("A12_quality_counts", sql("ss", HOURS + " SELECT quality_status, is_complete, has_imputation, count(*) AS n FROM h60 GROUP BY ALL"))
def _(spark, sf):
    return resampled(spark, sf).groupBy("quality_status", "is_complete", "has_imputation").agg(F.count("*").alias("n"))


def base_features(spark, sf):
    d = return_features(candle_features(with_continuity(bars(spark, sf), STEP)))
    return d.withColumn("volatility_5", rolling(F.col("f_1m_log_return_1"), session_window(), 5, "std")).withColumn("prediction_time", F.timestamp_add("MINUTE", F.lit(STEP), F.col("datetime")))


CONTEXT = HOURS + """, ctx AS (SELECT symbol, bar_end AS available_at, close AS cclose, trading_date AS cdate, session AS csession, wap AS cwap FROM h60 WHERE is_complete AND close IS NOT NULL),
 base AS (SELECT *, datetime + INTERVAL 15 MINUTE AS prediction_time, CASE WHEN count(r1) OVER v = 5 THEN stddev_pop(r1) OVER v END AS volatility_5 FROM rr WINDOW v AS (PARTITION BY symbol, trading_date, session, segment_id ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
 aj AS (SELECT base.*, available_at, cclose, cdate, csession, cwap, datediff('minute', available_at, prediction_time)::DOUBLE AS age_minutes, (close - cclose) / nullif(cclose, 0) * 10000 AS anchor_bps FROM base ASOF LEFT JOIN ctx ON base.symbol = ctx.symbol AND base.prediction_time >= ctx.available_at)"""


@query("J1_asof_context", sql("ss rr", CONTEXT + f" SELECT symbol, datetime, prediction_time, available_at AS ctx_1h_available_at, {r6('age_minutes anchor_bps cwap')}, CASE WHEN cdate = trading_date THEN 1 ELSE 0 END AS same_date, CASE WHEN cdate = trading_date AND csession = session THEN 1 ELSE 0 END AS same_session FROM aj"))
def _(spark, sf):
    h = resampled(spark, sf).where(F.col("is_complete") & F.col("close").isNotNull()).withColumnRenamed("wap", "cwap")
    d = merge_higher_timeframe(base_features(spark, sf), h, "1h", ["cwap"])
    return rounded(d.select("symbol", "datetime", "prediction_time", "ctx_1h_available_at", F.col("f_1h_age_minutes").alias("age_minutes"), F.col("f_1h_close_anchor_bps").alias("anchor_bps"), "cwap", F.col("f_1h_same_trading_date").alias("same_date"), F.col("f_1h_same_session").alias("same_session")))


@query("V7_leakage", sql("ss rr", CONTEXT + " SELECT count(CASE WHEN available_at > prediction_time THEN 1 END) AS leaks, count(*) AS n_rows FROM aj"))
def _(spark, sf):
    from ..operators.features import leaks

    h = resampled(spark, sf).where(F.col("is_complete") & F.col("close").isNotNull())
    return leaks(merge_higher_timeframe(base_features(spark, sf), h, "1h", []), "ctx_1h_available_at", "prediction_time")


@query("flagship", sql("ss rr", CONTEXT + f", g AS (SELECT symbol, datetime, gap_type, is_imputed FROM reg) SELECT g.symbol, g.datetime, g.gap_type, g.is_imputed, round(aj.close, 6) AS close, round(aj.r1, 6) AS log_return_1, {r6('volatility_5 anchor_bps age_minutes')} FROM g LEFT JOIN aj ON g.symbol = aj.symbol AND g.datetime = aj.datetime"))
def flagship(spark, sf):
    """Events to bars, grid and causal fill, returns and volatility, as-of hour."""
    _, _, reg = gridded(spark, sf)
    h = B.resample(with_windows(reg), 60, STEP, GROUP).where(F.col("is_complete") & F.col("close").isNotNull())
    d = merge_higher_timeframe(base_features(spark, sf), h, "1h", [])
    d = d.select("symbol", "datetime", "close", F.col("f_1m_log_return_1").alias("log_return_1"), "volatility_5", F.col("f_1h_close_anchor_bps").alias("anchor_bps"), F.col("f_1h_age_minutes").alias("age_minutes"))
    return rounded(reg.select("symbol", "datetime", "gap_type", "is_imputed").join(d, ["symbol", "datetime"], "left"))


RATIO0 = "CASE WHEN ({n}) = 0 AND ({d}) = 0 THEN 0.0 ELSE ({n}) / nullif({d}, 0) END"


@query("F4_candle", sql("sb", "SELECT symbol, datetime, round((close - open) / nullif(open, 0) * 10000, 6) AS body_bps, round((high - low) / nullif(close, 0) * 10000, 6) AS range_bps, round(" + RATIO0.format(n="high - CASE WHEN open IS NULL THEN close WHEN close IS NULL THEN open ELSE greatest(open, close) END", d="high - low") + ", 6) AS upper_shadow_fraction, round(" + RATIO0.format(n="CASE WHEN close IS NULL THEN open ELSE least(open, close) END - low", d="high - low") + ", 6) AS lower_shadow_fraction, round(" + RATIO0.format(n="abs(close - open)", d="high - low") + ", 6) AS body_to_range, coalesce(close > open, false)::INT AS bullish, coalesce(open = high AND open = low AND open = close, false)::INT AS flat_candle, coalesce(open = high AND open = low AND open = close AND volume = 0, false)::INT AS inactive_flat_candle, coalesce(open = high AND open = low AND open = close AND volume > 0, false)::INT AS strange_flat_candle, round((close - wap) / nullif(wap, 0) * 10000, 6) AS close_wap_bps FROM sb"))
def _(spark, sf):
    c = X.candle(*(F.col(x) for x in ("open", "high", "low", "close", "volume", "wap")))
    return rounded(bars(spark, sf).select("symbol", "datetime", *[v.alias(k) for k, v in c.items()]))


@query("F1_F3_ratios", "SELECT l_orderkey, l_linenumber, round(l_tax / nullif(l_discount, 0), 6) AS ratio, round(CASE WHEN l_tax = 0 AND l_discount = 0 THEN 0.0 ELSE l_tax / nullif(l_discount, 0) END, 6) AS ratio_zero, round(l_tax / nullif(l_discount, 0) * 10000, 6) AS bps FROM lineitem")
def _(spark, sf):
    t, d = F.col("l_tax"), F.col("l_discount")
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.safe_ratio(t, d).alias("ratio"), X.safe_ratio_zero(t, d).alias("ratio_zero"), X.safe_bps(t, d).alias("bps")))


@query("F5_math", "SELECT o_orderkey, round(CASE WHEN x > 0 THEN ln(x) END, 6) AS ln_x, round(ln(1 + greatest(x, 0)), 6) AS log1p_x, round(abs(x), 6) AS abs_x, floor(x)::BIGINT AS floor_x, round(sqrt(abs(x)), 6) AS sqrt_x, round(exp(x / 500000), 6) AS exp_x, round(least(greatest(x, 0), 100000), 6) AS clip_x FROM (SELECT o_orderkey, o_totalprice - 200000 AS x FROM orders)")
def _(spark, sf):
    x = F.col("o_totalprice") - 200000
    return rounded(table(spark, sf, "orders").select("o_orderkey", X.log_positive(x).alias("ln_x"), X.log1p_clipped(x).alias("log1p_x"), F.abs(x).alias("abs_x"), F.floor(x).alias("floor_x"), F.sqrt(F.abs(x)).alias("sqrt_x"), F.exp(x / 500000).alias("exp_x"), F.least(F.greatest(x, F.lit(0.0)), F.lit(100000.0)).alias("clip_x")))


@query("F6_cyclic_time", sql("rb", "SELECT symbol, datetime, round(sin(m * 2 * pi() / 1440), 6) + 0.0 AS minute_sin, round(cos(m * 2 * pi() / 1440), 6) + 0.0 AS minute_cos, round(sin(d * 2 * pi() / 5), 6) + 0.0 AS dow_sin, round(cos(d * 2 * pi() / 5), 6) + 0.0 AS dow_cos FROM (SELECT *, hour(datetime) * 60 + minute(datetime) AS m, isodow(datetime) - 1 AS d FROM rb)"))
def _(spark, sf):
    return rounded(raw_bars(spark, sf).select("symbol", "datetime", *[v.alias(k) for k, v in X.cyclic_time(F.col("datetime"), F.to_date("datetime")).items()]))


@query("F7_session_position", sql("ss", "SELECT symbol, datetime, e AS f_session_elapsed_minutes, w - e AS f_session_remaining_minutes, round(e / w, 6) AS f_session_progress, (session = 'premarket')::INT AS pre, (session = 'regular')::INT AS reg, (session = 'aftermarket')::INT AS aft, (session = 'overnight')::INT AS ovn FROM (SELECT *, datediff('minute', session_start, datetime + INTERVAL 15 MINUTE)::DOUBLE AS e, datediff('minute', session_start, session_end)::DOUBLE AS w FROM ss)"))
def _(spark, sf):
    from ..operators.features import session_features

    d = session_features(with_windows(raw_bars(spark, sf)), "session_start", "session_end", STEP)
    return rounded(d.select("symbol", "datetime", "f_session_elapsed_minutes", "f_session_remaining_minutes", "f_session_progress", F.col("f_session_is_premarket").alias("pre"), F.col("f_session_is_regular").alias("reg"), F.col("f_session_is_aftermarket").alias("aft"), F.col("f_session_is_overnight").alias("ovn")))


@query("F9_F10_dates", "SELECT o_orderkey, (o_orderdate::DATE - 10)::DATE AS d10, (o_orderdate::DATE - 14)::DATE AS w2, (o_orderdate::DATE - INTERVAL 6 MONTH)::DATE AS m6, (o_orderdate::DATE - INTERVAL 1 YEAR)::DATE AS y1, strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m FROM orders")
def _(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", X.duration_start(d, "10 D").alias("d10"), X.duration_start(d, "2 W").alias("w2"), X.duration_start(d, "6 M").alias("m6"), X.duration_start(d, "1 Y").alias("y1"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))


@query("F13_time_block", sql("ss", "SELECT symbol, datetime, CASE WHEN m < 630 THEN '09:30-10:30' WHEN m < 690 THEN '10:30-11:30' WHEN m < 750 THEN '11:30-12:30' WHEN m < 810 THEN '12:30-13:30' WHEN m < 870 THEN '13:30-14:30' ELSE '14:30-15:45' END AS block FROM (SELECT *, hour(datetime) * 60 + minute(datetime) AS m FROM ss WHERE session = 'regular')"))
def _(spark, sf):
    d = with_windows(raw_bars(spark, sf)).where("session = 'regular'")
    return d.select("symbol", "datetime", X.time_block(X.minute_of_day(F.col("datetime"))).alias("block"))


@query("F14_strings", "SELECT c_custkey, lower(trim(c_mktsegment)) AS key, regexp_replace(lower(c_name), '[^a-z0-9._-]+', '_', 'g') AS safe, list_filter(list_transform(string_split_regex(c_mktsegment || '| x;Y ,,z', '[|,;]'), lambda s: lower(trim(s))), lambda s: s <> '')[2] AS second FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.norm_key(F.col("c_mktsegment")).alias("key"), X.safe_name(F.col("c_name")).alias("safe"), X.split_list(F.concat("c_mktsegment", F.lit("| x;Y ,,z")))[1].alias("second"))


@query("F14_timeframes", "SELECT minutes, name, back FROM (VALUES (15, '15m', 15), (30, '30m', 30), (60, '1h', 60), (240, '240m', 240)) t(minutes, name, back)")
def _(spark, sf):
    d = spark.range(1).select(F.explode(F.array(F.lit("15m"), F.lit("30 min"), F.lit("1H"), F.lit("4h"))).alias("t")).select(X.timeframe_minutes(F.col("t")).alias("minutes"))
    d = d.withColumn("name", X.timeframe_name(F.col("minutes")))
    return d.withColumn("back", X.timeframe_minutes(F.col("name")))


@query("F15_hash", "SELECT o_orderkey, sha256(o_orderpriority || '|' || o_orderkey) AS digest FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", "o_orderpriority", F.col("o_orderkey").cast("string")), 256).alias("digest"))


@query("F16_json", "SELECT event_id, (props->>'k')::BIGINT AS k, props->>'none' AS nothing FROM events")
def _(spark, sf):
    m = F.from_json("props", "k long, none string")
    return table(spark, sf, "events").select("event_id", m.k.alias("k"), m.none.alias("nothing"))


@query("F19_softmax", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp((l_discount - l_tax) * 100)), 6) AS p_up FROM lineitem")
def _(spark, sf):
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.softmax_up(F.col("l_discount") * 100, F.col("l_tax") * 100).alias("p_up")))


@query("F23_position_size", "SELECT l_orderkey, l_linenumber, least(trunc(100 * abs(l_discount - 0.05) / 0.005)::INT, 1000) AS size FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.position_size(F.col("l_discount") - 0.05).alias("size"))


@query("P3_strict_bool", "SELECT o_orderkey, (o_orderkey % 2 = 0) AS flag FROM orders")
def _(spark, sf):
    word = F.when(F.col("o_orderkey") % 2 == 0, F.lit(" Yes ")).otherwise(F.lit("0"))
    return table(spark, sf, "orders").select("o_orderkey", X.strict_bool(word, "flag").alias("flag"))


@query("P4_numeric", "SELECT c_custkey, try_cast(CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE c_acctbal::VARCHAR END AS DOUBLE) AS value FROM customer")
def _(spark, sf):
    text = F.when(F.col("c_custkey") % 3 == 0, F.lit("x")).otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", X.to_double(text).alias("value"))


@query("P16_availability_gate", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0.0 END AS price, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE 'unavailable' END AS priority FROM orders")
def _(spark, sf):
    ok = F.col("o_orderstatus") == "O"
    return table(spark, sf, "orders").select("o_orderkey", X.availability_gate(ok, F.col("o_totalprice"), 0.0).alias("price"), X.availability_gate(ok, F.col("o_orderpriority"), "unavailable").alias("priority"))


@query("F17_one_hot", "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS s_F, (o_orderstatus = 'O')::INT AS s_O, 0 AS s_unavailable, (o_orderstatus NOT IN ('F', 'O'))::INT AS s_unseen FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *[v.alias(k) for k, v in X.one_hot(F.col("o_orderstatus"), "s", ["F", "O"]).items()])
