"""Targets, sequences, splits, matrices and labels."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import metrics as M
from ..operators import targets as T
from ..operators.windows import ordered
from .data import STEP, returns, rounded, segmented, sql, table
from .queries_windows import ATR
from .registry import query


def target(h):
    """Target rows in SQL; the same rules, by lead."""
    return f""", t0 AS (SELECT *, lead(datetime, {h}) OVER w AS ft, coalesce(lead(is_usable, {h}) OVER w, false) AS fu, lead(close, {h}) OVER w AS fc, lead(contiguous_history, {h}) OVER w AS fh, lead(session, {h}) OVER w AS fs, lead(trading_date, {h}) OVER w AS fd FROM cb WINDOW w AS (PARTITION BY symbol ORDER BY datetime)),
 t1 AS (SELECT *, CASE WHEN NOT is_usable THEN 'current_unusable' WHEN ft IS NULL OR datediff('minute', datetime, ft) <> {h * 15} THEN 'future_not_exact_horizon' WHEN NOT fu THEN 'future_unusable' WHEN fh < {h} + 1 THEN 'continuity_break' WHEN coalesce(close <= 0, true) THEN 'invalid_current_close' WHEN coalesce(fc <= 0, true) THEN 'invalid_future_close' ELSE 'valid' END AS reason, coalesce(fs = session AND fd = trading_date, false) AS same FROM t0),
 tt AS (SELECT *, reason = 'valid' AS valid, CASE WHEN reason = 'valid' THEN (fc / close - 1) * 10000 END AS bps, CASE WHEN reason = 'valid' THEN ft + INTERVAL 15 MINUTE END AS realized, datetime + INTERVAL 15 MINUTE AS prediction_time FROM t1)"""


def targets(spark, sf, h=2):
    d = T.add_target(segmented(spark, sf), h, STEP, threshold=500.0)
    return d.withColumn("prediction_time", F.timestamp_add("MINUTE", F.lit(STEP), F.col("datetime")))


@query("W18_target", sql("cb", target(2) + " SELECT symbol, datetime, reason AS target_invalid_reason_2m, valid AS target_valid_2m, realized AS target_realized_at_2m, CASE WHEN valid THEN fc END AS target_close_2m, round(CASE WHEN valid THEN fc / close - 1 END, 6) AS target_simple_return_2m, round(CASE WHEN valid THEN ln(fc / close) END, 6) AS target_log_return_2m, round(bps, 4) AS target_return_bps_2m, same AS target_same_session_2m FROM tt"))
def _(spark, sf):
    d = targets(spark, sf).select("symbol", "datetime", *[f"target_{c}_2m" for c in ("invalid_reason", "valid", "realized_at", "close", "simple_return", "log_return", "return_bps", "same_session")])
    return rounded(d.withColumn("target_return_bps_2m", F.round("target_return_bps_2m", 4)))


@query("W19_direction", sql("cb", target(2) + " SELECT symbol, datetime, CASE WHEN bps > 500 THEN 1 WHEN bps < -500 THEN -1 WHEN bps IS NOT NULL THEN 0 END AS target_direction_2m FROM tt"))
def _(spark, sf):
    return targets(spark, sf).select("symbol", "datetime", "target_direction_2m")


@query("W18_same_session", sql("cb", target(4) + " SELECT CASE WHEN reason = 'valid' AND NOT same THEN 'crosses_session' ELSE reason END AS reason, count(*) AS n FROM tt GROUP BY 1"))
def _(spark, sf):
    d = T.add_target(segmented(spark, sf), 4, STEP, same_session=True)
    return d.groupBy(F.col("target_invalid_reason_4m").alias("reason")).agg(F.count("*").alias("n"))


@query("A13_target_summary", sql("cb", target(2) + " SELECT count(*) AS n_rows, count(bps) AS n_valid, count(CASE WHEN bps > 500 THEN 1 END) AS up, count(CASE WHEN bps < -500 THEN 1 END) AS down, round(avg(bps), 3) AS mean, round(stddev_pop(bps), 3) AS std, round(median(bps), 3) AS median, round(quantile_cont(bps, 0.01), 3) AS p01, round(quantile_cont(bps, 0.99), 3) AS p99 FROM tt"))
def _(spark, sf):
    x = F.col("target_return_bps_2m")
    return rounded(targets(spark, sf).agg(F.count("*").alias("n_rows"), F.count(x).alias("n_valid"), F.count_if(x > 500).alias("up"), F.count_if(x < -500).alias("down"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.percentile(x, F.lit(0.5)).alias("median"), F.percentile(x, F.lit(0.01)).alias("p01"), F.percentile(x, F.lit(0.99)).alias("p99")), 3)


SCOPE = """, s0 AS (SELECT *, is_usable AND session IN ('premarket', 'regular') AS ok FROM tt),
 s1 AS (SELECT *, CASE WHEN NOT ok OR NOT coalesce(lag(ok) OVER w, false) OR contiguous_history <= 1 THEN 1 ELSE 0 END AS b FROM s0 WINDOW w AS (PARTITION BY symbol ORDER BY datetime)),
 s2 AS (SELECT *, sum(b) OVER (PARTITION BY symbol ORDER BY datetime) AS run FROM s1),
 sh AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY symbol, run ORDER BY datetime) ELSE 0 END::INT AS scope_history FROM s2)"""


def scoped(spark, sf):
    return T.scope_history(targets(spark, sf), ("premarket", "regular"))


@query("W20_scope_history", sql("cb", target(2) + SCOPE + " SELECT symbol, datetime, scope_history FROM sh"))
def _(spark, sf):
    return scoped(spark, sf).select("symbol", "datetime", "scope_history")


ELIGIBLE = SCOPE + ", el AS (SELECT *, datetime - INTERVAL 30 MINUTE AS window_start FROM sh WHERE is_usable AND contiguous_history >= 3 AND scope_history >= 3 AND (scope_history - 3) % 2 = 0 AND valid)"


def sequences(spark, sf):
    d = scoped(spark, sf).where(T.window_eligible(3, 2) & F.col("target_valid_2m"))
    return d.withColumn("window_start", F.timestamp_add("MINUTE", F.lit(-2 * STEP), F.col("datetime")))


@query("W21_sequences", sql("cb", target(2) + ELIGIBLE + " SELECT symbol, window_start, datetime, prediction_time FROM el"))
def _(spark, sf):
    return sequences(spark, sf).select("symbol", "window_start", "datetime", "prediction_time")


PLAN = ELIGIBLE + """, dy AS (SELECT trading_date, row_number() OVER (ORDER BY trading_date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT trading_date FROM el)),
 pl AS (SELECT trading_date, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM dy),
 sp AS (SELECT el.*, split FROM el JOIN pl USING (trading_date)), cu AS (SELECT split, max(prediction_time) AS cut FROM sp GROUP BY 1), pg AS (SELECT sp.* FROM sp JOIN cu USING (split) WHERE split = 'test' OR realized <= cut)"""


def split_rows(spark, sf):
    d = sequences(spark, sf)
    return T.assign_split(d, T.split_plan(d))


@query("F21_split_plan", sql("cb", target(2) + PLAN + " SELECT trading_date, split FROM pl"))
def _(spark, sf):
    return T.split_plan(sequences(spark, sf))


@query("F22_purge", sql("cb", target(2) + PLAN + " SELECT symbol, datetime, split FROM pg"))
def _(spark, sf):
    return T.purge(split_rows(spark, sf), "target_realized_at_2m").select("symbol", "datetime", "split")


@query("F22_embargo", sql("cb", target(2) + PLAN + " SELECT split, count(*) AS n FROM sp WHERE split <> 'train' OR realized < (SELECT min(prediction_time) FROM sp WHERE split = 'validation') GROUP BY 1"))
def _(spark, sf):
    return T.embargo(split_rows(spark, sf), "target_realized_at_2m").groupBy("split").agg(F.count("*").alias("n"))


@query("A18_cutoffs", sql("cb", target(2) + PLAN + " SELECT trading_date, max(prediction_time) AS cutoff, count(*) AS n FROM sp GROUP BY 1"))
def _(spark, sf):
    return split_rows(spark, sf).groupBy("trading_date").agg(F.max("prediction_time").alias("cutoff"), F.count("*").alias("n"))


@query("A37_structural_counts", sql("cb", target(2) + SCOPE + " SELECT month(datetime)::INT AS month, count(*) AS n_rows, count(CASE WHEN is_usable THEN 1 END) AS usable, count(CASE WHEN is_usable AND contiguous_history >= 3 AND scope_history >= 3 THEN 1 END) AS eligible, count(CASE WHEN is_usable AND contiguous_history >= 3 AND scope_history >= 3 AND (scope_history - 3) % 2 <> 0 THEN 1 END) AS stride_rejected FROM sh GROUP BY 1"))
def _(spark, sf):
    e, s = T.window_eligible(3, 1), T.window_eligible(3, 2)
    return scoped(spark, sf).groupBy(F.month("datetime").alias("month")).agg(F.count("*").alias("n_rows"), F.count_if("is_usable").alias("usable"), F.count_if(e).alias("eligible"), F.count_if(e & ~s).alias("stride_rejected"))


@query("W25_dense_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_custkey, o_orderkey) - 1 AS sample_index FROM orders")
def _(spark, sf):
    return T.dense_index(table(spark, sf, "orders"), ["o_orderdate", "o_custkey", "o_orderkey"]).select("o_orderkey", "sample_index")


@query("P10_W22_window_finite", sql("rr", "SELECT symbol, datetime, CASE WHEN count(*) OVER w = 4 THEN count(r1) OVER w = 4 ELSE false END AS window_finite FROM rr WINDOW w AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"))
def _(spark, sf):
    return T.window_finite(returns(spark, sf), ["f_1m_log_return_1"], 4).select("symbol", "datetime", "window_finite")


@query("A17_scaler", sql("rr", ", f AS (SELECT * FROM rr WHERE trading_date <= DATE '2024-01-20' AND r1 IS NOT NULL) SELECT 'r1' AS feature, round(avg(r1), 6) AS mean, round(stddev_pop(r1), 6) AS scale, false AS constant FROM f UNION ALL SELECT 'volume', round(avg(volume), 6), round(stddev_pop(volume), 6), false FROM f UNION ALL SELECT 'one', 1.0, 1.0, true"))
def _(spark, sf):
    d = returns(spark, sf).select(F.col("f_1m_log_return_1").alias("r1"), "volume", F.lit(1.0).alias("one"), "trading_date").where("trading_date <= DATE '2024-01-20' AND r1 IS NOT NULL")
    return rounded(M.scaler(d, ["r1", "volume", "one"]))


@query("F18_scaled", sql("rr", ", f AS (SELECT * FROM rr WHERE trading_date <= DATE '2024-01-20' AND r1 IS NOT NULL), m AS (SELECT avg(r1) AS a, stddev_pop(r1) AS b, avg(volume) AS c, stddev_pop(volume) AS d FROM f) SELECT symbol, datetime, round((r1 - a) / b, 6) AS r1, round((volume - c) / d, 6) AS volume FROM rr, m"))
def _(spark, sf):
    d = returns(spark, sf).select("symbol", "datetime", F.col("f_1m_log_return_1").alias("r1"), "volume", "trading_date")
    fit = M.scaler(d.where("trading_date <= DATE '2024-01-20' AND r1 IS NOT NULL"), ["r1", "volume"])
    return rounded(M.scaled(d, fit, ["r1", "volume"]).drop("trading_date"))


@query("F20_atr_label", sql("cb", ATR + ", lb AS (SELECT symbol, datetime, close, atr_3, lead(close) OVER (PARTITION BY symbol ORDER BY datetime) / close - 1 AS r FROM atr_t) SELECT symbol, datetime, round(0.75 * atr_3 / close, 5) AS threshold, CASE WHEN r < -0.75 * atr_3 / close THEN -1 WHEN r > 0.75 * atr_3 / close THEN 1 WHEN r IS NOT NULL AND atr_3 IS NOT NULL THEN 0 END AS label FROM lb"))
def _(spark, sf):
    d = T.wilder_atr(segmented(spark, sf), 3, STEP)
    d = d.withColumn("r", F.lead("close").over(ordered(["symbol"], "datetime")) / F.col("close") - 1)
    return T.labelled(d, "r", "atr_3").select("symbol", "datetime", F.round("threshold", 5).alias("threshold"), "label")


@query("P13_even_sample", sql("pp", ", n AS (SELECT *, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY grp) AS c FROM pp WINDOW w AS (PARTITION BY grp ORDER BY l_orderkey, l_linenumber)), i AS (SELECT DISTINCT grp, (k * (c - 1)) // 99 AS r FROM n, range(100) t(k)) SELECT n.l_orderkey, n.l_linenumber, grp FROM n JOIN i USING (grp, r)"))
def _(spark, sf):
    from .data import one_sided

    return T.even_sample(one_sided(spark, sf), 100, ["l_orderkey", "l_linenumber"], ["grp"]).select("l_orderkey", "l_linenumber", "grp")


@query("P14_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey::VARCHAR || '|7'), o_orderkey LIMIT 500")
def _(spark, sf):
    return table(spark, sf, "orders").orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit("|7"))), "o_orderkey").limit(500).select("o_orderkey", "o_totalprice")


@query("W27_tabular", sql("ss", "SELECT symbol, datetime, lag(close, 1) OVER w AS close_lag1, lag(close, 3) OVER w AS close_lag3, round(CASE WHEN count(close) OVER f = 5 THEN avg(close) OVER f END, 6) AS close_mean, round(CASE WHEN count(close) OVER f = 5 THEN stddev_pop(close) OVER f END, 6) AS close_std FROM ss WINDOW w AS (PARTITION BY symbol ORDER BY datetime), f AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"))
def _(spark, sf):
    from .data import raw_bars

    return rounded(T.tabular_features(raw_bars(spark, sf).select("symbol", "datetime", "close"), ["close"], 5, (1, 3)).drop("close"))


@query("W27_windows", sql("ss", "SELECT symbol, datetime, len(x) AS n, round(list_sum(x), 6) AS total FROM (SELECT symbol, datetime, CASE WHEN count(*) OVER f = 4 THEN list(close) OVER f END AS x FROM ss WINDOW f AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE x IS NOT NULL"))
def _(spark, sf):
    from .data import raw_bars

    d = T.window_rows(raw_bars(spark, sf), ["close", "open"], 4).where(F.col("window").isNotNull())
    return d.select("symbol", "datetime", F.size("window").cast("long").alias("n"), F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0]), 6).alias("total"))


@query("W36_positional_target", "SELECT o_orderkey, lead(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_price FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.lead("o_totalprice", 2).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("next_price"))


@query("J16_window_bounds", sql("ss", ", n AS (SELECT symbol, datetime, row_number() OVER (PARTITION BY symbol ORDER BY datetime) AS k FROM ss) SELECT a.symbol, a.datetime AS window_end, b.datetime AS window_start, datediff('minute', b.datetime, a.datetime) = 45 AS contiguous FROM n a JOIN n b ON a.symbol = b.symbol AND b.k = a.k - 3"))
def _(spark, sf):
    from .data import raw_bars

    w = ordered(["symbol"], "datetime")
    d = raw_bars(spark, sf).select("symbol", F.col("datetime").alias("window_end"), F.lag("datetime", 3).over(w).alias("window_start"))
    return d.where(F.col("window_start").isNotNull()).withColumn("contiguous", F.timestamp_diff("MINUTE", "window_start", "window_end") == 45)


@query("M4_persistence", sql("rr", ", q AS (SELECT sign(r1)::INT AS pred, sign(lead(r1) OVER (PARTITION BY symbol, segment_id ORDER BY datetime))::INT AS truth FROM rr) SELECT truth, pred, count(*) AS n FROM q WHERE truth IS NOT NULL AND pred IS NOT NULL GROUP BY ALL"))
def _(spark, sf):
    r = F.col("f_1m_log_return_1")
    d = returns(spark, sf).select(F.signum(r).cast("int").alias("pred"), F.signum(F.lead(r).over(ordered(["symbol", "segment_id"], "datetime"))).cast("int").alias("truth"))
    return M.confusion(d.dropna(), "truth", "pred")
