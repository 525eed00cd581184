"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import targets as T
from .data import STEP, one_sided, raw_bars, returns, rounded, segmented, sql, table, three_class, with_windows
from .queries_windows import ATR
from .registry import query

BROKEN = """, br AS (SELECT * REPLACE (CASE WHEN hour(datetime) = 1 THEN low - 1 ELSE high END AS high, CASE WHEN hour(datetime) = 2 THEN -volume ELSE volume END AS volume, CASE WHEN hour(datetime) = 3 THEN high + 1 ELSE wap END AS wap, CASE WHEN hour(datetime) = 4 THEN -close ELSE close END AS close) FROM rb),
 fl AS (SELECT *, high < greatest(open, close) AS i1, low > least(open, close) AS i2, high < low AS i3, least(open, high, low, close) <= 0 AS i4, volume < 0 AS i5, greatest(low - wap, wap - high) > 0.005 + 1e-12 AS i6 FROM br)"""


def broken(spark, sf):
    """Bars with planted faults by hour of day."""
    h = F.hour("datetime")
    hi, cl = F.col("high"), F.col("close")
    return raw_bars(spark, sf).withColumns({"high": F.when(h == 1, F.col("low") - 1).otherwise(hi), "volume": F.when(h == 2, -F.col("volume")).otherwise(F.col("volume")), "wap": F.when(h == 3, hi + 1).otherwise(F.col("wap")), "close": F.when(h == 4, -cl).otherwise(cl)})


@query("V1_integrity", sql("rb", BROKEN + " SELECT count(*) AS n_rows, 0::BIGINT AS missing_price, count(CASE WHEN i1 THEN 1 END) AS high_below_body, count(CASE WHEN i2 THEN 1 END) AS low_above_body, count(CASE WHEN i3 THEN 1 END) AS high_below_low, count(CASE WHEN i4 THEN 1 END) AS non_positive_price, count(CASE WHEN i5 THEN 1 END) AS negative_volume, 0::BIGINT AS negative_bar_count, count(CASE WHEN i6 THEN 1 END) AS wap_outside_range FROM fl"))
def _(spark, sf):
    return Q.integrity(broken(spark, sf))


@query("V2_wap_distance", sql("rb", BROKEN + " SELECT count(CASE WHEN d > 0 THEN 1 END) AS outside, count(CASE WHEN d > 0.005 + 1e-12 THEN 1 END) AS beyond_tolerance, round(max(d), 6) AS max_excess FROM (SELECT greatest(low - wap, wap - high, 0) AS d FROM br)"))
def _(spark, sf):
    return rounded(Q.wap_diagnostics(broken(spark, sf)))


@query("V3_row_issues", sql("rb", BROKEN + " SELECT symbol, datetime, unnest(list_filter([CASE WHEN i1 THEN 'high_below_body' END, CASE WHEN i2 THEN 'low_above_body' END, CASE WHEN i3 THEN 'high_below_low' END, CASE WHEN i4 THEN 'non_positive_price' END, CASE WHEN i5 THEN 'negative_volume' END, CASE WHEN i6 THEN 'wap_outside_range' END], lambda x: x IS NOT NULL)) AS issue FROM fl"))
def _(spark, sf):
    return Q.row_issues(broken(spark, sf), ["symbol", "datetime"])


@query("V4_status", sql("rb", BROKEN + " SELECT symbol, count(CASE WHEN i1 OR i3 THEN 1 END) AS n_fail, count(CASE WHEN i6 THEN 1 END) AS n_warn, CASE WHEN count(CASE WHEN i1 OR i3 THEN 1 END) > 0 THEN 'FAIL' WHEN count(CASE WHEN i6 THEN 1 END) > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM fl GROUP BY 1"))
def _(spark, sf):
    i = Q.issues()
    d = broken(spark, sf).groupBy("symbol").agg(F.count_if(i["high_below_body"] | i["high_below_low"]).alias("n_fail"), F.count_if(i["wap_outside_range"]).alias("n_warn"))
    return d.withColumn("status", Q.status(F.col("n_fail"), F.col("n_warn")))


@query("A8_duplicate_audit", "WITH d AS (SELECT o_custkey, o_orderstatus, count(*) AS n, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1, 2 HAVING count(*) > 1) SELECT count(CASE WHEN k = 1 THEN 1 END) AS exact_keys, count(CASE WHEN k > 1 THEN 1 END) AS conflicting_keys, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows FROM d")
def _(spark, sf):
    return Q.duplicate_audit(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderpriority"])


@query("A35_duplicate_keys", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    from ..operators.joins import duplicate_keys

    return duplicate_keys(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@query("A9_microstructure", sql("ss", "SELECT session, count(*) AS n_rows, count(CASE WHEN volume = 0 THEN 1 END) AS zero_volume, 0::BIGINT AS zero_count, count(CASE WHEN high = low THEN 1 END) AS flat, round(avg(volume / bar_count), 6) AS mean_volume_per_count, round(median(volume / bar_count), 6) AS median_volume_per_count, round(median(volume), 6) AS median_volume, round(avg(CASE WHEN volume > 0 THEN 1.0 ELSE 0 END), 6) AS active_share FROM ss GROUP BY 1"))
def _(spark, sf):
    return rounded(Q.microstructure(with_windows(raw_bars(spark, sf)), ["session"]))


@query("A10_by_hour", sql("ss", "SELECT hour(datetime)::INT AS hour, count(*) AS n_rows, round(median(volume), 6) AS median_volume FROM ss GROUP BY 1"))
def _(spark, sf):
    d = Q.microstructure(with_windows(raw_bars(spark, sf)).withColumn("hour", F.hour("datetime")), ["hour"])
    return rounded(d.select("hour", "n_rows", "median_volume"))


@query("V5_outside_expected", sql("ss", "SELECT symbol, datetime, CASE WHEN datetime < TIMESTAMP '2024-01-05' THEN 'before_coverage' WHEN datetime > TIMESTAMP '2024-01-25' THEN 'after_coverage' ELSE 'off_grid' END AS reason FROM ss WHERE datetime < TIMESTAMP '2024-01-05' OR datetime > TIMESTAMP '2024-01-25' OR minute(datetime) = 45"))
def _(spark, sf):
    d = with_windows(raw_bars(spark, sf))
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 00:00:00", "2024-01-25 00:00:00"))
    grid = d.where((F.col("datetime") >= lo) & (F.col("datetime") <= hi) & (F.minute("datetime") != 45))
    return Q.outside_expected(d, grid, ["symbol"], "datetime", lo, hi).select("symbol", "datetime", "reason")


@query("V8_label_table", sql("pp", "SELECT count(*) AS n_rows, 0::BIGINT AS bad_labels, count(CASE WHEN actual < 0 THEN 1 END) AS bad_thresholds, (SELECT count(*) FROM (SELECT l_orderkey FROM pp GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys FROM pp"))
def _(spark, sf):
    return Q.label_table(three_class(one_sided(spark, sf)), ["l_orderkey"], "truth", "actual")


@query("V9_monotone", "SELECT count(CASE WHEN p >= ts THEN 1 END) AS steps_back, count(*) AS n_rows FROM (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)")
def _(spark, sf):
    return Q.monotone(table(spark, sf, "events"), ["user_id"], "event_id", "ts")


@query("V10_aligned_dates", sql("ss", "SELECT symbol, count(DISTINCT trading_date) AS dates, (SELECT count(DISTINCT trading_date) FROM ss) AS all_dates, count(DISTINCT trading_date) = (SELECT count(DISTINCT trading_date) FROM ss) AS aligned FROM ss GROUP BY 1"))
def _(spark, sf):
    return Q.aligned_dates(with_windows(raw_bars(spark, sf)), "symbol", "trading_date")


@query("V11_finite_domain", sql("rr", "SELECT count(*) AS n_rows, count(CASE WHEN r1 IS NULL THEN 1 END) AS not_finite FROM rr"))
def _(spark, sf):
    from ..functions.expr import finite

    return returns(spark, sf).agg(F.count("*").alias("n_rows"), F.count_if(~finite(F.col("f_1m_log_return_1"))).alias("not_finite"))


@query("A36_vocabulary", "SELECT o_orderpriority AS value FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1")
def _(spark, sf):
    from ..operators.indicators import fit_vocabularies

    v = fit_vocabularies(table(spark, sf, "orders").where("o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00'"), ["o_orderpriority"])
    return spark.createDataFrame([(x,) for x in v["o_orderpriority"]], "value string")


@query("J7_atr_join", sql("cb", ATR + " SELECT symbol, datetime, round(atr_3, 5) AS atr_3 FROM atr_t"))
def _(spark, sf):
    """The range of every bar that must have one; a missing partner raises."""
    from ..operators.joins import checked_join

    d = segmented(spark, sf).where("is_usable AND high > 0 AND low > 0 AND close > 0").select("symbol", "datetime")
    atr = T.wilder_atr(segmented(spark, sf), 3, STEP).select("symbol", "datetime", F.round("atr_3", 5).alias("atr_3"))
    return checked_join(d, atr, ["symbol", "datetime"], complete=True)
