"""Joins with declared cardinality, set operations, scans and merges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.calendar import Calendar
from ..operators import indicators as I
from ..operators import joins as J
from ..operators.windows import merge_intervals
from ..sources import tables as S
from ..streaming import streams as ST
from .data import STEP, bars, one_sided, raw_bars, rounded, sql, table, three_class, with_windows
from .registry import query


@query("J2_one_to_one", "SELECT o_orderkey, o_totalprice, n FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1) USING (o_orderkey)")
def _(spark, sf):
    per = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return J.checked_join(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), per, ["o_orderkey"])


@query("J3_many_to_one", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.checked_join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"], validate="many_to_one").drop("o_custkey")


@query("J4_indicator", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS matched FROM customer")
def _(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return J.checked_join(table(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"], matched="matched")


@query("J5_source_identity", sql("ss", "SELECT count(*) AS matched, count(CASE WHEN abs(o - close) > 1e-6 THEN 1 END) AS over_close, round(max(abs(o - close)), 6) AS max_close, 0::BIGINT AS over_high, 0.0::DOUBLE AS max_high FROM (SELECT *, CASE WHEN hour(datetime) = 3 THEN close + 0.5 ELSE close END AS o FROM ss)"))
def _(spark, sf):
    d = raw_bars(spark, sf).select("symbol", "datetime", "close", "high")
    other = d.withColumn("close", F.when(F.hour("datetime") == 3, F.col("close") + 0.5).otherwise(F.col("close")))
    return rounded(J.numeric_identity(d, other, ["symbol", "datetime"], ["close", "high"]))


@query("J10_calendar_labels", sql("rb", ", w AS (SELECT d::DATE AS d, s, p, a, z FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 DAY) g(d), (VALUES ('premarket', 0, 240, 570), ('regular', 1, 570, 960), ('aftermarket', 2, 960, 1200), ('overnight', 3, -240, 240)) v(s, p, a, z) WHERE isodow(d) < 6 AND d::DATE NOT IN (DATE '2024-01-01', DATE '2024-01-15')), l AS (SELECT symbol, datetime, s, d, row_number() OVER (PARTITION BY symbol, datetime ORDER BY p) AS k FROM rb LEFT JOIN w ON datetime >= d::TIMESTAMP + a * INTERVAL 1 MINUTE AND datetime < d::TIMESTAMP + z * INTERVAL 1 MINUTE) SELECT symbol, datetime, coalesce(s, 'unknown') AS session, d AS trading_date FROM l WHERE k = 1"))
def _(spark, sf):
    w = Calendar().session_windows(spark, dt.date(2024, 1, 1), dt.date(2024, 2, 1))
    return J.interval_label(raw_bars(spark, sf).select("symbol", "datetime"), "datetime", w).select("symbol", "datetime", "session", "trading_date")


@query("P8_in_intervals", "WITH d AS (SELECT DISTINCT l_shipdate AS s FROM lineitem) SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM d WHERE o_orderdate BETWEEN s AND s + INTERVAL 2 DAY)")
def _(spark, sf):
    """Intervals of all line items, merged by supplier."""
    li = table(spark, sf, "lineitem")
    iv = merge_intervals(li.select("l_suppkey", F.col("l_shipdate").alias("start"), (F.col("l_shipdate") + F.expr("interval 2 days")).alias("end")), ["l_suppkey"], "start", "end")
    return J.in_any_interval(table(spark, sf, "orders"), "o_orderdate", iv.select("start", "end").distinct(), "start", "end").select("o_orderkey")


@query("J14_semi_anti", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'semi' ELSE 'anti' END AS side FROM customer")
def _(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("side", F.lit("semi")).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("side", F.lit("anti")))


@query("J15_alignment", sql("ss", "SELECT count(CASE WHEN hour(datetime) = 5 THEN 1 END) AS only_left, 0::BIGINT AS only_right, count(CASE WHEN hour(datetime) <> 5 THEN 1 END) AS both, 0::BIGINT AS diff_close FROM ss"))
def _(spark, sf):
    d = raw_bars(spark, sf).select("symbol", "datetime", "close")
    return J.differences(d, d.where(F.hour("datetime") != 5), ["symbol", "datetime"], ["close"])


@query("J18_paired_universe", sql("ss", "SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right, count(*) AS both, count(CASE WHEN bar_count = 1 THEN 1 END) AS diff_close, 0::BIGINT AS diff_high FROM ss"))
def _(spark, sf):
    d = raw_bars(spark, sf).select("symbol", "datetime", "close", "high", "bar_count")
    other = d.withColumn("close", F.when(F.col("bar_count") > 1, F.col("close")))
    return J.differences(d, other, ["symbol", "datetime"], ["close", "high"])


@query("J19_close_lookup", "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice").dropDuplicates(["l_orderkey"])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey", "left")


@query("J17_state_features", sql("ss", """, e AS (SELECT symbol, trading_date, avg(close) AS v FROM ss GROUP BY 1, 2),
 b AS (SELECT symbol, datetime, hour(datetime) >= 10 AND bar_count > 1 AS sa, v > 10 AS ea, session = 'regular' AS ra, close > open AS up, high - low AS width, v FROM ss JOIN e USING (symbol, trading_date))
 SELECT symbol, datetime, sa AS sm_available, ea AS sm_env_available, ra AS sm_regime_available, round(CASE WHEN sa THEN width ELSE 0.0 END, 6) AS f_sm_width, round(CASE WHEN ea THEN v ELSE 0.0 END, 6) AS f_sm_atr_value, (sa AND NOT up)::INT AS f_sm_state_down, (sa AND up)::INT AS f_sm_state_up, (NOT sa)::INT AS f_sm_state_unavailable, 0 AS f_sm_state_unseen, ra::INT AS f_sm_regime_r1, (NOT ra)::INT AS f_sm_regime_unavailable, 0 AS f_sm_regime_unseen FROM b"""))
def _(spark, sf):
    """The state layer over bars: state, context and regime by bar, environment by date."""
    base = with_windows(raw_bars(spark, sf)).withColumn("prediction_time", F.timestamp_add("MINUTE", F.lit(STEP), F.col("datetime")))
    key = ["symbol", "datetime"]
    state = base.select(*key, (F.hour("datetime") >= 10).alias("opening_range_finalized"), F.lit(True).alias("zone_available"), F.when(F.col("close") > F.col("open"), "up").otherwise("down").alias("state"))
    context = base.select(*key, (F.col("bar_count") > 1).alias("acd_available"), (F.col("high") - F.col("low")).alias("width"))
    regime = base.where("session = 'regular'").select(*key, F.lit("r1").alias("regime"))
    env = base.groupBy("symbol", "trading_date").agg(F.min("datetime").alias("or_finalized_at"), F.avg("close").alias("atr_value")).withColumns({"atr_valid": F.lit(True), "or_width_valid": F.col("atr_value") > 10})
    gates = {"sm_available": {"state": "unavailable", "width": 0.0}, "sm_env_available": {"atr_value": 0.0}, "sm_regime_available": {"regime": "unavailable"}}
    d = I.state_features(base, state, context, env, regime, gates)
    vocabulary = I.fit_vocabularies(d.where(F.col("trading_date") <= F.lit("2024-01-20").cast("date")), ["f_sm_state", "f_sm_regime"])
    return rounded(I.encode_categories(d.select(*key, "sm_available", "sm_env_available", "sm_regime_available", "f_sm_state", "f_sm_width", "f_sm_atr_value", "f_sm_regime"), vocabulary))


@query("E1_union", "SELECT k, sum(n)::BIGINT AS n FROM (SELECT o_custkey AS k, 1 AS n FROM orders UNION ALL SELECT c_custkey, 0 FROM customer) GROUP BY 1")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.lit(1).alias("n"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return o.unionByName(c, allowMissingColumns=True).groupBy("k").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


@query("E2_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", "o_orderstatus").distinct()


@query("E4_except_intersect", "SELECT k, 'both' AS side FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT k, 'only' FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def _(spark, sf):
    o = table(spark, sf, "orders")
    f, p = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    return f.intersect(p).withColumn("side", F.lit("both")).unionByName(f.subtract(p).withColumn("side", F.lit("only")))


@query("E5_key_set_equality", "SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS missing, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS extra, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS repeated")
def _(spark, sf):
    need = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    have = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    n = lambda d, name: d.agg(F.count("*").alias(name))
    return n(need.subtract(have), "missing").join(n(have.subtract(need), "extra")).join(n(J.duplicate_keys(have, ["k"]), "repeated"))


@query("E7_months", sql("ss", "SELECT year(datetime)::INT AS year, month(datetime)::INT AS month, count(*) AS n FROM ss GROUP BY 1, 2"))
def _(spark, sf):
    return raw_bars(spark, sf).groupBy(F.year("datetime").alias("year"), F.month("datetime").alias("month")).agg(F.count("*").alias("n"))


@query("S7_bounded_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate <= TIMESTAMP '1996-06-30'")
def _(spark, sf):
    last = F.lit("1996-06-30 00:00:00").cast("timestamp_ntz")
    return S.bounded(table(spark, sf, "lineitem"), last_time=last, ts="l_shipdate").select("l_orderkey", "l_linenumber", "l_quantity")


@query("S8_sealed_scan", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'train' ELSE 'validation' END AS split FROM orders WHERE o_orderstatus IN ('F', 'O')")
def _(spark, sf):
    d = table(spark, sf, "orders").where("o_orderstatus IN ('F', 'O')").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "train").otherwise("validation").alias("split"))
    return S.sealed(d)


@query("S5_projected_scan", "SELECT l_returnflag, count(*) AS n, sum(l_quantity)::DOUBLE AS q FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "lineitem").where("l_discount > 0.05").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@query("S10_required_months", "SELECT DISTINCT year(d)::INT AS year, month(d)::INT AS month FROM (SELECT unnest(generate_series(date_trunc('month', l_shipdate), date_trunc('month', l_shipdate + INTERVAL 40 DAY), INTERVAL 1 MONTH)) AS d FROM lineitem)")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("start"), (F.col("l_shipdate") + F.expr("interval 40 days")).alias("end"))
    return S.required_months(li, "start", "end")


@query("S12_row_count", "SELECT count(*) AS n FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"))


@query("S15_lookup", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 3")
def _(spark, sf):
    d = table(spark, sf, "nation").withColumn("key", F.col("n_nationkey").cast("string"))
    return S.lookup(d, key=" 3 ").select("n_nationkey", "n_name")


@query("S18_epoch_or_text", "SELECT event_id, date_trunc('second', ts) AS at FROM events")
def _(spark, sf):
    from ..functions.expr import epoch_or_text

    second = F.date_trunc("second", "ts").cast("timestamp")
    text = F.when(F.col("event_id") % 2 == 0, F.unix_timestamp(second).cast("string")).otherwise(F.date_format(second, "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", epoch_or_text(text).alias("at"))


@query("S19_missing_dates", sql("ss", "SELECT d::DATE AS trading_date FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-15', INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6 AND d::DATE NOT IN (DATE '2024-01-01', DATE '2024-01-15') AND d::DATE NOT IN (SELECT trading_date FROM ss)"))
def _(spark, sf):
    days = Calendar().sessions(dt.date(2024, 1, 1), dt.date(2024, 2, 15))
    cal = spark.createDataFrame([(d,) for d in days], "trading_date date")
    return S.missing_dates(cal, with_windows(raw_bars(spark, sf)))


@query("F11_sessions", "SELECT d::DATE AS day FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6 AND d::DATE NOT IN (DATE '2024-01-01', DATE '2024-01-15', DATE '2024-02-19', DATE '2024-03-29', DATE '2024-05-27', DATE '2024-06-19', DATE '2024-07-04', DATE '2024-09-02', DATE '2024-11-28', DATE '2024-12-25')")
def _(spark, sf):
    return spark.createDataFrame([(d,) for d in Calendar().sessions(dt.date(2024, 1, 1), dt.date(2024, 12, 31))], "day date")


DAYS = """SELECT d::DATE AS day, CASE WHEN d::DATE IN (DATE '2018-07-03', DATE '2018-11-23', DATE '2018-12-24', DATE '2025-07-03', DATE '2025-11-28', DATE '2025-12-24') THEN 13 ELSE 16 END::INT AS close_hour,
 CASE WHEN d::DATE IN (DATE '2018-07-03', DATE '2018-11-23', DATE '2018-12-24', DATE '2025-07-03', DATE '2025-11-28', DATE '2025-12-24') THEN 17 ELSE 20 END::INT AS aftermarket_end_hour
 FROM (SELECT unnest(generate_series(TIMESTAMP '2018-01-01', TIMESTAMP '2018-12-31', INTERVAL 1 DAY)) AS d UNION ALL SELECT unnest(generate_series(TIMESTAMP '2025-01-01', TIMESTAMP '2025-12-31', INTERVAL 1 DAY)))
 WHERE isodow(d) < 6 AND d::DATE NOT IN (DATE '2018-01-01', DATE '2018-01-15', DATE '2018-02-19', DATE '2018-03-30', DATE '2018-05-28', DATE '2018-07-04', DATE '2018-09-03', DATE '2018-11-22', DATE '2018-12-05', DATE '2018-12-25',
 DATE '2025-01-01', DATE '2025-01-09', DATE '2025-01-20', DATE '2025-02-17', DATE '2025-04-18', DATE '2025-05-26', DATE '2025-06-19', DATE '2025-07-04', DATE '2025-09-01', DATE '2025-11-27', DATE '2025-12-25')"""


@query("F11_closures_and_early_closes", DAYS)
def _(spark, sf):
    at = lambda name, what: F.max(F.when(F.col("session") == name, F.hour(what))).cast("int")
    years = [Calendar().session_windows(spark, dt.date(y, 1, 1), dt.date(y, 12, 31)) for y in (2018, 2025)]
    return years[0].unionByName(years[1]).groupBy(F.col("trading_date").alias("day")).agg(at("regular", "end").alias("close_hour"), at("aftermarket", "end").alias("aftermarket_end_hour"))


@query("K3_merge_insert", "SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS new_rows, (SELECT count(*) FROM orders WHERE o_orderkey % 5 IN (1, 2)) AS identical, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 3) AS conflicts, (SELECT count(*) FROM orders) AS merged")
def _(spark, sf):
    o, k = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), F.col("o_orderkey") % 5
    incoming = o.where(k.isin(0, 1, 2, 3)).withColumn("o_totalprice", F.when(k == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    merged, report = S.merge_insert(o.where(k != 0), incoming, ["o_orderkey"])
    return report.join(merged.agg(F.count("*").alias("merged")))


@query("K5_fingerprint")
def _(spark, sf):
    return S.fingerprint(table(spark, sf, "orders"))


@query("K10_target_view", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= (SELECT min(o_orderdate) + INTERVAL 1000 DAY FROM orders)")
def _(spark, sf):
    first = table(spark, sf, "orders").agg((F.min("o_orderdate") + F.expr("interval 1000 days")).alias("first"))
    return table(spark, sf, "lineitem").join(F.broadcast(first), F.col("l_shipdate") >= F.col("first")).select("l_orderkey", "l_linenumber")


@query("T3_positions", sql("rb", ", s AS (SELECT symbol, datetime, CASE WHEN close > open + 20 THEN 1 WHEN close < open - 20 THEN -1 END AS sig FROM rb), b AS (SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM s) SELECT symbol, datetime, CASE WHEN sig IS NULL OR sig = bf THEN 'HOLD' WHEN bf = 0 THEN 'OPEN' ELSE 'REVERSE' END AS action, coalesce(sig, bf) AS position FROM b"))
def _(spark, sf):
    d = raw_bars(spark, sf).select("symbol", "datetime", F.when(F.col("close") - F.col("open") > 20, 1.0).when(F.col("close") - F.col("open") < -20, -1.0).otherwise(0.0).alias("predicted_return"))
    return ST.positions(d, 0.5).drop("predicted_return")


@query("T2_last_n", sql("rb", "SELECT symbol, datetime, round(avg(close) OVER f, 6) AS mean_close, round(close / nullif(lag(close, 3) OVER w, 0) - 1, 6) AS window_return FROM rb WINDOW w AS (PARTITION BY symbol ORDER BY datetime), f AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER f = 4"))
def _(spark, sf):
    return rounded(ST.last_n_batch(raw_bars(spark, sf), 4))


@query("T1_messages", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(spark, sf):
    d = table(spark, sf, "events").select("event_id", F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit("}")).alias("value"))
    return ST.parse_messages(d, "event_id long, k long")


@query("T5_tumbling_bars", sql("rb", "SELECT symbol, datetime, open, high, low, close, round(volume, 6) AS volume, bar_count FROM rb"))
def _(spark, sf):
    return rounded(ST.windowed_bars(table(spark, sf, "events")))


@query("T5_gap_sessions", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, run")
def _(spark, sf):
    return ST.gap_sessions(table(spark, sf, "events"))


@query("P11_regime_filter", sql("pp", "SELECT l_orderkey, l_linenumber, truth FROM pp WHERE grp = 'R' AND l_linestatus = 'O' AND truth <> 0"))
def _(spark, sf):
    return three_class(one_sided(spark, sf)).where("grp = 'R' AND l_linestatus = 'O' AND truth <> 0").select("l_orderkey", "l_linenumber", "truth")


@query("P5_canonical", sql("sb", "SELECT 0::BIGINT AS bad_datetime, count(CASE WHEN close IS NULL THEN 1 END) AS missing_numbers, 0::BIGINT AS unknown_session, 0::BIGINT AS fractional_count, 0::BIGINT AS bad_flags, 0::BIGINT AS bad_calendar_date, 0::BIGINT AS repeated_keys FROM sb"))
def _(spark, sf):
    return S.canonical_checks(S.canonical(bars(spark, sf).drop("session_start", "session_end"), "SRC"))
