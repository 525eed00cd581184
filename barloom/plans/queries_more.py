"""Projections, normalisers, clocks, text scans, splits and the rest."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import expr as X
from ..operators import indicators as I
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import targets as T
from ..operators.windows import islands
from ..sources import tables as S
from ..streaming import streams as ST
from .data import STEP, bars, raw_bars, returns, rounded, segmented, sql, table, with_windows
from .queries_windows import ATR
from .registry import query


@query("P1_ordered_projection", sql("ss", "SELECT datetime, trading_date, session, open, close, symbol, bar_count AS extra FROM ss"))
def _(spark, sf):
    d = with_windows(raw_bars(spark, sf)).select("symbol", F.col("bar_count").alias("extra"), "close", "open", "session", "trading_date", "datetime")
    return d.select(*S.ordered_columns(d.columns))


@query("P2_norm_key", "SELECT c_custkey, lower(trim('  ' || c_mktsegment || ' ')) AS key FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.norm_key(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "))).alias("key"))


@query("P6_normalised_layer", sql("sb", "SELECT symbol, count(*) AS n, count(close) AS closes, min(datetime) AS first, max(datetime) AS last FROM sb GROUP BY 1"))
def _(spark, sf):
    d = S.require_columns(bars(spark, sf), ["symbol", "datetime", "close"])
    return d.groupBy(X.norm_key(F.col("symbol")).alias("symbol")).agg(F.count("*").alias("n"), F.count("close").alias("closes"), F.min("datetime").alias("first"), F.max("datetime").alias("last"))


@query("P7_date_floor", sql("ss", "SELECT symbol, datetime FROM ss WHERE trading_date >= DATE '2024-01-12'"))
def _(spark, sf):
    return S.floor_dates(with_windows(raw_bars(spark, sf)), "2024-01-12").select("symbol", "datetime")


@query("P10_finite_rows", sql("rr", "SELECT symbol, datetime, r1 IS NOT NULL AND r5 IS NOT NULL AS finite FROM rr"))
def _(spark, sf):
    d = returns(spark, sf)
    return d.select("symbol", "datetime", J.all_of([X.finite(F.col("f_1m_log_return_1")), X.finite(F.col("f_1m_log_return_5"))]).alias("finite"))


@query("P12_first_reason", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_orderstatus = 'P' THEN 'partial' WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'none' END AS reason FROM orders")
def _(spark, sf):
    reason = F.when(F.col("o_totalprice") > 300000, "large").when(F.col("o_orderstatus") == "P", "partial").when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise("none")
    return table(spark, sf, "orders").select("o_orderkey", reason.alias("reason"))


@query("P15_rename", "SELECT o_orderkey, o_custkey AS f_sm_o_custkey, o_orderstatus AS f_sm_o_orderstatus FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").withColumnsRenamed({c: f"f_sm_{c}" for c in ("o_custkey", "o_orderstatus")})


@query("S1_text_scan", sql("rb", "SELECT count(*) AS n_rows, 0::BIGINT AS invalid_datetime, count(CASE WHEN hour(datetime) = 5 THEN 1 END) AS invalid_open, 0::BIGINT AS invalid_close FROM rb"))
def _(spark, sf):
    raw = raw_bars(spark, sf).select(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("datetime"), F.when(F.hour("datetime") == 5, "n/a").otherwise(F.col("open").cast("string")).alias("open"), F.col("close").cast("string").alias("close"))
    return S.typed_bars(raw, ["open", "close"], "UTC")[1]


@query("S1_zone_scan", sql("rb", "SELECT symbol, datetime + INTERVAL 5 HOUR AS utc FROM rb"))
def _(spark, sf):
    raw = raw_bars(spark, sf).select("symbol", F.when(F.col("bar_count") > 1, F.date_format("datetime", "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))).alias("datetime"))
    return S.typed_bars(raw, [], "America/New_York")[0].select("symbol", F.col("datetime").alias("utc"))


@query("S16_coverage_start", "SELECT c_custkey, greatest(DATE '2020-01-01' + (c_custkey % 400)::INT, DATE '2020-06-01')::DATE AS start FROM customer")
def _(spark, sf):
    own = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 400).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", S.coverage_start(own, F.lit("2020-06-01").cast("date")).alias("start"))


@query("S20_snapshot", "SELECT o_orderkey, o_orderdate, o_custkey, o_orderstatus FROM orders")
def _(spark, sf):
    """All orders from three parts, of which one comes twice."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_custkey", "o_orderstatus")
    parts = [o.where(F.pmod("o_orderkey", F.lit(3)) == k) for k in (0, 1, 2, 0)]
    return Q.snapshot(parts, ["o_orderkey"], ["o_orderdate", "o_orderkey"])


@query("S27_validator_windows", sql("ss", "SELECT DISTINCT trading_date, session, session_start, session_end FROM ss WHERE session <> 'overnight'"))
def _(spark, sf):
    return with_windows(raw_bars(spark, sf)).where("session <> 'overnight'").select("trading_date", "session", "session_start", "session_end").distinct()


@query("F8_wall_time", sql("rb", "SELECT symbol, datetime, datetime - INTERVAL 5 HOUR AS local, datetime AS back FROM rb"))
def _(spark, sf):
    zone = "America/New_York"  # January: UTC - 5
    local = X.instant_to_local(F.col("datetime"), zone)
    return raw_bars(spark, sf).select("symbol", "datetime", local.alias("local"), X.local_to_instant(local, zone).alias("back"))


@query("F12_session_counts", sql("ss", "SELECT trading_date, session, count(*) AS n FROM ss GROUP BY 1, 2"))
def _(spark, sf):
    return with_windows(raw_bars(spark, sf)).groupBy("trading_date", "session").agg(F.count("*").alias("n"))


@query("F24_signature", "SELECT sha256('{\"features\":[\"a\",\"b\"],\"set\":\"core\"}') AS signature")
def _(spark, sf):
    return spark.range(1).select(F.lit(S.signature({"set": "core", "features": ["a", "b"]})).alias("signature"))


@query("F26_horizon_columns", "SELECT unnest(['target_valid_5m', 'target_realized_at_5m', 'target_same_session_5m', 'target_same_trading_date_5m', 'target_invalid_reason_5m']) AS name")
def _(spark, sf):
    return spark.createDataFrame([(c,) for c in S.horizon_columns(5, "structural")], "name string")


@query("F27_unscale", "SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity FROM lineitem")
def _(spark, sf):
    from ..operators import metrics as M

    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    fit = M.scaler(d, ["l_quantity"])
    wide = fit.select(F.col("mean").alias("_m"), F.col("scale").alias("_s"))
    back = M.scaled(d, fit, ["l_quantity"]).join(F.broadcast(wide))
    return rounded(back.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * F.col("_s") + F.col("_m")).alias("l_quantity")))


@query("O1_ordered_rows", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS k FROM orders")
def _(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("k"))


@query("O5_first_match", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def _(spark, sf):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf, "orders").withColumn("k", k).where("k = 1").select("o_custkey", "o_orderkey")


@query("O6_top_groups", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 20")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(20)


@query("E3_dedupe", "SELECT DISTINCT o_orderkey, o_custkey FROM orders")
def _(spark, sf):
    from ..operators.quality import dedupe_or_raise

    d = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return dedupe_or_raise(d.unionByName(d), ["o_orderkey"])


@query("A38_contract_hash", sql("ss", """, n AS (SELECT session, count(*) AS n FROM ss GROUP BY 1) SELECT sha256('[' || string_agg('{"session":"' || session || '","n":' || n || '}', ',' ORDER BY session) || ']') AS contract FROM n"""))
def _(spark, sf):
    d = with_windows(raw_bars(spark, sf)).groupBy("session").agg(F.count("*").alias("n"))
    rows = F.to_json(F.array_sort(F.collect_list(F.struct("session", "n"))))
    return d.agg(F.sha2(rows, 256).alias("contract"))


@query("W28_grouped_windows", "SELECT o_custkey, o_orderkey, len(x)::INT AS n, round(list_sum(x), 4) AS total FROM (SELECT o_custkey, o_orderkey, CASE WHEN count(*) OVER f = 3 THEN list(o_totalprice) OVER f END AS x FROM orders WINDOW f AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE x IS NOT NULL")
def _(spark, sf):
    f = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    d = table(spark, sf, "orders").withColumns({"x": F.collect_list("o_totalprice").over(f)}).where(F.size("x") == 3)
    return d.select("o_custkey", "o_orderkey", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("T3b_actions", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'FLAT' WHEN o_orderkey % 3 = 1 THEN 'LONG' ELSE 'SHORT' END AS side, (CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN 1 ELSE -1 END) <> (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS needs FROM orders")
def _(spark, sf):
    q = F.when(F.col("o_orderkey") % 3 == 0, 0).when(F.col("o_orderkey") % 3 == 1, 7).otherwise(-7)
    t = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(0)
    return table(spark, sf, "orders").select("o_orderkey", ST.broker_side(q).alias("side"), ST.needs_action(F.signum(q).cast("int"), t).alias("needs"))


@query("T4_state_carry", sql("cb", "SELECT symbol, datetime, contiguous_history FROM cb"))
def _(spark, sf):
    """What the loop over months carries as state is one window over all rows."""
    return segmented(spark, sf).select("symbol", "datetime", "contiguous_history")


@query("J8_label_alignment", sql("cb", ATR + ", lb AS (SELECT symbol, datetime, CASE WHEN (close - open) / close < -0.75 * atr_3 / close THEN -1 WHEN (close - open) / close > 0.75 * atr_3 / close THEN 1 WHEN atr_3 IS NOT NULL THEN 0 END AS label FROM atr_t JOIN (SELECT symbol, datetime, open FROM cb) USING (symbol, datetime)) SELECT symbol, datetime, label, lb.symbol IS NOT NULL AS found FROM cb LEFT JOIN lb USING (symbol, datetime)"))
def _(spark, sf):
    """Every bar, with the label of those that have one."""
    d = segmented(spark, sf)
    labels = T.labelled(T.wilder_atr(d, 3, STEP).withColumn("r", (F.col("close") - F.col("open")) / F.col("close")), "r", "atr_3").select("symbol", "datetime", "label")
    return J.checked_join(d.select("symbol", "datetime"), labels, ["symbol", "datetime"], matched="found")


@query("J11_grid_lookup", sql("ss", "SELECT symbol, datetime, session FROM ss"))
def _(spark, sf):
    d = with_windows(raw_bars(spark, sf)).select("symbol", "datetime", "session")
    return d.select("symbol", "datetime").join(d, ["symbol", "datetime"])


@query("W31_daily_bars", sql("ss", "SELECT symbol, trading_date, first(open ORDER BY datetime) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY datetime) AS close FROM ss GROUP BY 1, 2"))
def _(spark, sf):
    return I.daily(with_windows(raw_bars(spark, sf)))


@query("W16_daily_runs", "SELECT k, min(d) AS run_start, max(d) AS run_end, count(*) AS run_length FROM (SELECT k, d, d - INTERVAL 1 DAY * row_number() OVER (PARTITION BY k ORDER BY d) AS a FROM (SELECT DISTINCT o_orderpriority AS k, date_trunc('day', o_orderdate) AS d FROM orders)) GROUP BY k, a")
def _(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("d")).distinct()
    return islands(d, ["k"], "d", 1440)
