"""Inputs of the registered queries, made from the test tables, and the same
inputs in SQL. Bars have 15 minutes, symbols are event types; some closes are
taken out so that unusable rows occur."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.bars import bars_from_events, trading_date_of_clock, session_of_clock
from ..operators.features import return_features, with_continuity

STEP = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_bars(spark: SparkSession, sf_dir: str, minutes: int = STEP) -> DataFrame:
    return bars_from_events(table(spark, sf_dir, "events"), minutes=minutes)


def with_windows(df: DataFrame) -> DataFrame:
    """Clock sessions with their window."""
    d = df.withColumns({"session": session_of_clock(F.col("datetime")), "trading_date": trading_date_of_clock(F.col("datetime"))})
    day = F.col("trading_date").cast("timestamp_ntz")
    at = lambda minutes: F.timestamp_add("MINUTE", minutes, day)
    of = lambda a, b, c, e: F.when(F.col("session") == "overnight", a).when(F.col("session") == "premarket", b).when(F.col("session") == "regular", c).otherwise(e)
    return d.withColumns({"session_start": at(of(-240, 240, 570, 960)), "session_end": at(of(240, 570, 960, 1200))})


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_windows(raw_bars(spark, sf_dir))
    gone = (F.minute("datetime") == 45) & (F.col("bar_count") == 1)
    return d.withColumn("close", F.when(~gone, F.col("close")))


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_continuity(bars(spark, sf_dir), STEP)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return return_features(segmented(spark, sf_dir))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, for comparison by value."""
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-class predictions from line items: truth, probability, score, month."""
    li = table(spark, sf_dir, "lineitem")
    p = F.round((F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729, F.lit(1000)) + 0.5) / 1000.0, 4)
    truth = (F.pmod(F.col("l_partkey") * 31 + F.col("l_orderkey"), F.lit(1000)) / 1000.0 < 0.25 + 0.5 * p).cast("int")
    return li.select("l_orderkey", "l_linenumber", truth.alias("y"), p.alias("p"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_returnflag").alias("grp"), "l_linestatus", ((F.col("l_discount") - 0.05) * 1.0).alias("actual"), ((F.col("l_tax") - 0.04) * 1.0).alias("predicted"))


def three_class(df: DataFrame) -> DataFrame:
    return df.withColumns({"truth": F.when(F.col("actual") > 0.02, 1).when(F.col("actual") < -0.02, -1).otherwise(0), "pred": F.when(F.col("predicted") > 0.01, 1).when(F.col("predicted") < -0.01, -1).otherwise(0)})


#: The same inputs in SQL, each built on those before it.
CTES = {
    "rb": """rb AS (SELECT event_type AS symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS datetime, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
 last(value ORDER BY ts, event_id) AS close, sum(value::DECIMAL(28,6))::DOUBLE AS volume, count(*)::BIGINT AS bar_count, sum(value::DECIMAL(28,6))::DOUBLE / count(*) AS wap FROM events GROUP BY 1, 2)""",
    "ss": """ss AS (SELECT *, CASE WHEN session = 'overnight' THEN trading_date::TIMESTAMP - INTERVAL 240 MINUTE WHEN session = 'premarket' THEN trading_date::TIMESTAMP + INTERVAL 240 MINUTE WHEN session = 'regular' THEN trading_date::TIMESTAMP + INTERVAL 570 MINUTE ELSE trading_date::TIMESTAMP + INTERVAL 960 MINUTE END AS session_start,
 CASE WHEN session = 'overnight' THEN trading_date::TIMESTAMP + INTERVAL 240 MINUTE WHEN session = 'premarket' THEN trading_date::TIMESTAMP + INTERVAL 570 MINUTE WHEN session = 'regular' THEN trading_date::TIMESTAMP + INTERVAL 960 MINUTE ELSE trading_date::TIMESTAMP + INTERVAL 1200 MINUTE END AS session_end
 FROM (SELECT *, CASE WHEN hour(datetime) < 4 OR hour(datetime) >= 20 THEN 'overnight' WHEN hour(datetime) * 60 + minute(datetime) < 570 THEN 'premarket' WHEN hour(datetime) < 16 THEN 'regular' ELSE 'aftermarket' END AS session,
 (CASE WHEN hour(datetime) >= 20 THEN datetime::DATE + 1 ELSE datetime::DATE END)::DATE AS trading_date FROM rb))""",
    "sb": "sb AS (SELECT * REPLACE (CASE WHEN NOT (minute(datetime) = 45 AND bar_count = 1) THEN close END AS close) FROM ss)",
    "cb": """cb AS (SELECT *, CASE WHEN is_usable THEN least(row_number() OVER (PARTITION BY symbol, segment_id ORDER BY datetime), 512) ELSE 0 END::INT AS contiguous_history FROM
 (SELECT *, sum(CASE WHEN break_reason <> 'contiguous' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY datetime)::BIGINT AS segment_id FROM
 (SELECT *, CASE WHEN pts IS NULL THEN 'source_start' WHEN NOT is_usable THEN 'current_unusable' WHEN datediff('minute', pts, datetime) <> 15 THEN 'time_gap' WHEN NOT pu THEN 'previous_unusable' ELSE 'contiguous' END AS break_reason FROM
 (SELECT *, lag(datetime) OVER w AS pts, lag(is_usable) OVER w AS pu FROM (SELECT *, close IS NOT NULL AS is_usable FROM sb) WINDOW w AS (PARTITION BY symbol ORDER BY datetime)))))""",
    "rr": """rr AS (SELECT *, ln(close) - ln(lag(close, 1) OVER g) AS r1, ln(close) - ln(lag(close, 5) OVER g) AS r5, ln(close) - ln(lag(close, 15) OVER g) AS r15, lag(close) OVER g AS pc FROM cb WINDOW g AS (PARTITION BY symbol, segment_id ORDER BY datetime))""",
    "pp": """pp AS (SELECT l_orderkey, l_linenumber, y, p, month, grp, l_linestatus, actual, predicted, CASE WHEN actual > 0.02 THEN 1 WHEN actual < -0.02 THEN -1 ELSE 0 END AS truth, CASE WHEN predicted > 0.01 THEN 1 WHEN predicted < -0.01 THEN -1 ELSE 0 END AS pred FROM
 (SELECT *, CASE WHEN (l_partkey * 31 + l_orderkey) % 1000 / 1000.0 < 0.25 + 0.5 * p THEN 1 ELSE 0 END AS y, strftime(l_shipdate, '%Y-%m') AS month, l_returnflag AS grp, l_discount - 0.05 AS actual, l_tax - 0.04 AS predicted FROM
 (SELECT *, round(((l_orderkey * 7919 + l_linenumber * 104729) % 1000 + 0.5) / 1000.0::DOUBLE, 4) AS p FROM lineitem)))""",
}
ORDER = ("rb", "ss", "sb", "cb", "rr", "pp")
NEEDS = {"rb": (), "ss": ("rb",), "sb": ("rb", "ss"), "cb": ("rb", "ss", "sb"), "rr": ("rb", "ss", "sb", "cb"), "pp": ()}


def sql(last: str, body: str) -> str:
    """A statement with the inputs that it builds on."""
    names = {n for one in last.split() for n in (*NEEDS[one], one)}
    ctes = ", ".join(CTES[n] for n in ORDER if n in names)
    return f"WITH {ctes}{body if body.lstrip().startswith(',') else ' ' + body}"


def r6(names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names.split())
