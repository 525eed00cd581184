"""Filtered scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import scans as SC
from .data import table
from .registry import query


@query("S11_until_month", "SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders WHERE year(o_orderdate) * 12 + month(o_orderdate) <= 1996 * 12 + 6")
def _(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return SC.until_month(d, 1996, 6)


@query("S14_filtered_table", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    return SC.filtered(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"], "o_orderstatus", "F")


@query("S28_finite_rows", "SELECT c_custkey, c_acctbal::DOUBLE AS balance FROM customer WHERE c_custkey % 4 > 0 AND c_custkey % 5 < 4")
def _(spark, sf):
    """Balances as text, of which some are no finite number, in three splits."""
    k = F.col("c_custkey")
    text = F.when(k % 5 == 4, F.element_at(F.array(F.lit("inf"), F.lit("nan"), F.lit("n/a")), (k % 3 + 1).cast("int"))).otherwise(F.col("c_acctbal").cast("string"))
    split = F.when(k % 4 == 0, "Test").when(k % 2 == 0, "TRAIN").otherwise("train")
    d = table(spark, sf, "customer").select("c_custkey", text.alias("balance"), split.alias("split"))
    return SC.finite_rows(d, ["balance"], "Train").drop("split")


@query("F25_feature_list", "SELECT * FROM (VALUES (0, 'close'), (1, 'acd_width'), (2, 'acd_state_0'), (3, 'acd_state_1')) v(place, feature)")
def _(spark, sf):
    names = SC.feature_list(["close"], ["width"], {"state": {"encoded_columns": ["acd_state_0", "acd_state_1"]}}, "acd_")
    return spark.createDataFrame(list(enumerate(names)), "place int, feature string")
