"""Metrics, class weights, calibration, scans and profiles."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import metrics as M
from .data import one_sided, raw_bars, returns, rounded, sql, table, three_class, with_windows
from .registry import query

CLASSES = (-1, 0, 1)


def class_sql(classes=CLASSES, truth="truth", pred="pred"):
    """Metric columns of a confusion table in SQL."""
    out, rec, f1 = [], [], []
    for c in classes:
        n = str(c).replace("-", "m")
        hit, real, said = (f"count(CASE WHEN {x} THEN 1 END)" for x in (f"{truth} = {c} AND {pred} = {c}", f"{truth} = {c}", f"{pred} = {c}"))
        p, r = f"coalesce({hit} / nullif({said}, 0), 0)", f"coalesce({hit} / nullif({real}, 0), 0)"
        f = f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0)"
        out += [f"round({p}, 6) AS precision_{n}", f"round({r}, 6) AS recall_{n}", f"round({f}, 6) AS f1_{n}", f"{real} AS support_{n}"]
        rec.append(r)
        f1.append(f)
    k = len(classes)
    return f"count(*) AS n_rows, round(count(CASE WHEN {truth} = {pred} THEN 1 END) / count(*), 6) AS accuracy, {', '.join(out)}, round(({' + '.join(rec)}) / {k}, 6) AS balanced_accuracy, round(({' + '.join(f1)}) / {k}, 6) AS macro_f1"


def classes(spark, sf):
    return three_class(one_sided(spark, sf))


@query("A20_confusion", sql("pp", "SELECT truth, pred, count(*) AS n FROM pp GROUP BY 1, 2"))
def _(spark, sf):
    return M.confusion(classes(spark, sf), "truth", "pred")


@query("A20_classification", sql("pp", f"SELECT {class_sql()} FROM pp"))
def _(spark, sf):
    return rounded(classes(spark, sf).agg(*[c.alias(k) for k, c in M.classification(list(CLASSES), "truth", "pred").items()]))


@query("A21_grouped_metrics", sql("pp", f"SELECT CASE WHEN grouping(grp) = 1 AND grouping(l_linestatus) = 1 THEN 'all' WHEN grouping(l_linestatus) = 1 THEN 'grp' WHEN grouping(grp) = 1 THEN 'l_linestatus' ELSE 'grp+l_linestatus' END AS level, grp, l_linestatus, {class_sql()} FROM pp GROUP BY GROUPING SETS ((), (grp), (l_linestatus), (grp, l_linestatus))"))
def _(spark, sf):
    return rounded(M.grouping_sets(classes(spark, sf), [[], ["grp"], ["l_linestatus"], ["grp", "l_linestatus"]], M.classification(list(CLASSES), "truth", "pred")))


@query("A42_supported_only", sql("pp", "SELECT 2 AS n_classes, round(avg(r), 6) AS balanced_accuracy FROM (SELECT truth, count(CASE WHEN pred = truth THEN 1 END) / count(*) AS r FROM pp WHERE truth <> 0 GROUP BY 1)"))
def _(spark, sf):
    m = M.classification(list(CLASSES), "truth", "pred", supported_only=True)
    return rounded(classes(spark, sf).where("truth <> 0").agg(F.lit(2).alias("n_classes"), m["balanced_accuracy"].alias("balanced_accuracy")))


@query("A19_class_weights", sql("pp", "SELECT truth, n, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM (SELECT truth, count(*) AS n FROM pp GROUP BY 1)"))
def _(spark, sf):
    return rounded(M.class_weights(classes(spark, sf), "truth"))


AUC = "SELECT {by} round((sum(CASE WHEN y = 1 THEN rk END) - count(CASE WHEN y = 1 THEN 1 END) * (count(CASE WHEN y = 1 THEN 1 END) + 1) / 2) / (count(CASE WHEN y = 1 THEN 1 END) * count(CASE WHEN y = 0 THEN 1 END)), 6) AS auc FROM (SELECT *, rank() OVER (PARTITION BY {part} ORDER BY p) + (count(*) OVER (PARTITION BY {part}, p) - 1) / 2 AS rk FROM pp) {group}"


@query("A26_roc_auc", sql("pp", AUC.format(by="", part="1", group="")))
def _(spark, sf):
    return rounded(M.roc_auc(one_sided(spark, sf), "y", "p"))


@query("A39_auc_by_month", sql("pp", AUC.format(by="month,", part="month", group="GROUP BY month")))
def _(spark, sf):
    return rounded(M.roc_auc(one_sided(spark, sf), "y", "p", ["month"]))


@query("A27_brier_log_loss", sql("pp", "SELECT grp, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM pp GROUP BY 1"))
def _(spark, sf):
    return rounded(one_sided(spark, sf).groupBy("grp").agg(*[c.alias(k) for k, c in M.probability("y", "p").items()]))


@query("A25_probability_summary", sql("pp", "SELECT y, round(avg(p), 6) AS p_mean, round(stddev_pop(p), 6) AS p_std, min(p) AS p_min, max(p) AS p_max, " + ", ".join(f"round(quantile_cont(p, {q}), 6) AS p_p{int(round(q * 100)):02d}" for q in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM pp GROUP BY 1"))
def _(spark, sf):
    return rounded(one_sided(spark, sf).groupBy("y").agg(*[c.alias(k) for k, c in M.summary(F.col("p"), "p").items()]))


GRID = [round(0.05 * k, 2) for k in range(1, 20)]
SWEEP = ", g(threshold) AS (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in GRID) + "), sw AS (SELECT threshold, count(CASE WHEN p >= threshold AND y = 1 THEN 1 END) AS tp, count(CASE WHEN p >= threshold AND y = 0 THEN 1 END) AS fp, count(CASE WHEN p < threshold AND y = 0 THEN 1 END) AS tn, count(CASE WHEN p < threshold AND y = 1 THEN 1 END) AS fn FROM pp, g GROUP BY 1), sx AS (SELECT *, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS balanced_accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision_up, coalesce(tp / nullif(tp + fn, 0), 0) AS recall_up, tp + fp + tn + fn AS samples, (tp + tn) / (tp + fp + tn + fn) AS accuracy, coalesce(tn / nullif(tn + fn, 0), 0) AS precision_down, coalesce(tn / nullif(tn + fp, 0), 0) AS recall_down, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_up, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f1_down, 100 * (tp + fp) / (tp + fp + tn + fn) AS predicted_up_pct, 100 * (tn + fn) / (tp + fp + tn + fn) AS predicted_down_pct FROM sw)"
SWEPT = "threshold, tp, fp, tn, fn, round(balanced_accuracy, 6) AS balanced_accuracy, round(precision_up, 6) AS precision_up, round(recall_up, 6) AS recall_up, samples, round(accuracy, 6) AS accuracy, round(precision_down, 6) AS precision_down, round(recall_down, 6) AS recall_down, round(f1_up, 6) AS f1_up, round(f1_down, 6) AS f1_down, round((f1_up + f1_down) / 2, 6) AS macro_f1, round(predicted_up_pct, 6) AS predicted_up_pct, round(predicted_down_pct, 6) AS predicted_down_pct"


@query("A28_threshold_sweep", sql("pp", SWEEP + f" SELECT {SWEPT} FROM sx"))
def _(spark, sf):
    return rounded(M.threshold_sweep(one_sided(spark, sf), "y", "p", GRID))


@query("A28_best_threshold", sql("pp", SWEEP + f" SELECT {SWEPT} FROM sx ORDER BY round(sx.balanced_accuracy, 12) DESC, round(abs(threshold - 0.5), 9), threshold LIMIT 1"))
def _(spark, sf):
    return rounded(M.best_threshold(M.threshold_sweep(one_sided(spark, sf), "y", "p", GRID)))


@query("A29_calibration", sql("pp", "SELECT least(floor(p * 20), 19)::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_probability, round(avg(y), 6) AS observed_rate FROM pp GROUP BY 1"))
def _(spark, sf):
    return rounded(M.calibration(one_sided(spark, sf), "y", "p"))


@query("A30_precision_at_coverage", sql("pp", ", k AS (SELECT CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END AS r, (p >= 0.5)::INT AS up, row_number() OVER (ORDER BY round(abs(p - 0.5), 12) DESC, l_orderkey, l_linenumber) AS k, count(*) OVER () AS c FROM pp), g(coverage) AS (VALUES (0.00000001::DOUBLE), (0.01::DOUBLE), (0.1::DOUBLE), (0.5::DOUBLE)) SELECT coverage, count(*) AS n, round(avg(r), 6) AS precision, round(100 * avg(up), 6) AS predicted_up_pct FROM k, g WHERE k <= floor(c * coverage) GROUP BY 1"))
def _(spark, sf):
    return rounded(M.precision_at_coverage(one_sided(spark, sf), "y", "p", [1e-8, 0.01, 0.1, 0.5], ["l_orderkey", "l_linenumber"]))


@query("A40_binary_by_month", sql("pp", "SELECT month, " + class_sql((0, 1), "y", "(p >= 0.5)::INT") + " FROM pp GROUP BY 1"))
def _(spark, sf):
    d = one_sided(spark, sf).withColumn("said", (F.col("p") >= 0.5).cast("int"))
    return rounded(d.groupBy("month").agg(*[c.alias(k) for k, c in M.classification([0, 1], "y", "said").items()]))


@query("A24_monthly_stability", sql("pp", ", m AS (SELECT month, (count(CASE WHEN y = 1 AND p >= 0.5 THEN 1 END) / nullif(count(CASE WHEN y = 1 THEN 1 END), 0) + count(CASE WHEN y = 0 AND p < 0.5 THEN 1 END) / nullif(count(CASE WHEN y = 0 THEN 1 END), 0)) / 2 AS ba FROM pp GROUP BY 1) SELECT count(*) AS months, round(avg(ba), 6) AS mean, round(median(ba), 6) AS median, round(min(ba), 6) AS min, round(max(ba), 6) AS max, count(CASE WHEN ba >= 0.5 THEN 1 END) AS over_50, count(CASE WHEN ba >= 0.6 THEN 1 END) AS over_60 FROM m WHERE ba IS NOT NULL"))
def _(spark, sf):
    d = one_sided(spark, sf).withColumn("said", (F.col("p") >= 0.5).cast("int"))
    both = F.min("y") != F.max("y")
    m = d.groupBy("month").agg(M.classification([0, 1], "y", "said")["balanced_accuracy"].alias("ba"), both.alias("both")).where("both")
    return rounded(m.agg(F.count("*").alias("months"), F.avg("ba").alias("mean"), F.median("ba").alias("median"), F.min("ba").alias("min"), F.max("ba").alias("max"), F.count_if(F.col("ba") >= 0.5).alias("over_50"), F.count_if(F.col("ba") >= 0.6).alias("over_60")))


@query("A41_regression", sql("pp", "SELECT round(avg(abs(actual - predicted)), 6) AS mae, round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse, round(avg(abs(actual)), 6) AS zero_mae, round(avg(CASE WHEN sign(actual) = sign(predicted) THEN 1 ELSE 0 END), 6) AS sign_accuracy FROM pp"))
def _(spark, sf):
    return rounded(one_sided(spark, sf).agg(*[c.alias(k) for k, c in M.regression("actual", "predicted").items()]))


@query("A43_run_delta", sql("pp", "SELECT a.n AS n_a, b.n AS n_b, round(b.acc - a.acc, 6) AS delta_accuracy FROM (SELECT count(*) AS n, avg(CASE WHEN truth = pred THEN 1 ELSE 0 END) AS acc FROM pp WHERE grp = 'A') a, (SELECT count(*) AS n, avg(CASE WHEN truth = pred THEN 1 ELSE 0 END) AS acc FROM pp WHERE grp = 'R') b"))
def _(spark, sf):
    d = classes(spark, sf)
    one = lambda g, s: d.where(F.col("grp") == g).agg(F.count("*").alias(f"n_{s}"), F.avg((F.col("truth") == F.col("pred")).cast("double")).alias(f"acc_{s}"))
    return rounded(one("A", "a").join(one("R", "b")).select("n_a", "n_b", (F.col("acc_b") - F.col("acc_a")).alias("delta_accuracy")))


SCAN_SETS = [[], ["grp"], ["l_linestatus"], ["grp", "l_linestatus"]]


@query("A22_atr_scan", sql("pp", ", g(multiplier) AS (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)), c AS (SELECT *, CASE WHEN round(actual, 9) < -multiplier * 0.031 THEN -1 WHEN round(actual, 9) > multiplier * 0.031 THEN 1 ELSE 0 END AS c FROM pp, g) SELECT CASE WHEN grouping(grp) = 1 AND grouping(l_linestatus) = 1 THEN 'multiplier' WHEN grouping(l_linestatus) = 1 THEN 'multiplier+grp' WHEN grouping(grp) = 1 THEN 'multiplier+l_linestatus' ELSE 'multiplier+grp+l_linestatus' END AS level, multiplier, grp, l_linestatus, count(*) AS samples, round(avg(CASE WHEN c = -1 THEN 1 ELSE 0 END), 6) AS down, round(avg(CASE WHEN c = 0 THEN 1 ELSE 0 END), 6) AS neutral, round(avg(CASE WHEN c = 1 THEN 1 ELSE 0 END), 6) AS up, count(*) >= 1000 AS stable FROM c GROUP BY GROUPING SETS ((multiplier), (multiplier, grp), (multiplier, l_linestatus), (multiplier, grp, l_linestatus))"))
def _(spark, sf):
    d = one_sided(spark, sf).withColumns({"r": F.round("actual", 9), "atr": F.lit(0.031), "close": F.lit(1.0)})
    return rounded(M.atr_scan(d, "r", "atr", "close", [0.5, 0.75, 1.0], SCAN_SETS))


@query("A23_granularity", sql("rr", "SELECT session, count(r1) AS n, round(avg(CASE WHEN r1 = 0 THEN 1.0 WHEN r1 IS NOT NULL THEN 0.0 END), 6) AS zero_share, round(min(abs(r1)) FILTER (r1 <> 0), 6) AS least, round(quantile_cont(CASE WHEN r1 <> 0 THEN abs(r1) END, 0.1), 6) AS p10, round(quantile_cont(CASE WHEN r1 <> 0 THEN abs(r1) END, 0.9), 6) AS p90, round(median(close), 6) AS median_close FROM rr GROUP BY 1"))
def _(spark, sf):
    r = F.col("f_1m_log_return_1")
    big = F.when(r != 0, F.abs(r))
    return rounded(returns(spark, sf).groupBy("session").agg(F.count(r).alias("n"), F.avg((r == 0).cast("double")).alias("zero_share"), F.min(big).alias("least"), F.percentile(big, F.lit(0.1)).alias("p10"), F.percentile(big, F.lit(0.9)).alias("p90"), F.percentile("close", F.lit(0.5)).alias("median_close")))


@query("A16_moments", "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(var_pop(l_extendedprice), 1) AS var_pop FROM lineitem GROUP BY 1")
def _(spark, sf):
    x = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.var_pop(x), 1).alias("var_pop"))


@query("A31_profile", "SELECT feature, count(x) AS n_finite, count(*) - count(x) AS n_missing, 0::BIGINT AS n_pos_inf, 0::BIGINT AS n_neg_inf, round(min(x), 6) AS min, round(quantile_cont(x, 0.01), 6) AS p01, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.99), 6) AS p99, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT 'l_discount' AS feature, l_discount AS x FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY 1")
def _(spark, sf):
    return rounded(M.profile(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))


@query("A14_availability", sql("rr", "SELECT 'r1' AS feature, count(r1) AS n_finite, count(*) - count(r1) AS n_missing FROM rr UNION ALL SELECT 'r5', count(r5), count(*) - count(r5) FROM rr"))
def _(spark, sf):
    d = returns(spark, sf).select(F.col("f_1m_log_return_1").alias("r1"), F.col("f_1m_log_return_5").alias("r5"))
    return M.profile(d, ["r1", "r5"]).select("feature", "n_finite", "n_missing")


@query("A15_continuity_counts", sql("cb", "SELECT " + ", ".join(f"count(CASE WHEN is_usable AND contiguous_history >= {n} THEN 1 END) AS at_least_{n}" for n in (2, 4, 8)) + " FROM cb"))
def _(spark, sf):
    from .data import segmented

    return segmented(spark, sf).agg(*[F.count_if(F.col("is_usable") & (F.col("contiguous_history") >= n)).alias(f"at_least_{n}") for n in (2, 4, 8)])


@query("A32_spearman", "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS l_quantity, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS l_extendedprice, rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2 AS l_tax FROM lineitem) SELECT 'l_quantity' AS left, 'l_extendedprice' AS right, round(corr(l_quantity, l_extendedprice), 6) AS rho, round(abs(corr(l_quantity, l_extendedprice)), 6) AS strength FROM r UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6), round(abs(corr(l_quantity, l_tax)), 6) FROM r UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6), round(abs(corr(l_extendedprice, l_tax)), 6) FROM r")
def _(spark, sf):
    return rounded(M.spearman_pairs(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]))


@query("A32_spearman_pairwise", "WITH t AS (SELECT CASE WHEN l_linenumber % 3 > 0 THEN l_quantity END AS q, CASE WHEN l_linenumber % 2 > 0 THEN l_tax END AS t, CASE WHEN l_linenumber = 7 AND l_quantity < 5 THEN l_discount END AS d FROM lineitem), v AS (SELECT 'q' AS a, 't' AS b, q AS x, t AS y FROM t UNION ALL SELECT 'q', 'd', q, d FROM t UNION ALL SELECT 't', 'd', t, d FROM t), o AS (SELECT * FROM v WHERE x IS NOT NULL AND y IS NOT NULL), r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS x, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS y FROM o), c AS (SELECT a, b, CASE WHEN count(*) >= (SELECT greatest(100, least(5000, count(*) // 10)) FROM lineitem) THEN corr(x, y) END AS rho FROM r GROUP BY 1, 2) SELECT a AS left, b AS right, round(rho, 6) AS rho, round(abs(rho), 6) AS strength FROM c")
def _(spark, sf):
    n = F.col("l_linenumber")
    d = table(spark, sf, "lineitem").select(F.when(n % 3 > 0, F.col("l_quantity")).alias("q"), F.when(n % 2 > 0, F.col("l_tax")).alias("t"), F.when((n == 7) & (F.col("l_quantity") < 5), F.col("l_discount")).alias("d"))
    return rounded(M.spearman_pairs(d, ["q", "t", "d"]))


@query("A33_missing_by_month", sql("rr", "SELECT strftime(datetime, '%Y-%m') AS month, feature, round(avg(CASE WHEN x IS NULL THEN 100.0 ELSE 0.0 END), 6) AS missing_percent FROM (SELECT datetime, 'r1' AS feature, r1 AS x FROM rr UNION ALL SELECT datetime, 'r5', r5 FROM rr) GROUP BY 1, 2"))
def _(spark, sf):
    d = returns(spark, sf).select(F.date_format("datetime", "yyyy-MM").alias("month"), F.col("f_1m_log_return_1").alias("r1"), F.col("f_1m_log_return_5").alias("r5"))
    return rounded(d.unpivot(["month"], ["r1", "r5"], "feature", "x").groupBy("month", "feature").agg(F.avg(F.when(F.col("x").isNull(), 100.0).otherwise(0.0)).alias("missing_percent")))


@query("A5_null_sums", "SELECT c_nationkey, sum(CASE WHEN c_acctbal > 9000 THEN c_acctbal::DECIMAL(18,2) END)::DOUBLE AS total FROM customer GROUP BY 1")
def _(spark, sf):
    big = F.when(F.col("c_acctbal") > 9000, F.col("c_acctbal").cast("decimal(18,2)"))
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.sum(big).cast("double").alias("total"))


@query("A2_first_last_valid", sql("sb", "SELECT symbol, trading_date, first(close ORDER BY datetime) FILTER (close IS NOT NULL) AS first_close, last(close ORDER BY datetime) FILTER (close IS NOT NULL) AS last_close FROM sb GROUP BY 1, 2"))
def _(spark, sf):
    from .data import bars

    at = F.when(F.col("close").isNotNull(), F.col("datetime"))
    return bars(spark, sf).groupBy("symbol", "trading_date").agg(F.min_by("close", at).alias("first_close"), F.max_by("close", at).alias("last_close"))


@query("A3_wap", sql("ss", "SELECT symbol, trading_date, round(sum(wap * volume) / sum(volume), 6) AS wap FROM ss WHERE volume > 0 GROUP BY 1, 2"))
def _(spark, sf):
    return rounded(with_windows(raw_bars(spark, sf)).where("volume > 0").groupBy("symbol", "trading_date").agg(F.try_divide(F.sum(F.col("wap") * F.col("volume")), F.sum("volume")).alias("wap")))


@query("A44_report", sql("pp", "SELECT grp, count(*) AS n, round(quantile_cont(actual, 0.25), 6) AS p25, round(quantile_cont(actual, 0.5), 6) AS p50, round(quantile_cont(actual, 0.75), 6) AS p75 FROM pp GROUP BY 1"))
def _(spark, sf):
    return rounded(one_sided(spark, sf).groupBy("grp").agg(F.count("*").alias("n"), *[F.percentile("actual", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)]))


@query("M3_majority", sql("pp", ", m AS (SELECT truth AS top FROM pp WHERE grp = 'A' GROUP BY 1 ORDER BY count(*) DESC, truth LIMIT 1) SELECT truth, top AS pred, count(*) AS n FROM pp, m WHERE grp <> 'A' GROUP BY 1, 2"))
def _(spark, sf):
    d = classes(spark, sf)
    w = Window.orderBy(F.desc("n"), "truth")
    top = d.where("grp = 'A'").groupBy("truth").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("truth").alias("top"))
    return d.where("grp <> 'A'").join(F.broadcast(top)).groupBy("truth", F.col("top").alias("pred")).agg(F.count("*").alias("n"))
