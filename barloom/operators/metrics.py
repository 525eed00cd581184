"""Evaluation metrics as grouped aggregations.

Every bundle takes grouping columns; one pass serves all groups, and several
grouping sets go through one ``GROUPING SETS`` plan (an expand before one
partial aggregate), not through one job each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .windows import prefix_sum


def ratio0(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0."""
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over several groupings at once; a column that is not in a
    set is NULL, and ``level`` names the set."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    named = F.array(*[F.struct(F.lit("+".join(s) or "all").alias("level"), *[(F.col(c) if c in s else F.lit(None).cast(df.schema[c].dataType)).alias(f"_g_{c}") for c in columns]) for s in sets])
    d = df.withColumn("_s", F.explode(named))
    keys = [F.col("_s.level").alias("level"), *[F.col(f"_s._g_{c}").alias(c) for c in columns]]
    return d.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])


def confusion(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), truth, predicted).agg(F.count("*").alias("n"))


def classification(classes: list, truth: str, predicted: str, supported_only: bool = False) -> dict[str, Column]:
    """Accuracy, balanced accuracy, macro F1, and precision, recall, F1 of each
    class, as aggregates; what has no denominator is 0. ``supported_only``
    averages over classes that occur."""
    t, p = F.col(truth), F.col(predicted)
    out = {"n_rows": F.count("*"), "accuracy": ratio0(F.count_if(t == p), F.count("*"))}
    recalls, f1s, held = [], [], []
    for c in classes:
        hit, real, said = F.count_if((t == c) & (p == c)), F.count_if(t == c), F.count_if(p == c)
        precision, recall = ratio0(hit, said), ratio0(hit, real)
        f1 = ratio0(2 * precision * recall, precision + recall)
        name = str(c).replace("-", "m")
        out |= {f"precision_{name}": precision, f"recall_{name}": recall, f"f1_{name}": f1, f"support_{name}": real}
        recalls.append(recall)
        f1s.append(f1)
        held.append((real > 0).cast("int"))
    n = sum(held[1:], held[0]) if supported_only else F.lit(len(classes))
    out["balanced_accuracy"] = ratio0(sum(recalls[1:], recalls[0]), n)
    out["macro_f1"] = ratio0(sum((f * h for f, h in zip(f1s[1:], held[1:], strict=True)), f1s[0] * held[0]) if supported_only else sum(f1s[1:], f1s[0]), n)
    return out


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Rows, share and balanced weight n / (k * count) of each class."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, k = F.sum("n").over(every), F.count("*").over(every)
    return c.select(label, "n", (F.col("n") / total).alias("share"), (total / (k * F.col("n"))).alias("weight"))


def roc_auc(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Exact AUC with average ranks of ties. Rows are first reduced to counts
    per distinct score, then ranked by prefix sums; NULL without both classes."""
    by = by or []
    c = df.groupBy(*by, score).agg(F.count("*").alias("_n"), F.sum(F.col(y).cast("long")).alias("_p"))
    c = prefix_sum(c, [score], F.col("_n"), "_before", by).withColumn("_rank", F.col("_before") + (F.col("_n") + 1) / 2.0)
    pos, n = F.sum("_p"), F.sum("_n")
    u = F.sum(F.col("_p") * F.col("_rank")) - pos * (pos + 1) / 2.0
    return c.groupBy(*by).agg(F.try_divide(u, (pos * (n - pos)).cast("double")).alias("auc"))


def probability(y: str, p: str, eps: float = 1e-7) -> dict[str, Column]:
    """Brier score and log loss."""
    t, q = F.col(y).cast("double"), F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return {"brier": F.avg((F.col(p) - t) * (F.col(p) - t)), "log_loss": F.avg(-(t * F.ln(q) + (1 - t) * F.ln(1 - q)))}


def summary(c: Column, name: str, quantiles: tuple[float, ...] = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> dict[str, Column]:
    """Mean, deviation, range and interpolated quantiles."""
    out = {f"{name}_mean": F.avg(c), f"{name}_std": F.stddev_pop(c), f"{name}_min": F.min(c), f"{name}_max": F.max(c)}
    return out | {f"{name}_p{int(round(q * 100)):02d}": F.percentile(c, F.lit(q)) for q in quantiles}


def threshold_sweep(df: DataFrame, y: str, p: str, thresholds: list[float]) -> DataFrame:
    """Binary metrics at every threshold: each row goes to the number of
    (ascending) thresholds it passes, so one count per step serves all of them."""
    t = F.col(y) == 1
    thresholds = sorted(thresholds)
    grid = F.array(*[F.lit(x) for x in thresholds])
    passed = sum(((F.col(p) >= x).cast("int") for x in thresholds), F.lit(0))
    steps = df.groupBy(passed.alias("_k")).agg(F.count_if(t).alias("_p"), F.count_if(~t).alias("_n"))
    spread = steps.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(thresholds) - 1))))
    up = F.col("_k") > F.col("_i")
    m = spread.groupBy("_i").agg(F.sum(F.when(up, F.col("_p")).otherwise(0)).alias("tp"), F.sum(F.when(up, F.col("_n")).otherwise(0)).alias("fp"), F.sum(F.when(~up, F.col("_n")).otherwise(0)).alias("tn"), F.sum(F.when(~up, F.col("_p")).otherwise(0)).alias("fn"))
    n = F.col
    # a class without rows has no recall, and so no balanced accuracy
    share = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(float("nan")))
    all_ = n("tp") + n("fp") + n("tn") + n("fn")
    recall_up, recall_down = share(n("tp"), n("tp") + n("fn")), share(n("tn"), n("tn") + n("fp"))
    f1_up, f1_down = (ratio0(2 * n(x), 2 * n(x) + n("fp") + n("fn")) for x in ("tp", "tn"))
    return m.select(
        F.element_at(grid, (n("_i") + 1).cast("int")).alias("threshold"), "tp", "fp", "tn", "fn", ((recall_up + recall_down) / 2).alias("balanced_accuracy"),
        ratio0(n("tp"), n("tp") + n("fp")).alias("precision_up"), recall_up.alias("recall_up"), all_.alias("samples"), share(n("tp") + n("tn"), all_).alias("accuracy"),
        ratio0(n("tn"), n("tn") + n("fn")).alias("precision_down"), recall_down.alias("recall_down"), f1_up.alias("f1_up"), f1_down.alias("f1_down"), ((f1_up + f1_down) / 2).alias("macro_f1"),
        (100 * share(n("tp") + n("fp"), all_)).alias("predicted_up_pct"), (100 * share(n("tn") + n("fn"), all_)).alias("predicted_down_pct"),
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Highest balanced accuracy; ties go to the nearest to 0.5, then the lowest."""
    return sweep.orderBy(F.round(F.nanvl("balanced_accuracy", F.lit(-1.0)), 12).desc(), F.round(F.abs(F.col("threshold") - 0.5), 9), "threshold").limit(1)


def calibration(df: DataFrame, y: str, p: str, bins: int = 20) -> DataFrame:
    """Fixed bins; the last one is closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_probability"), F.avg(F.col(y).cast("double")).alias("observed_rate"))


def precision_at_coverage(df: DataFrame, y: str, p: str, coverages: list[float], key: list[str]) -> DataFrame:
    """Share of right signs, and percent called up, among the floor(n * c) rows
    that are most confident; ties go by ``key``. A coverage of less than one row
    has no result.

    Rows are counted per confidence, and the counts are summed in order; single
    rows are ordered only where a coverage ends within rows of one confidence.
    """
    unsure = -F.round(F.abs(F.col(p) - 0.5), 12)
    up = (F.col(p) >= 0.5).cast("int")
    rows = df.select(unsure.alias("_u"), up.alias("_up"), (up == F.col(y)).cast("int").alias("_r"), *key)
    sums = lambda n, r, u: [n.alias("n"), r.alias("_right"), u.alias("_ups")]
    steps = rows.groupBy("_u").agg(*sums(F.count("*"), F.sum("_r"), F.sum("_up")))
    steps = prefix_sum(steps, ["_u"], F.col("n"), "_before")
    takes = df.agg(F.count("*").alias("_all")).select("_all", F.explode(F.array(*[F.lit(float(c)) for c in coverages])).alias("coverage"))
    takes = F.broadcast(takes.select("coverage", F.floor(F.col("_all") * F.col("coverage")).alias("_take")).where("_take > 0"))  # a row a coverage
    met = steps.join(takes, F.col("_before") < F.col("_take"))
    whole = met.where(F.col("_before") + F.col("n") <= F.col("_take")).select("coverage", "n", "_right", "_ups")
    # the one confidence of each coverage that is cut
    cut = met.where(F.col("_before") + F.col("n") > F.col("_take")).select("coverage", F.col("_u").alias("_cut"), (F.col("_take") - F.col("_before")).alias("_some"))
    tied = rows.join(F.broadcast(cut.select(F.col("_cut").alias("_u")).distinct()), "_u", "left_semi")
    tied = prefix_sum(tied, key, F.lit(1), "_k", by=["_u"])
    part = tied.join(F.broadcast(cut), (F.col("_u") == F.col("_cut")) & (F.col("_k") < F.col("_some"))).select("coverage", F.lit(1).cast("long").alias("n"), F.col("_r").alias("_right"), F.col("_up").alias("_ups"))
    both = whole.unionByName(part).groupBy("coverage").agg(F.sum("n").alias("n"), F.sum("_right").alias("_right"), F.sum("_ups").alias("_ups"))
    return both.select("coverage", "n", (F.col("_right") / F.col("n")).alias("precision"), (100 * F.col("_ups") / F.col("n")).alias("predicted_up_pct"))


def regression(actual: str, predicted: str) -> dict[str, Column]:
    """MAE, RMSE, MAE of always saying 0, share of right signs."""
    a, p = F.col(actual), F.col(predicted)
    return {"mae": F.avg(F.abs(a - p)), "rmse": F.sqrt(F.avg((a - p) * (a - p))), "zero_mae": F.avg(F.abs(a)), "sign_accuracy": F.avg((F.signum(a) == F.signum(p)).cast("double"))}


def atr_scan(df: DataFrame, value: str, atr: str, close: str, multipliers: list[float], sets: list[list[str]], least: int = 1000) -> DataFrame:
    """Class shares under each multiplier of the band, over grouping sets."""
    d = df.withColumn("multiplier", F.explode(F.array(*[F.lit(m) for m in multipliers])))
    tau, r = F.col("multiplier") * F.try_divide(F.col(atr), F.col(close)), F.col(value)
    d = d.withColumn("_c", F.when(r < -tau, -1).when(r > tau, 1).otherwise(0))
    share = lambda c: F.avg((F.col("_c") == c).cast("double"))
    out = grouping_sets(d, [["multiplier", *s] for s in sets], {"samples": F.count("*"), "down": share(-1), "neutral": share(0), "up": share(1)})
    return out.withColumn("stable", F.col("samples") >= least)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, missing, infinite, range, quantiles, mean,
    deviation. One wide aggregate, turned afterwards."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        ok = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)
        aggs.append(F.struct(F.lit(c).alias("feature"), F.count(ok).alias("n_finite"), F.count_if(x.isNull() | F.isnan(x)).alias("n_missing"), F.count_if(x == float("inf")).alias("n_pos_inf"), F.count_if(x == float("-inf")).alias("n_neg_inf"), F.min(ok).alias("min"), F.percentile(ok, F.lit(0.01)).alias("p01"), F.percentile(ok, F.lit(0.5)).alias("p50"), F.percentile(ok, F.lit(0.99)).alias("p99"), F.max(ok).alias("max"), F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("std")).alias(f"_{c}"))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"_{c}") for c in columns])).alias("r")).select("r.*")


def scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, mean, scale, constant`` over the given (train) rows; a scale
    that is 0 or not finite becomes 1. Partial and final moments are Spark's."""
    one = df.agg(*[F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("_s")).alias(f"_{c}") for c in columns])
    s = F.col("_s")
    good = F.coalesce(s.isNotNull() & ~F.isnan(s) & (s > 0) & (s < float("inf")), F.lit(False))
    return one.select(F.explode(F.array(*[F.col(f"_{c}") for c in columns])).alias("r")).select("r.*").select("feature", "mean", F.when(good, s).otherwise(1.0).alias("scale"), (~good).alias("constant"))


def scaled(df: DataFrame, fitted: DataFrame, columns: list[str], narrow: bool = False) -> DataFrame:
    """(x - mean) / scale; the scaler is one row after turning, so it is broadcast."""
    wide = fitted.agg(*[F.max(F.when(F.col("feature") == c, F.struct("mean", "scale"))).alias(f"_{c}") for c in columns])
    d = df.join(F.broadcast(wide))
    made = {c: (F.col(c) - F.col(f"_{c}.mean")) / F.col(f"_{c}.scale") for c in columns}
    return d.withColumns({c: x.cast("float") if narrow else x for c, x in made.items()}).drop(*[f"_{c}" for c in columns])


def average_ranks(counts: DataFrame, c: str, n: str) -> DataFrame:
    """``c, rank`` of each value, given how many rows hold it; ties share their
    mean rank."""
    one = counts.groupBy(c).agg(F.sum(n).alias("_n"))
    return prefix_sum(one, [c], F.col("_n"), "_before").select(c, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(f"_rank_{c}"))


def spearman_pairs(df: DataFrame, columns: list[str], least: int | None = None) -> DataFrame:
    """Rank correlation of all pairs: ``left, right, rho, strength``. Each pair is
    ranked over the rows where both are there; with fewer than ``least`` of them
    (a tenth of all rows, 100 to 5000) ``rho`` is NULL. Rows are counted per pair
    of values first, so frequent values (zeros) are one row of the joins."""
    enough = df.agg(F.greatest(F.lit(100), F.least(F.lit(5000), F.floor(F.count("*") / 10))).alias("_least"))
    if least is not None:
        enough = enough.select(F.lit(least).alias("_least"))
    out = []
    for k, a in enumerate(columns):
        for b in columns[k + 1 :]:
            counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)).groupBy(a, b).agg(F.count("*").alias("_m"))
            ranked = counts.join(average_ranks(counts, a, "_m"), a).join(average_ranks(counts, b, "_m"), b)
            m, x, y = F.col("_m"), F.col(f"_rank_{a}"), F.col(f"_rank_{b}")
            sums = ranked.agg(F.sum(m).alias("n"), F.sum(m * x).alias("x"), F.sum(m * y).alias("y"), F.sum(m * x * x).alias("xx"), F.sum(m * y * y).alias("yy"), F.sum(m * x * y).alias("xy"))
            n = F.col("n")
            spread = F.sqrt((n * F.col("xx") - F.col("x") * F.col("x")) * (n * F.col("yy") - F.col("y") * F.col("y")))
            rho = F.try_divide(n * F.col("xy") - F.col("x") * F.col("y"), spread)
            out.append(sums.join(F.broadcast(enough)).select(F.lit(a).alias("left"), F.lit(b).alias("right"), F.when(n >= F.col("_least"), rho).alias("rho")))  # one row each
    return reduce(DataFrame.unionByName, out).withColumn("strength", F.abs("rho"))
