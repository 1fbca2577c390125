"""Evaluation: confusion, exact ROC-AUC, threshold sweeps, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of scores that cumulative counts are made in.
RANGES = 200


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def over(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def confusion(label: str = "label", pred: str = "pred") -> list[Column]:
    y, p = F.col(label), F.col(pred)
    return [_sum((y == 1) & (p == 1)).alias("tp"), _sum((y == 0) & (p == 1)).alias("fp"), _sum((y == 1) & (p == 0)).alias("fn"), _sum((y == 0) & (p == 0)).alias("tn")]


def rates(df: DataFrame) -> DataFrame:
    """Adds rows, accuracy, precision, recall and f1 to confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({"rows": tp + fp + fn + tn, "accuracy": over(tp + tn, tp + fp + fn + tn), "precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "f1": over(2 * tp, 2 * tp + fp + fn)})


def metrics(df: DataFrame, by: list[str] | None = None, label: str = "label", pred: str = "pred") -> DataFrame:
    return rates(df.groupBy(*(by or [])).agg(*confusion(label, pred)))


def _cumulative(df: DataFrame, per: DataFrame, by: list[str], key: str, p: str, columns: list[str], descending: bool) -> DataFrame:
    """per, one row for each score of a group, with the sums of columns over all scores up to each one, as c_<column>.

    Scores fall into ranges between quantiles of df's p, which a few hundred numbers tell; a window passes over a range's scores, and another over the ranges' totals.
    """
    cuts = sorted({x for x in df.agg(F.percentile_approx(p, [k / RANGES for k in range(1, RANGES)], 10_000)).first()[0] or []})
    per = per.withColumn("range_", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col(key))) if cuts else F.lit(0))
    order = F.desc if descending else F.asc
    totals = per.groupBy(*by, "range_").agg(*(F.sum(c).alias(f"t_{c}") for c in columns))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order("range_")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range_", *(F.col(g).alias(f"g_{g}") for g in by), *(F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0)).alias(f"b_{c}") for c in columns)).withColumnRenamed("range_", "of_")
    local = Window.partitionBy(*by, "range_").orderBy(order(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = per.withColumns({f"c_{c}": F.sum(c).over(local) for c in columns})
    match = F.col("range_") == F.col("of_")
    for g in by:
        match = match & F.col(g).eqNullSafe(F.col(f"g_{g}"))
    out = own.join(totals, match).withColumns({f"c_{c}": F.col(f"c_{c}") + F.col(f"b_{c}") for c in columns})
    return out.drop("range_", "of_", *(f"g_{g}" for g in by), *(f"b_{c}" for c in columns))


def roc_auc(df: DataFrame, by: list[str] | None = None, label: str = "label", p: str = "p") -> DataFrame:
    """Exact area under the curve with ties, null where a class is missing: Mann-Whitney from counts of equal scores.

    Rows are first counted by score, and no window passes over more than a range of distinct scores.
    """
    by = by or []
    per = df.groupBy(*by, F.col(p).alias("p_")).agg(_sum(F.col(label) == 1).alias("pos_"), _sum(F.col(label) == 0).alias("neg_"))
    per = _cumulative(df, per, by, "p_", p, ["neg_"], False).withColumn("below_", F.col("c_neg_") - F.col("neg_"))
    out = per.groupBy(*by).agg(F.sum(F.col("pos_") * (F.col("below_") + F.col("neg_") / F.lit(2.0))).alias("u_"), F.sum("pos_").alias("np_"), F.sum("neg_").alias("nn_"))
    auc = F.when((F.col("np_") > 0) & (F.col("nn_") > 0), F.col("u_") / (F.col("np_").cast("double") * F.col("nn_")))
    return out.select(*by, auc.alias("roc_auc"))


def sweep(df: DataFrame, by: list[str] | None = None, label: str = "label", p: str = "p") -> DataFrame:
    """Metrics at every distinct score as threshold (p >= threshold), from cumulative counts of ranges of scores."""
    by = by or []
    per = df.groupBy(*by, F.col(p).alias("threshold")).agg(_sum(F.col(label) == 1).alias("pos_"), _sum(F.col(label) == 0).alias("neg_"))
    own = _cumulative(df, per, by, "threshold", p, ["pos_", "neg_"], True)
    all_ = df.groupBy(*by).agg(_sum(F.col(label) == 1).alias("np_"), _sum(F.col(label) == 0).alias("nn_")).select(*(F.col(g).alias(f"g_{g}") for g in by), "np_", "nn_")
    if by:
        match = F.lit(True)
        for g in by:
            match = match & F.col(g).eqNullSafe(F.col(f"g_{g}"))
        own = own.join(all_, match).drop(*(f"g_{g}" for g in by))
    else:
        own = own.crossJoin(F.broadcast(all_))
    own = own.select(*by, "threshold", F.col("c_pos_").alias("tp"), F.col("c_neg_").alias("fp"), (F.col("np_") - F.col("c_pos_")).alias("fn"), (F.col("nn_") - F.col("c_neg_")).alias("tn"))
    return rates(own)


def at_grid(df: DataFrame, thresholds: DataFrame, by: list[str] | None = None, label: str = "label", p: str = "p") -> DataFrame:
    """Metrics at given thresholds, a small one-column table.

    Rows are counted by the number of thresholds they reach; cumulative sums over the grid then give each threshold's counts. The rows are
    not multiplied by the grid.
    """
    by = by or []
    grid = sorted(r[0] for r in thresholds.distinct().collect())
    level = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: F.col(p) >= t))
    per = df.groupBy(*by, level.alias("level_")).agg(_sum(F.col(label) == 1).alias("pos_"), _sum(F.col(label) == 0).alias("neg_"))
    spine = per.select(*by).distinct() if by else None
    steps = thresholds.sparkSession.createDataFrame([(k + 1, t) for k, t in enumerate(grid)], "k_ int, threshold double")
    steps = spine.crossJoin(F.broadcast(steps)) if by else steps
    both = steps.withColumn("level_", F.col("k_")).join(per, [*by, "level_"], "left").na.fill(0, ["pos_", "neg_"])
    rest = per.groupBy(*by).agg(F.sum("pos_").alias("np_"), F.sum("neg_").alias("nn_"))
    both = both.join(rest, by) if by else both.crossJoin(F.broadcast(rest))
    up = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("level_")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({"tp": F.sum("pos_").over(up), "fp": F.sum("neg_").over(up)})
    both = both.withColumns({"fn": F.col("np_") - F.col("tp"), "tn": F.col("nn_") - F.col("fp")})
    return rates(both.select(*by, "threshold", *(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn"))))


def best(df: DataFrame, order: list, by: list[str] | None = None) -> DataFrame:
    """The first row by order, of all or of each group."""
    if not by:
        return df.orderBy(*order).limit(1)
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("r_ = 1").drop("r_")


def operating_point(grid: DataFrame, measure: str, target: float, by: list[str] | None = None) -> DataFrame:
    """The best point that meets a target of precision or recall, or the nearest to it; target_satisfied tells which."""
    other = "recall" if measure == "precision" else "precision"
    near = F.abs(F.col("threshold") - 0.5)
    ok = F.col(measure) >= target
    order = [F.desc(ok), F.desc(F.when(ok, F.col("f1")).otherwise(F.col(measure))), F.desc(F.when(ok, F.col(other)).otherwise(F.col("f1"))), F.desc(F.when(ok, F.col(measure)).otherwise(F.col(other))), F.desc("accuracy"), near, "threshold"]
    return best(grid.withColumn("target_satisfied", ok), order, by)


def histogram(df: DataFrame, by: list[str], p: str, bins: int = 10) -> DataFrame:
    """Counts in bins of [0, 1], each bin present for each group, `missing` among them."""
    from textloom.functions.taxonomy import histogram_bin

    spark = df.sparkSession
    names = [f"{k / bins:.1f}-{(k + 1) / bins:.1f}" for k in range(bins)] + ["missing"]
    spine = df.select(*by).distinct().crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in names], "bin string")))
    counts = df.groupBy(*by, histogram_bin(p, bins).alias("bin")).agg(F.count("*").alias("n"))
    return spine.join(counts, [*by, "bin"], "left").na.fill(0, ["n"])


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n / (classes * rows of the class), for each class."""
    per = df.groupBy(label).agg(F.count("*").alias("n_"))
    total = F.broadcast(per.agg(F.sum("n_").alias("t_"), F.count("*").alias("k_")))
    return per.crossJoin(total).select(label, (F.col("t_") / (F.col("k_") * F.col("n_")).cast("double")).alias("weight"))


def guard_metrics(df: DataFrame, threshold: float, by: list[str] | None = None, label: str = "label", p: str = "p") -> DataFrame:
    """Of a guard whose 1 means unsafe: protection, vetoes of safe rows and misses; rates without labelled rows are null, the veto rate is of all rows."""
    y, veto = F.col(label), F.col(p) >= threshold
    n = lambda c: _sum(F.coalesce(c, F.lit(False)))
    own = df.groupBy(*(by or [])).agg(F.count("*").alias("rows"), n(y.isin(0, 1)).alias("labelled"), n((y == 0) & ~veto).alias("safe_pass"), n((y == 0) & veto).alias("safe_veto"), n((y == 1) & ~veto).alias("unsafe_miss"), n((y == 1) & veto).alias("unsafe_veto"), F.avg(veto.cast("double")).alias("veto_rate"), F.avg(p).alias("mean_p"))
    some = F.col("labelled") > 0
    precision, recall = over(F.col("unsafe_veto"), F.col("unsafe_veto") + F.col("safe_veto")), over(F.col("unsafe_veto"), F.col("unsafe_veto") + F.col("unsafe_miss"))
    rate = {"accuracy": over(F.col("safe_pass") + F.col("unsafe_veto"), F.col("labelled")), "unsafe_precision": precision, "unsafe_recall": recall, "unsafe_f1": F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0), "safe_veto_rate": over(F.col("safe_veto"), F.col("safe_pass") + F.col("safe_veto")), "unsafe_miss_rate": over(F.col("unsafe_miss"), F.col("unsafe_miss") + F.col("unsafe_veto"))}
    return own.withColumns({k: F.when(some, v) for k, v in rate.items()})


def selector_metrics(df: DataFrame, threshold: float, by: list[str] | None = None, label: str = "label", p: str = "p") -> DataFrame:
    """Of a selector whose 1 means safe: rates of passing and blocking, null where there is nothing to pass or block."""
    y, ok = F.col(label), F.col(p) >= threshold
    own = df.groupBy(*(by or [])).agg(_sum((y == 1) & ok).alias("safe_pass"), _sum((y == 1) & ~ok).alias("safe_block"), _sum((y == 0) & ok).alias("unsafe_pass"), _sum((y == 0) & ~ok).alias("unsafe_block"), F.avg(p).alias("mean_p"))
    safe, unsafe = F.col("safe_pass") + F.col("safe_block"), F.col("unsafe_pass") + F.col("unsafe_block")
    return own.withColumns({"safe_pass_rate": F.try_divide("safe_pass", safe), "safe_block_rate": F.try_divide("safe_block", safe), "unsafe_block_rate": F.try_divide("unsafe_block", unsafe), "unsafe_pass_rate": F.try_divide("unsafe_pass", unsafe)})


def selector_threshold(df: DataFrame, thresholds: DataFrame, min_unsafe_block: float, min_safe_pass: float, label: str = "label", p: str = "p") -> DataFrame:
    """The threshold with both rates met if any has, then most safe rows passed, most unsafe ones blocked, and the lowest."""
    own = at_grid(df, thresholds, None, label, p)
    own = own.withColumns({"safe_pass_rate": F.try_divide("tp", F.col("tp") + F.col("fn")), "unsafe_block_rate": F.try_divide("tn", F.col("tn") + F.col("fp"))})
    own = own.withColumn("feasible", F.coalesce((F.col("unsafe_block_rate") >= min_unsafe_block) & (F.col("safe_pass_rate") >= min_safe_pass), F.lit(False)))
    return best(own, [F.desc("feasible"), F.desc("safe_pass_rate"), F.desc("unsafe_block_rate"), "threshold"]).select("threshold", "feasible", "safe_pass_rate", "unsafe_block_rate")
