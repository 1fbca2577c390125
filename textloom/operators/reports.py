"""Reports over selections and predictions: summaries, outcomes, case lists, targets and small arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import col, text_of
from textloom.operators import metrics as M


def summary(df: DataFrame, dims: dict[str, Column | str]) -> DataFrame:
    """(dim, value, n): how often each value of each dimension stands, `unknown` for none, in one pass."""
    parts = [F.struct(F.lit(k).alias("dim"), F.coalesce(F.when(col(c).cast("string") != "", col(c).cast("string")), F.lit("unknown")).alias("value")) for k, c in dims.items()]
    return df.select(F.explode(F.array(*parts)).alias("d")).groupBy("d.dim", "d.value").agg(F.count("*").alias("n"))


def outcomes(df: DataFrame, by: list[str], safe: Column, passed: Column) -> DataFrame:
    """What a selector passes and blocks of safe and unsafe rows; rates are null where there are none."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    own = df.groupBy(*by).agg(n(safe).alias("safe_total"), n(safe & passed).alias("safe_passed"), n(~safe).alias("unsafe_total"), n(~safe & ~passed).alias("unsafe_blocked"))
    return own.withColumns({
        "safe_blocked": F.col("safe_total") - F.col("safe_passed"), "unsafe_false_passed": F.col("unsafe_total") - F.col("unsafe_blocked"),
        "safe_pass_rate": F.try_divide("safe_passed", "safe_total"), "unsafe_block_rate": F.try_divide("unsafe_blocked", "unsafe_total"),
    })


def cases(df: DataFrame, safe: Column, passed: Column, p: str, id_: str, most: int) -> DataFrame:
    """Unsafe rows that pass, the surest first, and safe rows that are blocked, the least sure first; in the second list a probability of 0 counts as none and comes last."""
    wrong = df.where(~safe & passed).withColumn("case", F.lit("unsafe_passed")).orderBy(F.desc(F.coalesce(F.nullif(p, F.lit(0.0)), F.lit(-1.0))), id_).limit(most)
    lost = df.where(safe & ~passed).withColumn("case", F.lit("safe_blocked")).orderBy(F.coalesce(F.nullif(p, F.lit(0.0)), F.lit(2.0)), id_).limit(most)
    return wrong.unionAll(lost)


def style_guard_metrics(df: DataFrame, threshold: float, by: list[str] | None = None, label: str = "label", p: str = "p") -> DataFrame:
    """Metrics of a guard whose 1 is human style, with the share that it vetoes and its mean probability."""
    own = df.withColumn("pred", (F.col(p) >= threshold).cast("int"))
    return M.rates(own.groupBy(*(by or [])).agg(*M.confusion(label, "pred"), F.avg("pred").alias("veto_rate"), F.avg(p).alias("mean_p")))


def metric_delta(df: DataFrame, base: str, new: str) -> DataFrame:
    """One row of two runs' F1, false positives and false negatives, and what changed."""
    of = lambda run, k: M.rates(df.agg(*M.confusion("label", f"pred_{run}"))).select(F.col("f1").alias(f"{k}_f1"), F.col("fp").alias(f"{k}_fp"), F.col("fn").alias(f"{k}_fn"))
    both = of(base, "base").crossJoin(F.broadcast(of(new, "new")))
    return both.withColumns({f"{c}_delta": F.col(f"new_{c}") - F.col(f"base_{c}") for c in ("f1", "fp", "fn")})


def disjoint(splits: DataFrame, key: str, split: str = "split") -> DataFrame:
    """splits, or an error where a key stands in two of them."""
    many = splits.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k_")).agg(F.count_distinct(split).alias("n_")).where("n_ > 1").select("k_").limit(1)
    broken = F.broadcast(many.agg(F.max(F.col("k_").cast("string")).alias("broken_")))
    return splits.crossJoin(broken).withColumn(split, F.when(F.col("broken_").isNull(), F.col(split)).otherwise(F.raise_error(F.concat(F.lit("in two splits: "), "broken_")).cast("string"))).drop("broken_")


def preview(values: Column | str, most: int = 20) -> Column:
    """The first values of a list, and how many more there are."""
    v = col(values)
    more = F.when(F.size(v) > most, F.format_string(" ... (+%d more)", F.size(v) - most)).otherwise("")
    return F.when(F.size(v) == 0, "none").otherwise(F.concat(F.array_join(F.slice(v, 1, most), ", "), more))


def rough_domain(bucket: Column | str) -> Column:
    b = text_of(bucket)
    return F.when(b.startswith("poetry_"), "poetry").when(b == "academic_formal", "academic").when(b.startswith("literary_"), "literature").otherwise("general_prose")


def error_type(label: Column | str, pred: Column | str) -> Column:
    y, p = col(label), col(pred)
    return F.when((y == 0) & (p == 1), "false_positive").when((y == 1) & (p == 0), "false_negative").when((y == 1) & (p == 1), "true_positive").otherwise("true_negative")


def error_notes(error: Column | str, domain: Column | str, a: Column | str, b: Column | str, threshold: float) -> Column:
    """What an error's kind and domain say about it, and whether two branches disagree."""
    e, d = col(error), text_of(domain)
    differ = F.when(col(a).isNotNull() & col(b).isNotNull() & ((col(a) >= threshold) != (col(b) >= threshold)), "tfidf_deberta_disagree")
    by = lambda poetry, academic, old, rest: F.when(d.startswith("poetry"), poetry).when(d == "academic_formal", academic).when(d == "literary_old_prose", old).otherwise(rest)
    kind = F.when(e == "false_positive", by("human_poetry_or_fragment_fp", "formal_academic_human_fp", "old_or_ornate_human_fp", "human_style_fp")).when(e == "false_negative", by("poetry_llm_fn", "natural_academic_llm_fn", "old_fiction_style_llm_fn", "conservative_llm_rewrite_fn"))
    return F.array_join(F.array_compact(F.array(differ, kind)), ";")


def softmax(*logits: Column | str) -> list[Column]:
    """Shares of exponentials, less the largest so that none overflows."""
    cs = [col(c) for c in logits]
    top = F.greatest(*cs)
    total = reduce(lambda a, b: a + b, (F.exp(c - top) for c in cs))
    return [F.exp(c - top) / total for c in cs]


def grid(spark, start: float, stop: float, step: float) -> DataFrame:
    """(threshold) from start to stop, both within, rounded to six places."""
    n = int(round((stop - start) / step, 9))
    return spark.range(n + 1).select(F.round(F.lit(start) + F.col("id") * F.lit(step), 6).alias("threshold"))


def decision(correct: Column | str, baseline: Column | str, target: int) -> Column:
    c, b = col(correct), col(baseline)
    return F.when(c >= target, "reached").when(c > b, "partial_success").otherwise("reject")


def label_targets(counts: DataFrame, train: float, dev: float, n: str = "n") -> DataFrame:
    """counts with each label's targets: shares rounded half to even, the rest to probe."""
    own = counts.withColumns({"train": F.bround(F.col(n) * train).cast("long"), "dev": F.bround(F.col(n) * dev).cast("long")})
    return own.withColumn("probe", F.col(n) - F.col("train") - F.col("dev"))


def provisional_target(available: Column | str, min_train: int, min_dev: int, fraction: float) -> Column:
    """What dev gets while there is too little for both minimums: a share, but neither all nor nothing."""
    a = col(available)
    return F.when(a >= min_train + min_dev, F.lit(min_dev)).when(a <= 1, a).otherwise(F.greatest(F.lit(1), F.least(a - 1, F.bround(a * fraction)))).cast("long")


def missing_indicators(columns: list[str]) -> dict[str, Column]:
    """Each column's value, 0 where there is none, and whether there is one."""
    return {c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns} | {f"has_{c}": F.col(c).isNotNull().cast("double") for c in columns}


def moments(*ps: str) -> dict[str, Column]:
    """Mean, spread, extremes and mean distance from a half of some probabilities."""
    a = F.array(*ps)
    n = float(len(ps))
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    return {"p_mean": mean, "p_std": F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n), "p_max": F.greatest(*ps), "p_min": F.least(*ps), "p_margin": F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x - 0.5)) / n}
