"""Override rules, routed thresholds, selectors, rule searches, deltas and gates."""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import lexicon as L


def fuse(alpha: float, a: str, b: str) -> Column:
    return F.lit(alpha) * F.col(a) + F.lit(1 - alpha) * F.col(b)


def guarded(rules: dict, base: str = "p_step7", pred: str = "pred_step7", branches: tuple[str, str, str] = ("p_oof", "p_roberta", "p_electra"), bucket: str = "bucket", words: str = "length_words") -> dict[str, Column]:
    """Votes of branches may turn a 0 of the base run to 1; high-risk buckets ask for more. Columns: override, votes, disagreement, prediction, probability."""
    add = F.when(F.col(bucket).isin(rules.get("high_risk_buckets", L.HIGH_RISK)), F.lit(rules.get("high_risk_threshold_add", 0.0))).otherwise(0.0)
    p = [F.coalesce(F.col(b), F.lit(0.0)) for b in branches]
    limits = [F.lit(rules.get(f"{n}_threshold", 1.1)) + add for n in ("oof", "roberta", "electra")]
    votes = sum(((a >= t).cast("int") for a, t in zip(p, limits, strict=True)), F.lit(0))
    spread = F.greatest(*p) - F.least(*p)
    yes = (F.col(pred) == 0) & (votes >= rules.get("min_votes", 2)) & (p[0] >= limits[0]) & (spread <= rules.get("max_disagreement", 1.1)) & (F.col(words) >= rules.get("min_words", 0.0))
    return {"override": yes, "votes": votes, "disagreement": spread, "prediction": F.when(yes, 1).otherwise(F.col(pred)), "probability": F.when(yes, F.greatest(F.col(base), *p)).otherwise(F.col(base))}


def residual_override(rules: dict) -> Column:
    """Over step7_pred, new_pred, new_p, delta, p_unsafe, p_human, bucket and words; an empty group of buckets allows all."""
    group = L.BUCKET_GROUPS[rules.get("bucket_group", "all")]
    allowed = F.col("bucket").isin(group) if group else F.lit(True)
    return (
        (F.col("step7_pred") == 0) & (F.col("new_pred") == 1) & allowed & (F.col("new_p") >= rules["threshold"]) & (F.col("delta") >= rules["min_delta"])
        & (F.coalesce(F.col("p_unsafe"), F.lit(1.0)) <= rules["unsafe_max"]) & (F.coalesce(F.col("p_human"), F.lit(1.0)) <= rules["human_style_max"]) & (F.col("words") >= rules.get("min_words", 0))
    )


def policy_override(rules: dict) -> Column:
    """As residual_override, with a bucket policy: general buckets must pass stricter limits. A missing p_unsafe or p_human counts as 1."""
    if rules.get("disabled_baseline"):
        return F.lit(False)
    policy = L.BUCKET_POLICIES[rules["bucket_policy"]]
    unsafe, human, safe = F.coalesce(F.col("p_unsafe"), F.lit(1.0)), F.coalesce(F.col("p_human"), F.lit(1.0)), F.coalesce(F.col("p_safe"), F.lit(0.0))
    strict = (safe >= rules.get("general_safe_min", 1.1)) & (unsafe <= rules.get("general_unsafe_max", -1.0)) & (F.col("new_p") >= rules.get("general_threshold", 1.1)) & (F.col("delta") >= rules.get("general_min_delta", 1.1))
    allowed = F.col("bucket").isin(policy["base"]) | (F.col("bucket").isin(policy["general"]) & strict)
    return (
        (F.col("step7_pred") == 0) & (F.col("new_pred") == 1) & allowed & (unsafe <= rules["unsafe_max"]) & (human <= rules["human_style_max"])
        & (safe >= rules["safe_min"]) & (F.col("new_p") >= rules["threshold"]) & (F.col("delta") >= rules["min_delta"])
    )


def routed(p: str, bucket: str, thresholds: dict[str, float], fallback: float) -> Column:
    """Prediction by the bucket's own threshold."""
    own = F.element_at(F.create_map(*(F.lit(x) for kv in thresholds.items() for x in kv)), F.col(bucket)) if thresholds else F.lit(None).cast("double")
    return (F.col(p) >= F.coalesce(own, F.lit(fallback))).cast("int")


def selected(p: str, selector: str, confidence: float, low: float = 0.35, high: float = 0.65) -> dict[str, Column]:
    """In the ambiguous zone a sure selector decides."""
    q = F.col(selector)
    use = F.col(p).between(low, high) & (F.greatest(q, 1 - q) >= confidence)
    return {"use_selector": use, "final_pred": F.when(use, (q >= 0.5).cast("int")).otherwise((F.col(p) >= 0.5).cast("int")), "final_p": F.when(use, q).otherwise(F.col(p))}


def grid(**choices: Iterable) -> list[dict]:
    """All combinations of rule settings."""
    names = list(choices)
    return [dict(zip(names, values, strict=True)) for values in product(*choices.values())]


def search(df: DataFrame, rules: list[dict], condition, label: str = "label") -> DataFrame:
    """(rule, overrides, fixed_fn, induced_fp) of every rule in one aggregation: a pair of sums for each rule, no row is multiplied."""
    sums = []
    for k, r in enumerate(rules):
        on = condition(r)
        for name, c in (("overrides", on), ("fixed_fn", on & (F.col(label) == 1)), ("induced_fp", on & (F.col(label) == 0))):
            sums.append(F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(f"{name}_{k}"))
    row = df.agg(*sums)
    each = F.array(*(F.struct(F.lit(k).alias("rule"), *(F.col(f"{n}_{k}").alias(n) for n in ("overrides", "fixed_fn", "induced_fp"))) for k in range(len(rules))))
    return row.select(F.explode(each).alias("r")).select("r.*")


def cube(df: DataFrame, on: Column, axes: dict[str, tuple[Column, str, list[float]]], by: str | None = None, label: str = "label", most: int = 20_000_000) -> DataFrame:
    """(rule, [by,] the axes' thresholds, overrides, fixed_fn, induced_fp) of every combination of thresholds, numbered as grid() does.

    An axis is a value, ">=" or "<=", and thresholds; a rule overrides the rows of `on` that pass its threshold on each axis. Nulls pass none. However many
    rules there are, rows are looked at once: each counts in the cell of a histogram that says how many thresholds it passes on each axis, and sums of
    the cells beyond, axis by axis, are the rules' counts. The histogram has a cell for each rule and value of `by`, `most` of them at most.
    """
    names, order = list(axes), {}
    bins = []
    for k, (name, (value, op, thresholds)) in enumerate(axes.items()):
        # from the loosest threshold on, so that a row passes the first of them
        order[name] = sorted(range(len(thresholds)), key=lambda i, t=thresholds, op=op: t[i] if op == ">=" else -t[i])
        passes = [F.coalesce(((value >= F.lit(t)) if op == ">=" else (value <= F.lit(t))).cast("int"), F.lit(0)) for t in thresholds]
        bins.append(sum(passes, F.lit(0)).alias(f"b{k}_"))
    group = [F.col(by).alias("by_")] if by else [F.lit(None).cast("string").alias("by_")]
    cells = df.where(on).select(*group, *bins, F.col(label).alias("y_"))
    for k in range(len(names)):
        cells = cells.where(F.col(f"b{k}_") > 0)
    found = cells.groupBy("by_", *(f"b{k}_" for k in range(len(names)))).agg(F.count("*").alias("n"), F.sum(F.when(F.col("y_") == 1, 1).otherwise(0)).alias("fixed"), F.sum(F.when(F.col("y_") == 0, 1).otherwise(0)).alias("induced"))
    shape = [len(axes[n][2]) for n in names]
    groups = sorted((r[0] for r in df.select(by).distinct().collect()), key=lambda v: (v is not None, v)) if by else [None]
    if math.prod(shape) * len(groups) > most:
        raise ValueError(f"more than {most} cells")
    table = np.zeros((len(groups), *shape, 3), np.int64)
    place = {g: k for k, g in enumerate(groups)}
    for r in found.collect():
        table[(place[r["by_"]], *(r[f"b{k}_"] - 1 for k in range(len(names))))] = [r["n"], r["fixed"], r["induced"]]
    for axis in range(1, len(names) + 1):
        table = np.flip(np.cumsum(np.flip(table, axis), axis=axis), axis)
        # back to the order in which the thresholds were given
        table = np.take(table, np.argsort(order[names[axis - 1]]), axis)
    rules = np.array(list(product(*(axes[n][2] for n in names))), float).reshape(-1, len(names))
    flat = table.reshape(len(groups), -1, 3)
    columns = {"rule": np.tile(np.arange(len(rules)), len(groups))}
    if by:
        columns[by] = np.repeat(np.array(groups, object), len(rules))
    columns |= {n: np.tile(rules[:, k], len(groups)) for k, n in enumerate(names)} | {n: flat[:, :, k].ravel() for k, n in enumerate(("overrides", "fixed_fn", "induced_fp"))}
    kinds = ["rule int", *([f"{by} {df.schema[by].dataType.simpleString()}"] if by else []), *(f"{n} double" for n in names), "overrides long", "fixed_fn long", "induced_fp long"]
    return df.sparkSession.createDataFrame(pd.DataFrame(columns), ", ".join(kinds))


def delta(df: DataFrame, before: str, after: str, by: list[str] | None = None, label: str = "label") -> DataFrame:
    """Counts of what a second prediction fixes and breaks."""
    y, a, b = F.col(label), F.col(before), F.col(after)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return df.groupBy(*(by or [])).agg(
        n(a == y).alias("before_correct"), n(b == y).alias("after_correct"), (n(b == y) - n(a == y)).alias("net_gain"), n((a != y) & (b == y)).alias("fixed"), n((a == y) & (b != y)).alias("broken"),
        n((y == 1) & (a == 0) & (b == 1)).alias("fixed_fn"), n((y == 0) & (a == 1) & (b == 0)).alias("fixed_fp"), n((y == 0) & (a == 0) & (b == 1)).alias("new_fp"), n((y == 1) & (a == 1) & (b == 0)).alias("new_fn"),
    )


def gates(metrics: DataFrame, required: dict[str, tuple[str, float]]) -> DataFrame:
    """(gate, required, observed, passed) of one row of metrics; required gives (">=" or "<=", bound) for a column."""
    rows = [F.struct(F.lit(c).alias("gate"), F.lit(float(b)).alias("required"), F.col(c).cast("double").alias("observed"), ((F.col(c) >= b) if op == ">=" else (F.col(c) <= b)).alias("passed")) for c, (op, b) in required.items()]
    return metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def search_by(df: DataFrame, rules: list[dict], condition, by: str, label: str = "label") -> DataFrame:
    """As search, for each value of `by`: (rule, by, overrides, fixed_fn, induced_fp)."""
    sums = []
    for k, r in enumerate(rules):
        on = condition(r)
        for name, c in (("overrides", on), ("fixed_fn", on & (F.col(label) == 1)), ("induced_fp", on & (F.col(label) == 0))):
            sums.append(F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(f"{name}_{k}"))
    each = F.array(*(F.struct(F.lit(k).alias("rule"), *(F.col(f"{n}_{k}").alias(n) for n in ("overrides", "fixed_fn", "induced_fp"))) for k in range(len(rules))))
    return df.groupBy(by).agg(*sums).select(by, F.explode(each).alias("r")).select("r.rule", by, "r.overrides", "r.fixed_fn", "r.induced_fp")


def ranked_rules(found: DataFrame, by: str, fixed: dict[str, float], induced: dict[str, float], most: dict[str, int], price: float = 0.03) -> DataFrame:
    """One row for each rule: its score, from weighted fixes and new errors of named splits less a price for each override, and whether it stays below each split's most new errors; the best first."""
    part = lambda c, s: F.coalesce(F.sum(F.when(F.col(by) == s, F.col(c))), F.lit(0))
    score = F.lit(0.0)
    for s, w in fixed.items():
        score = score + w * part("fixed_fn", s)
    for s, w in induced.items():
        score = score - w * part("induced_fp", s)
    ok = F.lit(True)
    for s, n in most.items():
        ok = ok & (part("induced_fp", s) <= n)
    own = found.groupBy("rule").agg((score - price * F.sum("overrides")).alias("score"), ok.alias("constraints_passed"), F.sum("overrides").alias("overrides"))
    return own.orderBy(F.desc("constraints_passed"), F.desc("score"), "overrides", "rule")


def confidence_choice(df: DataFrame, thresholds: list[float], p: str, selector: str, label: str = "label", most_fp: int = 0, least_gain: int = 1, least_used: int = 1) -> DataFrame:
    """The selector's confidence threshold: feasible ones first, then the largest gain, the fewest new false positives, the best F1, most fixed misses, the lowest. One aggregation for all thresholds."""
    base = (F.col(p) >= 0.5).cast("int")
    y = F.col(label)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    sums, fields = [], ("gain", "used", "fp", "base_fp", "tp", "fn", "fixed_fn")
    for k, t in enumerate(thresholds):
        s = selected(p, selector, t)
        b = s["final_pred"]
        values = (n(b == y) - n(base == y), n(s["use_selector"]), n((y == 0) & (b == 1)), n((y == 0) & (base == 1)), n((y == 1) & (b == 1)), n((y == 1) & (b == 0)), n((y == 1) & (base == 0) & (b == 1)))
        sums += [v.alias(f"{f}_{k}") for f, v in zip(fields, values, strict=True)]
    each = F.array(*(F.struct(F.lit(t).alias("threshold"), *(F.col(f"{f}_{k}").alias(f) for f in fields)) for k, t in enumerate(thresholds)))
    own = df.agg(*sums).select(F.explode(each).alias("e")).select("e.*").withColumns({"fp_increase": F.col("fp") - F.col("base_fp"), "f1": F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)})
    own = own.withColumn("feasible", (F.col("fp_increase") <= most_fp) & (F.col("gain") >= least_gain) & (F.col("used") >= least_used))
    return own.orderBy(F.desc("feasible"), F.desc("gain"), F.greatest(F.lit(0), "fp_increase"), F.desc("f1"), F.desc("fixed_fn"), "threshold").limit(1)


def gate_choice(df: DataFrame, thresholds: list[float], p: str, kind: str, safe: str, unsafe: str, candidate: str, rows: int, most_safe_veto: float, most_candidate_veto: float) -> DataFrame:
    """A guard's threshold: within both veto rates if any is, then most unsafe rows stopped, least vetoes, the highest. `kind` tells the rows of each set; one aggregation for all thresholds."""
    sums = [F.coalesce(F.sum(F.when(F.col(kind) == s, 1).otherwise(0)), F.lit(0)).alias(f"all_{k}") for k, s in enumerate((safe, unsafe))]
    for i, t in enumerate(thresholds):
        sums += [F.coalesce(F.sum(F.when((F.col(kind) == s) & (F.col(p) >= t), 1).otherwise(0)), F.lit(0)).alias(f"n{k}_{i}") for k, s in enumerate((safe, unsafe, candidate))]
    each = F.array(*(F.struct(F.lit(t).alias("threshold"), F.coalesce(F.try_divide(f"n0_{i}", "all_0"), F.lit(0.0)).alias("safe_veto"), F.coalesce(F.try_divide(f"n1_{i}", "all_1"), F.lit(0.0)).alias("unsafe_recall"), (F.col(f"n2_{i}") / F.lit(float(max(1, rows)))).alias("candidate_veto")) for i, t in enumerate(thresholds)))
    own = df.agg(*sums).select(F.explode(each).alias("e")).select("e.*").withColumn("feasible", (F.col("safe_veto") <= most_safe_veto) & (F.col("candidate_veto") <= most_candidate_veto))
    return own.orderBy(F.desc("feasible"), F.desc("unsafe_recall"), "safe_veto", "candidate_veto", F.desc("threshold")).limit(1)
