"""Alignment of prediction runs and their comparison."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Rows that both runs have, by id; a row whose labels differ raises. Other columns are the first run's where it has a value."""
    left = a.withColumnsRenamed({c: f"a_{c}" for c in a.columns if c != "id"})
    right = b.withColumnsRenamed({c: f"b_{c}" for c in b.columns if c != "id"})
    both = left.join(right, "id")
    label = F.when(F.col("a_label").eqNullSafe(F.col("b_label")), F.col("a_label")).otherwise(F.raise_error(F.concat(F.lit("labels differ at "), F.col("id").cast("string"))).cast("int"))
    meta = [F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in a.columns if c in b.columns and c not in ("id", "label", "p", "pred")]
    return both.select("id", label.alias("label"), *meta, *(F.col(f"{s}_{c}").alias(f"{c}_{n}") for s, n in zip("ab", names, strict=True) for c in ("p", "pred")))


def many(runs: dict[str, DataFrame]) -> DataFrame:
    """Rows of all runs in one pass over their union: ids that every run has, with p_<run> and pred_<run>; differing labels raise."""
    long = reduce(DataFrame.unionAll, (d.select("id", "label", "p", "pred", F.lit(n).alias("run_")) for n, d in runs.items()))
    of = lambda c, n: F.max(F.when(F.col("run_") == n, F.col(c))).alias(f"{c}_{n}")
    own = long.groupBy("id").agg(F.count_distinct("run_").alias("n_"), F.min("label").alias("label"), F.max("label").alias("other_"), *(of(c, n) for n in runs for c in ("p", "pred")))
    own = own.where(F.col("n_") == len(runs))
    label = F.when(F.col("label") == F.col("other_"), F.col("label")).otherwise(F.raise_error(F.lit("labels differ")).cast("int"))
    return own.withColumn("label", label).drop("n_", "other_")


def coverage(runs: dict[str, DataFrame]) -> DataFrame:
    """(run, ids, missing): missing counts the ids of other runs that a run lacks."""
    long = reduce(DataFrame.unionAll, (d.select("id", F.lit(n).alias("run")) for n, d in runs.items())).distinct()
    total = F.broadcast(long.agg(F.count_distinct("id").alias("t_")))
    return long.groupBy("run").agg(F.count("*").alias("ids")).crossJoin(total).select("run", "ids", (F.col("t_") - F.col("ids")).alias("missing"))


def with_branch(base: DataFrame, branch: DataFrame, into: str, default: float | None = 0.0) -> DataFrame:
    """base with a branch's probability, a default where it has none; without default, a missing one raises."""
    own = base.join(branch.select("id", F.col("p").alias(into)), "id", "left")
    missing = F.lit(default) if default is not None else F.raise_error(F.lit("a row has no branch")).cast("double")
    return own.withColumn(into, F.coalesce(F.col(into), missing))


def filled(base: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with null or empty columns taken from source's row of the same key."""
    other = source.select(F.col(key).alias("k_"), *(F.col(c).alias(f"s_{c}") for c in columns))
    own = base.join(other, F.col(key) == F.col("k_"), "left")
    value = lambda c: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.when(F.col(f"s_{c}").cast("string") != "", F.col(f"s_{c}")))
    return own.withColumns({c: value(c) for c in columns}).drop("k_", *(f"s_{c}" for c in columns))


def delta(base: DataFrame, run: DataFrame) -> DataFrame:
    """One row of counts: common, missing and extra ids, label mismatches, fixed and new false positives and negatives."""
    a = base.select("id", F.col("label").alias("la"), F.col("pred").alias("pa"))
    b = run.select("id", F.col("label").alias("lb"), F.col("pred").alias("pb"))
    both = a.join(b, "id", "full_outer")
    same = F.col("la") == F.col("lb")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    flips = {f"{k}_{e}": same & (F.col("la") == y) & (F.col("pa") == x) & (F.col("pb") == z) for e, y, k, x, z in (("fp", 0, "fixed", 1, 0), ("fp", 0, "new", 0, 1), ("fn", 1, "fixed", 0, 1), ("fn", 1, "new", 1, 0))}
    return both.agg(n(F.col("la").isNotNull() & F.col("lb").isNotNull()).alias("common"), n(F.col("lb").isNull()).alias("missing"), n(F.col("la").isNull()).alias("extra"), n(F.col("la") != F.col("lb")).alias("label_mismatch"), *(n(c).alias(k) for k, c in flips.items()))


def errors(runs: dict[str, DataFrame]) -> DataFrame:
    """(run, id) of wrong predictions."""
    return reduce(DataFrame.unionAll, (d.where("pred <> label").select(F.lit(n).alias("run"), "id") for n, d in runs.items()))


def overlap(errs: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, shared, jaccard) of the runs' error sets, each pair once; jaccard null where both are empty."""
    sizes = errs.groupBy("run").agg(F.count("*").alias("n"))
    both = errs.withColumnRenamed("run", "a").join(errs.withColumnRenamed("run", "b"), "id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    s = F.broadcast(sizes)
    pairs = sizes.select(F.col("run").alias("a"), F.col("n").alias("n_a")).crossJoin(s.select(F.col("run").alias("b"), F.col("n").alias("n_b"))).where("a < b")
    out = pairs.join(both, ["a", "b"], "left").na.fill(0, ["shared"])
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return out.withColumn("jaccard", F.when(union > 0, F.col("shared") / union))


def hard_cases(runs: dict[str, DataFrame]) -> DataFrame:
    """(id, wrong) of ids that at least one run gets wrong, with the number of runs that do."""
    return errors(runs).groupBy("id").agg(F.count("*").alias("wrong"))


def ensembles(aligned: DataFrame, names: list[str], sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(ensemble, id, label, p): mean probabilities of every combination of runs. The rows are as many as rows times combinations."""
    made = [F.struct(F.lit("+".join(c)).alias("ensemble"), (reduce(lambda a, b: a + b, (F.col(f"p_{n}") for n in c)) / len(c)).alias("p")) for k in sizes for c in combinations(names, k)]
    return aligned.select("id", "label", F.explode(F.array(*made)).alias("e")).select("e.ensemble", "id", "label", "e.p")
