"""Deduplication and anti-joins, with reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.store import forget, written


def first_wins(df: DataFrame, key: list[str], order: list[str], last: bool = False) -> DataFrame:
    """Of rows of equal key, the first by order, or the last. The winners are found by an aggregation, so a key that many rows share
    does not meet in one task. `order` tells a key's rows apart; rows with a null in the key stay."""
    best = (F.max if last else F.min)(F.struct(*order))
    won = df.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))).groupBy(*key).agg(best.alias("w_")).select(*key, *(F.col(f"w_.{o}").alias(f"w_{o}") for o in order))
    same = reduce(lambda a, b: a & b, [df[k] == won[k] for k in key] + [df[o].eqNullSafe(won[f"w_{o}"]) for o in order if o not in key])
    kept = df.join(won, same, "left_semi")
    return kept.unionByName(df.where(reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))))


def greedy(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows that a pass in `order` keeps when it skips any row one of whose keys a kept row has; skipped rows claim nothing.

    The same fixed point in rounds: of the undecided, rows that come first for all their keys stay, and what shares a key with them goes. A
    round decides at least the first undecided row of every connected group. Null keys collide with nothing. `order` is unique.
    """
    left = written(df.select(order, *keys), "greedy")
    kept = None
    while left.limit(1).count():
        marked = left
        for k in keys:
            least = left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"m_{k}"))
            marked = marked.join(least, k, "left")
        first = reduce(lambda a, b: a & b, (F.coalesce(F.col(f"m_{k}") == F.col(order), F.lit(True)) for k in keys))
        now = written(marked.where(first).select(order, *keys), "kept")
        kept = now if kept is None else kept.unionAll(now)
        rest = left.join(now.select(order), order, "left_anti")
        for k in keys:
            rest = rest.join(now.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
        before, left = left, written(rest.select(order, *keys), "greedy")
        forget(before)
    forget(left)
    return df.limit(0) if kept is None else df.join(kept.select(order), order, "left_semi")


def forbidden(df: DataFrame, sets: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Adds `reason`: the first of the named sets that holds the row's key, or null. Each set is (column of df, one-column table)."""
    out = df
    for name, (column, keys) in sets.items():
        own = keys.select(keys.columns[0]).distinct().withColumnRenamed(keys.columns[0], f"k_{name}").withColumn(f"in_{name}", F.lit(True))
        out = out.join(own, out[column] == own[f"k_{name}"], "left").drop(f"k_{name}")
    reason = F.coalesce(*(F.when(F.col(f"in_{n}"), F.lit(n)) for n in sets))
    return out.withColumn("reason", reason).drop(*(f"in_{n}" for n in sets))


def without(df: DataFrame, column: str, keys: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """Rows whose key is not among keys, or is exempt."""
    keys = keys.select(keys.columns[0]).distinct()
    if exempt is not None:
        keys = keys.exceptAll(exempt.select(exempt.columns[0]).distinct())
    return df.join(keys.withColumnRenamed(keys.columns[0], "k_"), F.col(column) == F.col("k_"), "left_anti")


def versioned_merge(old: DataFrame, new: DataFrame, reissued: DataFrame, key: str, valid: str) -> DataFrame:
    """Old and reissued versions of rows, with merge_source: the new version if valid, else the old if valid; rows in one alone, if valid there.

    Both have the same columns, `valid` among them; reissued lists the keys that were to be made anew.
    """
    cols = [c for c in old.columns if c != key]
    o = old.select(key, F.struct(*cols).alias("o_"))
    n = new.select(key, F.struct(*cols).alias("n_"))
    r = reissued.select(key).distinct().withColumn("r_", F.lit(True))
    both = o.join(n, key, "full_outer").join(r, key, "left")
    ok = lambda s: F.coalesce(F.col(f"{s}.{valid}"), F.lit(False))
    source = (
        F.when(F.col("o_").isNull() & ok("n_"), "rerun_only")
        .when(F.col("r_").isNull() & ok("o_"), "v1_kept")
        .when(ok("n_"), "rerun_replaced")
        .when(ok("o_"), F.when(F.col("n_").isNull(), "v1_missing_rerun").otherwise("v1_invalid_rerun"))
    )
    pick = F.when(F.col("merge_source").isin("rerun_only", "rerun_replaced"), F.col("n_")).otherwise(F.col("o_"))
    return both.withColumn("merge_source", source).where("merge_source is not null").withColumn("p_", pick).select(key, *(F.col(f"p_.{c}").alias(c) for c in cols), "merge_source")
