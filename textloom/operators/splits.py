"""Splits, quotas and assignments. Every order is one of hashes of ids and a seed, so reruns agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from textloom.operators.carry import carried
from textloom.operators.dedup import greedy
from textloom.operators.order import positions
from textloom.operators.store import written


def shuffled(*cols: str, seed: int = 42) -> Column:
    """A key in whose order rows are shuffled."""
    return F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in cols), F.lit(str(seed))).cast("binary"))


def ranked(df: DataFrame, by: list[str], order: list, into: str = "rank_") -> DataFrame:
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_of_each(df: DataFrame, by: list[str], order: list, n: int | Column) -> DataFrame:
    """At most n rows of each group, the first by order; Spark drops the rest of each task's rows before they are shuffled."""
    return ranked(df, by, order).where(F.col("rank_") <= n).drop("rank_")


def signatures(df: DataFrame, pair: str = "pair_id", label: str = "label") -> DataFrame:
    """(pair, signature, rows) of each pair of rows."""
    g = df.groupBy(pair).agg(F.max((F.col(label) == 0).cast("int")).alias("h"), F.max((F.col(label) == 1).cast("int")).alias("l"), F.count("*").alias("rows"))
    s = F.when((F.col("h") == 1) & (F.col("l") == 1), "human_and_llm").when(F.col("h") == 1, "human_only").when(F.col("l") == 1, "llm_only").otherwise("unlabelled")
    return g.select(pair, s.alias("signature"), "rows")


def pair_split(df: DataFrame, pair: str = "pair_id", label: str = "label", train: float = 0.8, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """df with `split`: within each signature floor(n * train) pairs train, floor(n * valid) validate, the rest test. A pair stays together."""
    own = signatures(df, pair, label).withColumn("s_", shuffled(pair, seed=seed))
    own = positions(own, ["s_", pair], ["signature"])
    sizes = own.groupBy("signature").agg(F.count("*").alias("n_"))
    own = own.join(sizes, "signature")
    split = F.when(F.col("position") <= F.floor(F.col("n_") * train), "train").when(F.col("position") <= F.floor(F.col("n_") * train) + F.floor(F.col("n_") * valid), "valid").otherwise("test")
    return df.join(own.select(F.col(pair).alias("p_"), "signature", split.alias("split")), F.col(pair).eqNullSafe(F.col("p_"))).drop("p_")


def dev_split(df: DataFrame, group: str, ratio: float, seed: int = 42) -> DataFrame:
    """df with `split`: max(1, round(groups * ratio)) groups in dev."""
    own = positions(df.select(group).distinct().withColumn("s_", shuffled(group, seed=seed)), ["s_", group])
    n = own.agg(F.greatest(F.lit(1), F.bround(F.count("*") * ratio)).cast("long").alias("n_"))
    own = own.crossJoin(F.broadcast(n)).select(F.col(group).alias("g_"), F.when(F.col("position") <= F.col("n_"), "dev").otherwise("train").alias("split"))
    return df.join(own, F.col(group) == F.col("g_")).drop("g_")


def round_robin(df: DataFrame, order: list, k: int, by: list[str] | None = None, into: str = "slot") -> DataFrame:
    return positions(df, order, by).withColumn(into, F.pmod(F.col("position") - 1, F.lit(k)).cast("int")).drop("position")


def by_ratio(df: DataFrame, order: list, ratios: dict[str, float], into: str = "assigned") -> DataFrame:
    """Assigns rows in order to names by shares of the total, rounded half to even; the last name takes the rest."""
    own = positions(df, order)
    n = F.broadcast(own.agg(F.count("*").alias("n_")))
    names, upto, case = list(ratios), F.lit(0).cast("double"), None
    for name in names[:-1]:
        upto = upto + F.bround(F.col("n_") * ratios[name])
        case = (F if case is None else case).when(F.col("position") <= upto, name)
    return own.crossJoin(n).withColumn(into, case.otherwise(names[-1])).drop("n_", "position")


def quotas(df: DataFrame, by: str, limits: dict[str, int], order: list) -> DataFrame:
    """The first rows of each group up to its limit; a group without limit has none."""
    limit = reduce(lambda c, kv: (F if c is None else c).when(F.col(by) == kv[0], kv[1]), limits.items(), None)
    own = positions(df.where(F.col(by).isin(list(limits))), order, [by], "rank_")
    return own.where(F.col("rank_") <= limit).drop("rank_")


def interleaved(df: DataFrame, source: str, order: list, per_source: int, most: int) -> DataFrame:
    """Rows dealt from the sources in turn: the first of each, then the second, up to a cap for each and one in all."""
    own = first_of_each(df, [source], order, per_source)
    own = ranked(own, [source], order, "round_")
    return own.orderBy("round_", source).limit(most).drop("round_")


def proportional(df: DataFrame, by: str, n: int, order: list) -> DataFrame:
    """Exactly n rows, or all if fewer: each group's share rounded half to even, then topped up or trimmed in order."""
    own = positions(df, order, [by], "rank_")
    total = F.broadcast(own.agg(F.count("*").alias("t_")))
    sizes = own.groupBy(by).agg(F.count("*").alias("g_"))
    own = own.join(sizes, by).crossJoin(total)
    own = own.withColumn("in_", F.col("rank_") <= F.bround(F.col("g_") * n / F.col("t_")))
    return own.orderBy(F.desc("in_"), *order).limit(n).drop("t_", "g_", "rank_", "in_")


def balanced(df: DataFrame, label: str, bucket: str, order: list) -> DataFrame:
    """As many rows of each label as the rarest has, one of each bucket before any second."""
    own = positions(df, order, [label, bucket], "b_")
    own = positions(own.withColumn("late_", (F.col("b_") > 1).cast("int")), ["late_", *order], [label], "l_")
    least = F.broadcast(own.groupBy(label).agg(F.count("*").alias("k_")).agg(F.min("k_").alias("least_")))
    return own.crossJoin(least).where("l_ <= least_").drop("b_", "late_", "l_", "least_")


def capped(df: DataFrame, family: str, most: int, order: list) -> DataFrame:
    """At most `most` rows: an equal share for each family, filled up in order."""
    own = positions(df, order, [family], "rank_")
    n = F.broadcast(own.agg(F.count_distinct(family).alias("f_")))
    own = own.crossJoin(n).withColumn("in_", F.col("rank_") <= F.floor(F.lit(most) / F.col("f_")))
    return own.orderBy(F.desc("in_"), family, *order).limit(most).drop("rank_", "f_", "in_")


def folds(df: DataFrame, label: str, k: int, order: list) -> DataFrame:
    """df with `fold`, stratified by label. Rows of one pair may fall into different folds."""
    return positions(df, order, [label]).withColumn("fold", F.pmod(F.col("position") - 1, F.lit(k)).cast("int")).drop("position")


def leakage(splits: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(a, b, shared): how many keys two splits share, for each pair that shares any."""
    own = splits.select(split, key).distinct()
    a, b = own.select(F.col(split).alias("a"), key), own.select(F.col(split).alias("b"), key)
    return a.join(b, key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def greedy_groups(groups: DataFrame, targets: dict[str, dict[str, int]], label_counts: dict[str, str], order: list[str], ranges: int | None = None) -> DataFrame:
    """Assigns whole groups, in order, each to the split of which it fills most of what is still wanted; the first of equal splits, so a group that fills nothing goes to the first.

    label_counts names, for each label, the column with a group's rows of it. Keys and counts of the groups are walked in ranges; `order` tells groups apart.
    """
    names, labels = list(targets), list(label_counts.items())

    def choose(left: list[int], r: dict) -> str:
        gain = [sum(min(max(0, left[s * len(labels) + k]), r[c]) for k, (_, c) in enumerate(labels)) for s in range(len(names))]
        best = gain.index(max(gain))
        for k, (_, c) in enumerate(labels):
            # what is filled stays filled, so the state comes to rest
            left[best * len(labels) + k] = max(0, left[best * len(labels) + k] - r[c])
        return names[best]

    return _walked(groups, label_counts.values(), order, [targets[s].get(l, 0) for s in names for l, _ in labels], choose, "split", StringType(), ranges)


def scored_groups(groups: DataFrame, targets: dict[str, dict[str, int]], label_counts: dict[str, str], order: list[str], priority: list[str], ranges: int | None = None) -> DataFrame:
    """As greedy_groups, by (rows still wanted of its labels, rows the split lacks in all, least overflow, the last in `priority`)."""
    names, labels = list(targets), list(label_counts.items())
    want = [[targets[s].get(l, 0) for l, _ in labels] for s in names]
    all_ = [sum(targets[s].values()) for s in names]

    def choose(held: list[int], r: dict) -> str:
        def score(s: int) -> tuple:
            own = held[s * len(labels) : (s + 1) * len(labels)]
            useful = sum(min(r[c], max(0, w - h)) for (_, c), w, h in zip(labels, want[s], own, strict=True))
            over = sum(max(0, h + r[c] - w) for (_, c), w, h in zip(labels, want[s], own, strict=True) if r[c])
            return useful, max(0, all_[s] - sum(own)), -over, priority.index(names[s])

        best = max(range(len(names)), key=score)
        for k, (_, c) in enumerate(labels):
            held[best * len(labels) + k] += r[c]
        return names[best]

    return _walked(groups, label_counts.values(), order, [0] * (len(names) * len(labels)), choose, "split", StringType(), ranges)


def capped_groups(groups: DataFrame, caps: dict[str, int], order: list[str], ranges: int | None = None) -> DataFrame:
    """groups with `split`: dev for a whole group as long as no cap is passed, else train. caps bounds the sum of each named count; `order` tells groups apart."""

    def choose(held: list[int], r: dict) -> str:
        if any(h + r[c] > cap for h, (c, cap) in zip(held, caps.items(), strict=True)):
            return "train"
        for k, c in enumerate(caps):
            held[k] += r[c]
        return "dev"

    return _walked(groups, caps, order, [0] * len(caps), choose, "split", StringType(), ranges)


def groups_until(groups: DataFrame, targets: dict[str, int], order: list[str], ranges: int | None = None) -> DataFrame:
    """groups with `selected`: taken in order while they hold rows of a label whose target is not reached. `order` tells groups apart."""

    def choose(held: list[int], r: dict) -> bool:
        helps = any(r[c] > 0 and h < t for h, (c, t) in zip(held, targets.items(), strict=True))
        for k, (c, t) in enumerate(targets.items()) if helps else ():
            held[k] = min(t, held[k] + r[c])
        return helps

    return _walked(groups, targets, order, [0] * len(targets), choose, "selected", BooleanType(), ranges)


def _walked(groups: DataFrame, counts, order: list[str], start: list[int], choose, into: str, kind, ranges: int | None) -> DataFrame:
    """groups with `into`, from a walk over their keys and counts."""
    keys = groups.select(*order, *(c for c in counts if c not in order))
    done = carried(keys, order, start, choose, into, kind, ranges)
    return groups.join(done.select(*order, into), order)


def unique_fill(rows: DataFrame, group: str, text: str, bucket: str, exact: str, target: int, minimums: dict[str, int], exact_limit: int, order: list[str]) -> DataFrame:
    """rows with `selected`: exact ones first, up to a limit of tries, then each bucket's minimum, then others to the target; a group or text is used once.

    A try that is turned down counts towards the limit of exact ones; nulls are groups and texts like others. Each of the steps is a greedy
    choice among rows that share no group or text with those taken, in rounds (dedup.greedy), and the first of what it keeps; a step that wants few
    rows looks at the first rows of the order only, twice as many each time until they are enough. `order` tells rows apart.
    """
    key = lambda c: F.sha2(F.to_json(F.struct(F.col(c).cast("string").alias("v"))), 256)
    own = rows.select(*order, key(group).alias("g_"), key(text).alias("t_"), F.col(bucket).alias("b_"), F.coalesce(F.col(exact), F.lit(False)).alias("e_"))
    own = written(positions(own, order, ["e_"], "at_"), "fill")
    first, rest = own.where("e_"), own.where("not e_")
    taken = greedy(first if exact_limit < 0 else first.where(F.col("at_") <= exact_limit), ["g_", "t_"], "at_")
    taken = written(taken, "taken")
    for b, least in minimums.items():
        taken = _filled(taken, rest.where(F.col("b_") == b), least - taken.where(F.col("b_") == b).count())
    taken = _filled(taken, rest, target - taken.count())
    return rows.join(taken.select(*order, F.lit(True).alias("in_")), order, "left").withColumn("selected", F.coalesce("in_", F.lit(False))).drop("in_")


def _filled(taken: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """taken with the first n rows that share no key with it or with each other."""
    if n <= 0:
        return taken
    look, all_ = 4 * n, rows.count()
    while True:
        some = rows if look >= all_ else rows.orderBy("at_").limit(look)
        for k in ("g_", "t_"):
            some = some.join(taken.select(k).distinct(), k, "left_anti")
        more = greedy(some.select(*taken.columns), ["g_", "t_"], "at_")
        more = written(more.orderBy("at_").limit(n), "more")
        if look >= all_ or more.count() == n:
            return written(taken.unionByName(more), "taken")
        look *= 2


def forced_train(df: DataFrame, checks: dict[str, DataFrame]) -> DataFrame:
    """df with `forced`: whether any named column's value is in its table."""
    out = df.withColumn("forced", F.lit(False))
    for column, keys in checks.items():
        k = keys.select(F.col(keys.columns[0]).alias("k_")).distinct().withColumn("in_", F.lit(True))
        out = out.join(k, F.col(column) == F.col("k_"), "left").withColumn("forced", F.col("forced") | F.coalesce("in_", F.lit(False))).drop("k_", "in_")
    return out
