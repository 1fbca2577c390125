"""Positions and prefix sums over a whole table without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.store import written

#: monotonically_increasing_id() holds the partition above, and the row in it below, this many bits.
_ROW_BITS = 33


def positions(df: DataFrame, order: list[str | Column], by: list[str] | None = None, into: str = "position") -> DataFrame:
    """Adds each row's position from 1 on, in `order`, within `by` or over all rows.

    Rows are dealt once to ranges of (by, order), sorted there, numbered and written to the shared folder; a range's first position is
    the number of rows in the ranges before it, so only counts of ranges meet in one place. Counts and numbers come from the written rows:
    a second exchange would draw other bounds from its own sample. The order should tell all rows apart.
    """
    by = by or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in (*by, *order)]
    names = [f"o{k}_" for k in range(len(keys))]
    dealt = df.withColumns(dict(zip(names, keys, strict=True))).repartitionByRange(parts, *names).sortWithinPartitions(*names)
    groups = names[: len(by)]
    rows = written(dealt.withColumn("at_", F.monotonically_increasing_id()).drop(*names[len(by) :]), "positions")
    rows = rows.withColumn("range_", F.shiftright("at_", _ROW_BITS))
    # rows of a group follow each other within a range, so a group's first number there and its rows before give every position
    sizes = rows.groupBy("range_", *groups).agg(F.count("*").alias("size_"), F.min("at_").alias("first_"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("base_", F.coalesce(F.sum("size_").over(before), F.lit(0))).drop("size_")
    match = rows.range_ == sizes.range_
    for g in groups:
        match = match & rows[g].eqNullSafe(sizes[g])
    # without groups there is one row for each range, as many as the exchange has partitions
    out = rows.join(sizes if groups else F.broadcast(sizes), match)
    return out.withColumn(into, F.col("base_") + F.col("at_") - F.col("first_") + 1).select(*(rows[c] for c in df.columns), into)
