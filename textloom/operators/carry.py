"""A walk over rows in order with a small state, in ranges that run side by side and none of which a task holds whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from textloom.operators.store import written

State = list[int]


def carried(table: DataFrame, order: list[str], start: State, choose: Callable[[State, dict], object], into: str, kind: DataType, ranges: int | None = None) -> DataFrame:
    """table with `into`: what choose(state, row) gives for each row in `order`; it changes the state, a list of integers, in place.

    Rows are dealt once to ranges of the order and written. A round walks every range that is not settled from the state that is thought to stand
    before it: the one after the range before it as last walked, at first the state at the round's beginning. What comes out settles the ranges up to the
    first whose beginning was wrong, and gives better beginnings for the others. Where choices soon stop changing the state, as once all targets are
    met, two or three rounds do; where every choice hangs on the one before, each round settles a range. Only states come back from a
    round, one for each range; a last pass gives the values. Tasks read their range as a stream. `order` tells rows apart.
    """
    spark = table.sparkSession
    ranges = ranges or max(16, spark.sparkContext.defaultParallelism)
    rows = written(table.repartitionByRange(ranges, *order).withColumn("range_", F.spark_partition_id()), "carried", by=["range_"])
    fields = [f for f in rows.schema.fields if f.name != "range_"]

    def walk(begin: dict[int, State], settled: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, state = None, []
            ended = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([state], pa.list_(pa.int64()))], ["range_", "state_"])
            for batch in batches:
                values = []
                for r, row in zip(batch.column("range_").to_pylist(), batch.to_pylist(), strict=True):
                    if r != at:
                        if at is not None and not settled:
                            yield ended()
                        at, state = r, list(begin[r])
                    values.append(choose(state, row))
                if settled:
                    yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(values)], [*(f.name for f in fields), into])
            if at is not None and not settled:
                yield ended()

        return run

    def streamed(df: DataFrame) -> DataFrame:
        return df.repartition("range_").sortWithinPartitions("range_", *order)

    there = sorted(r["range_"] for r in rows.select("range_").distinct().collect())
    begin = dict.fromkeys(there, list(start))
    first = 0
    while first < len(there) - 1:
        some = there[first:]
        got = streamed(rows.where(F.col("range_").isin(some))).mapInArrow(walk({r: begin[r] for r in some}, False), "range_ int, state_ array<long>")
        end = {r["range_"]: list(r["state_"]) for r in got.collect()}
        # the first of them began right; each next one did if it began with what the one before ended with
        first += 1
        while first < len(there) and begin[there[first]] == end[there[first - 1]]:
            first += 1
        for before, r in zip(some, some[1:], strict=False):
            begin[r] = end[before]
    return streamed(rows).mapInArrow(walk(begin, True), StructType([*fields, StructField(into, kind)]))
