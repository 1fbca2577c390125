"""Resumable appending: tasks that are finished are not done again. An extension: windowed metrics over a stream of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(tasks: DataFrame, done: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks without a finished output."""
    return tasks.join(done.select(key), key, "left_anti")


def follow(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "task_id") -> StreamingQuery:
    """Works through all files that are in source now, each once over all runs, and appends outputs; a key is done once.

    A micro-batch leaves out keys that stand in it before or that the target has, of which only the key column is read; so no state grows, and a batch that is run
    again after a failure appends nothing twice.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(source)

    def one(batch: DataFrame, _: int) -> None:
        s = batch.sparkSession
        batch = batch.dropDuplicates([key])
        p = s._jvm.org.apache.hadoop.fs.Path(target)
        fs = p.getFileSystem(s._jsc.hadoopConfiguration())
        there = fs.exists(p) and fs.listStatus(p)
        new = pending(batch, s.read.parquet(target), key) if there else batch
        work(new).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and values by window and type; on a stream, rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
