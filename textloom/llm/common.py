"""Shared plumbing of the training-data operators: shared-folder tables, hashing and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a session on one machine, such as a test's, may name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a new table or folder in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the plans made and run inside; `__` stands for a dot."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends there, and lost executors cost no recomputation.

    The shuffle files of the write go when it ends.
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        # a new frame, planned under these settings
        df.select("*").write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of the batches that go to Python workers: memory in flight follows them, on either side.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose batches for Python are small unless it has been told otherwise."""
    conf = df.sparkSession.conf
    for k, (default, own) in BATCH.items():
        if conf.get(k) == default:
            conf.set(k, own)
    return df


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder, through Hadoop's file system so that any store works."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def forget(df: DataFrame) -> None:
    """Deletes the files behind a table made by written(), once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, such as one small file, dealt out to all of them; any larger one as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> U64(33))
    x = x * _M1
    x ^= x >> U64(33)
    x *= _M2
    x ^= x >> U64(33)
    return x


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (n + 1) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None else np.zeros(1, np.int64)
    if not len(off):
        off = np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, texts: list[str], rows: int = 512, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows and, but for a single longer row, bytes of text."""
    each = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts)
    ends = np.cumsum(each)
    at = 0
    while at < len(batch):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        to = min(max(to, at + 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """Connected components of an edge table: (node, component), component the smallest node reachable.

    Alternating large-star and small-star rounds. A round writes its edges and its minima to the
    shared folder, so a hub's neighbours meet their minimum in a join of two plain exchanges that
    adaptive execution may split; nothing of the graph is collected. Rounds grow as the
    logarithm of a component's size. Loops and null ends are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    pair = lambda u, v: [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]
    now = written(edges.select(*pair(F.col(a).cast("long"), F.col(b).cast("long"))).where("u <> v").distinct(), name)
    state = None
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
        forget(least), forget(now)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), name)
        forget(least), forget(large)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    star = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionAll(now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
