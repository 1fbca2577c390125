"""Size-tiered compaction of immutable shards under versioned manifests, in DataFrame operations only.

A store is a folder with `data`, whose files are never changed, and `manifest`, with one file for each version that names
the shards it adds and removes; every SNAPSHOT-th names all of them. Arrivals are appended as the small files that their tasks write. Compaction takes tiers of
similarly sized shards that have grown to `fan_in` members and reads each tier's files packed to target-sized partitions: every task
writes one file, and nothing is shuffled. A version exists from the moment its whole manifest gets its name, which only one writer can give
it: on a local file system by a hard link, on object stores by a create that must not overwrite (their conditional put), elsewhere by a
rename that refuses an existing name, as HDFS's does. Whoever comes second gets a Conflict and nothing of theirs stays. Readers see whole versions
only, and no version goes before it has been asked to by `vacuum`. The driver holds the list of shards, some 200 bytes for each target_bytes.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import scratch, settings


#: Versions from one whole list of shards to the next.
SNAPSHOT = 16
#: File systems whose rename is a copy, and whose create without overwriting is a conditional put.
OBJECT_STORES = {"s3", "s3a", "s3n", "gs", "oss", "cos", "cosn", "obs", "wasb", "wasbs"}


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class Store:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 64 << 20, fan_in: int = 4):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name if "/" in name and name.startswith(self.root) else f"{self.root}/{name}")

    def versions(self) -> list[int]:
        folder = self._path("manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _entry(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"manifest/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard], str | None]:
        """Version, shards and schema; version 0 is the empty store."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, [], None
        entries = [self._entry(version)]
        while not entries[-1]["snapshot"]:
            entries.append(self._entry(entries[-1]["version"] - 1))
        shards: dict[str, Shard] = {}
        for e in reversed(entries):
            for path in e["remove"]:
                shards.pop(path, None)
            shards.update((x["path"], Shard(**x)) for x in e["add"])
        return version, list(shards.values()), entries[0]["schema"]

    def _name(self, draft, final) -> bool:
        """Gives a written file its final name unless that is taken, and says whether it did."""
        scheme = self._fs.getUri().getScheme()
        jvm = self.spark._jvm
        if scheme == "file":
            file = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                jvm.java.nio.file.Files.createLink(file(final), file(draft))
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                    return False
                raise
            return True
        if scheme in OBJECT_STORES:
            try:
                out, stream = self._fs.create(final, False), self._fs.open(draft)
                jvm.org.apache.commons.io.IOUtils.copy(stream, out)
                stream.close()
                out.close()
            except Py4JJavaError:
                if self._fs.exists(final):
                    return False
                raise
            return True
        return not self._fs.exists(final) and self._fs.rename(draft, final)

    def commit(self, base: int, add: list[Shard], remove: list[Shard], schema: str) -> int:
        """Writes the manifest of the version after base, or raises Conflict where that exists."""
        version = base + 1
        draft, final = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/{version:012d}.json")
        snapshot = version % SNAPSHOT == 1
        if snapshot:
            gone = {s.path for s in remove}
            add, remove = [s for s in self.manifest(base)[1] if s.path not in gone] + add, []
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "snapshot": snapshot, "schema": schema, "add": [asdict(s) for s in add], "remove": [s.path for s in remove]}).encode()))
        finally:
            out.close()
        try:
            if not self._name(draft, final):
                raise Conflict(f"version {version} exists")
        finally:
            self._fs.delete(draft, False)
        return version

    def _shards(self, folder: str) -> list[Shard]:
        """The files of a folder and what they hold, from their footers."""
        files = self.spark.read.option("recursiveFileLookup", "true").schema("`_` int").parquet(folder)
        per = files.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        return [Shard(r.path, r.rows, r.bytes) for r in per.orderBy("path").collect() if r.rows]

    def append(self, rows: DataFrame, by: str | None = None) -> list[int]:
        """Appends rows as new shards, one version for each value of `by`, or one in all. Returns the versions.

        No rows make an empty version. The schema is the first version's; later rows must have its columns.
        """
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = rows.write.mode("error")
        (writer.partitionBy(by) if by else writer).parquet(folder)
        fresh = self._shards(folder)
        schema = rows.drop(by).schema.json() if by else rows.schema.json()
        groups: dict[str, list[Shard]] = {}
        for s in fresh:
            groups.setdefault(s.path.rsplit("/", 1)[0], []).append(s)
        out: list[int] = []
        base, _, known = self.manifest()
        for key in sorted(groups) or [""]:
            while True:
                try:
                    out.append(self.commit(base, groups.get(key, []), [], known or schema))
                    break
                except Conflict:  # an append adds to whatever version is the last
                    base, _, known = self.manifest()
            base, known = out[-1], known or schema
        return out

    def tier(self, size: int) -> int:
        """0 for shards of half the target and over, which are left alone; else how many times fan_in below it."""
        return 0 if 2 * size >= self.target else 1 + int(math.log(self.target / (2 * max(size, 1)), self.fan_in))

    def compact(self) -> int:
        """Merges tiers with fan_in shards or more until there is none, and returns the version."""
        while True:
            version, shards, schema = self.manifest()
            tiers: dict[int, list[Shard]] = {}
            for s in shards:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
            due = [s for t, own in sorted(tiers.items()) if t and len(own) >= self.fan_in for s in own]
            if not due:
                return version
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            # files packed into partitions of the target's size; a partition becomes a file
            with settings(self.spark, spark__sql__files__maxPartitionBytes=str(self.target), spark__sql__files__openCostInBytes="0", spark__sql__files__minPartitionNum="1"):
                self.read_files(due, schema).write.parquet(folder)
            merged = self._shards(folder)
            if len(merged) >= len(due):
                self._fs.delete(self._path(folder), True)
                return version
            try:
                self.commit(version, merged, due, schema)
            except Conflict:  # another writer's version came first: the merge starts anew from it
                self._fs.delete(self._path(folder), True)

    def read_files(self, shards: list[Shard], schema: str | None) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema)) if schema else StructType()
        return self.spark.read.schema(kind).parquet(*[s.path for s in shards]) if shards else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the last one by default."""
        _, shards, schema = self.manifest(version)
        return self.read_files(shards, schema)

    def vacuum(self, keep: int = 2, older: float = 7 * 86_400.0) -> None:
        """Drops versions but the last `keep` that are `older` than so many seconds, and the files that only they named.

        A reader of a version must end before that version is so old. Versions go from the first on, up to a snapshot, on which the ones after it stand.
        """
        versions = self.versions()
        now = time.time()
        age = lambda v: now - self._fs.getFileStatus(self._path(f"manifest/{v:012d}.json")).getModificationTime() / 1000
        old = []
        for v in versions[:-keep]:
            if age(v) < older:
                break
            old.append(v)
        live = versions[len(old) :]
        named = {s.path for v in live for s in self.manifest(v)[1]}
        gone = {s.path for v in old for s in self.manifest(v)[1]} - named
        for path in gone:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), False)
        # a version that stands on deltas keeps them
        first = next((v for v in reversed(versions) if v <= live[0] and self._entry(v)["snapshot"]), live[0]) if live else 0
        for v in old:
            if v < first:
                self._fs.delete(self._path(f"manifest/{v:012d}.json"), False)


def compacted(rows: DataFrame, key: str, arrivals: int = 8, root: str | None = None, **parameters: int) -> DataFrame:
    """rows as a store holds them after so many arrivals, dealt by the hash of key, and a compaction.

    Every row comes back once for each time it is given: nulls, empty and long texts and repeated rows alike. Empty tables come
    back empty with their columns. Any column names will do.
    """
    store = Store(rows.sparkSession, root or scratch(rows.sparkSession, "store"), **parameters)
    taken = {c.lower() for c in rows.columns}
    arrival = next(c for k in range(len(taken) + 1) if (c := f"arrival_{k}") not in taken)
    store.append(rows.withColumn(arrival, F.pmod(F.xxhash64(key), F.lit(arrivals))), by=arrival)
    store.compact()
    if not root:
        store.vacuum(keep=1, older=0.0)  # nobody else knows of the store
    return store.read()
