"""Concurrent writers, readers of old versions and what is left behind."""

import threading

import pytest
from pyspark.sql import functions as F

from textloom.llm import sharding


def files(path):
    return {str(p) for p in path.rglob("*.parquet")}


def test_one_of_two_writers_commits(spark, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/s")
    for version in range(20):
        gate, got = threading.Barrier(4), []

        def write(name, version=version, gate=gate, got=got):
            own = sharding.Store(spark, f"file://{tmp_path}/s")
            gate.wait()
            try:
                got.append((own.commit(version, [sharding.Shard(f"{name}-{version}", 1, 1)], [], "{}"), name))
            except sharding.Conflict:
                got.append((None, name))

        threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        won = [name for v, name in got if v]
        assert len(got) == 4 and len(won) == 1
        assert store.manifest()[1][-1].path == f"{won[0]}-{version}" and len(store.manifest()[1]) == version + 1
    assert store.manifest(7)[0] == 7 and len(store.manifest(7)[1]) == 7  # snapshots and deltas alike
    assert not [p for p in (tmp_path / "s" / "manifest").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_concurrent_appends_and_compaction_lose_nothing(spark, tmp_path):
    root, errors = f"file://{tmp_path}/s", []
    store = sharding.Store(spark, root, target_bytes=1 << 20)

    def work(k):
        try:
            own = sharding.Store(spark, root, target_bytes=1 << 20)
            for j in range(3):
                own.append(spark.range(100 * (3 * k + j), 100 * (3 * k + j + 1), 1, 2))
            own.compact()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    assert sorted(r.id for r in store.read().collect()) == list(range(900))


def test_readers_keep_their_version(spark, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/s", target_bytes=1 << 20)
    for k in range(6):
        store.append(spark.range(10 * k, 10 * k + 10, 1, 2))
    old = store.read()
    version = store.compact()
    assert version > 6 and old.count() == 60 and store.read(3).count() == 30
    store.vacuum(keep=1)  # nothing is so old
    assert store.read(3).count() == 30
    before = files(tmp_path)
    store.vacuum(keep=1, older=0.0)
    assert store.read().count() == 60 and files(tmp_path) == {s.path.removeprefix("file://").removeprefix("file:") for s in store.manifest()[1]} < before


def test_a_lost_merge_leaves_nothing(spark, tmp_path, monkeypatch):
    store = sharding.Store(spark, f"file://{tmp_path}/s", target_bytes=1 << 20)
    for k in range(5):
        store.append(spark.range(10 * k, 10 * k + 10, 1, 1))
    commit, lost = store.commit, []

    def second(base, add, remove, schema):
        if remove and not lost:
            lost.append(add)
            raise sharding.Conflict
        return commit(base, add, remove, schema)

    monkeypatch.setattr(store, "commit", second)
    store.compact()
    assert lost and not {s.path.removeprefix("file://").removeprefix("file:") for s in lost[0]} & files(tmp_path)
    assert store.read().count() == 50


@pytest.mark.parametrize("name", ["arrival_", "arrival_0", "ARRIVAL_0"])
def test_clashing_names(spark, tmp_path, name):
    df = spark.createDataFrame([(k, None if k % 3 else "x") for k in range(50)], "id long, text string").withColumn(name, F.col("id") * 2).withColumn("part", F.lit(None).cast("string"))
    got = sharding.compacted(df, "id", root=f"file://{tmp_path}/s")
    assert got.columns == df.columns and sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))
