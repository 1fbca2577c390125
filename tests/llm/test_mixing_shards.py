"""The splitting tree decides which blocks a shard takes, and where."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import mixing

WORDS = "river stone garden winter letter quiet morning paper".split()


def rows(n, seed):
    r = random.Random(seed)
    return [(k, " ".join(r.choice(WORDS) for _ in range(r.choice([1, 30, 400]))), r.choice(["a", "b", "b", "b", None])) for k in range(n)]


@pytest.fixture(scope="module")
def mixture(spark):
    return mixing.mix(spark.createDataFrame(rows(200, 1), "doc_id long, text string, source string"), shard_words=2000)


def test_draws_have_the_hypergeometric_distribution(spark):
    quotas = [7, 0, 5, 12]
    got = Counter()
    for seed in range(60):
        df = spark.createDataFrame([(k, q) for k, q in enumerate(quotas)], "rank int, quota long").coalesce(1)
        got[tuple(r.quota for r in mixing.split_quotas(df, 1, seed).where("shard = 0").orderBy("rank").collect())] += 1
    assert all(sum(k) == 12 and all(0 <= x <= q for x, q in zip(k, quotas, strict=True)) for k in got)
    share = lambda i, x: math.comb(quotas[i], x) * math.comb(24 - quotas[i], 12 - x) / math.comb(24, 12)
    for i in (0, 2, 3):
        mean = sum(k[i] * n for k, n in got.items()) / 60
        variance = sum((x - quotas[i] / 2) ** 2 * share(i, x) for x in range(quotas[i] + 1))
        assert abs(mean - quotas[i] / 2) < 4 * (variance / 60) ** 0.5


def test_the_tree_splits_by_inversion(spark):
    """Every node's draw is the smallest number whose cumulative probability exceeds the node's hash."""
    quotas, depth = [40, 0, 9, 300], 3
    df = spark.createDataFrame([(k, q) for k, q in enumerate(quotas)], "rank int, quota long")
    leaf = {}
    for r in mixing.split_quotas(df, depth, 5).collect():
        leaf.setdefault(r.shard, {})[r.rank] = r.quota
    u = {(r.level, r.node, r.at): r.u for r in spark.sql(f"select level, node, at, shiftrightunsigned(xxhash64(5, level, node, at), 11) / 9007199254740992D as u from (select explode(sequence(0, {depth - 1})) level), (select explode(sequence(0L, 7L)) node), (select explode(sequence(0, 3)) at)").collect()}
    now = {0: quotas}
    for level in range(depth):
        after = {}
        for node, own in now.items():
            p, d, left = sum(own), sum(own) // 2, []
            for at, q in enumerate(own):
                total, x = 0.0, max(0, d - (p - q))
                while x < min(q, d) and total + math.comb(q, x) * math.comb(p - q, d - x) / math.comb(p, d) <= u[level, node, at]:
                    total += math.comb(q, x) * math.comb(p - q, d - x) / math.comb(p, d)
                    x += 1
                left.append(x)
                p, d = p - q, d - x
            after[2 * node], after[2 * node + 1] = left, [q - x for q, x in zip(own, left, strict=True)]
        now = after
    assert {s: [own[k] for k in range(4)] for s, own in leaf.items()} == now


def test_shards_take_what_they_drew(mixture, monkeypatch, spark):
    spans = mixture.spans.select("shard", "rank", "block", "pass", "place").distinct().collect()
    assert len({(r.rank, r.block, getattr(r, "pass")) for r in spans}) == len(spans)  # no block twice in a pass
    sizes = Counter(r.shard for r in spans)
    assert len(sizes) > 8 and max(sizes.values()) - min(sizes.values()) <= len(sizes)
    # without the tree, other shards
    monkeypatch.setattr(mixing, "split_quotas", lambda q, depth, seed=0: q.select(F.lit(0).cast("long").alias("shard"), "rank", "quota", F.lit(0).cast("long").alias("first")))
    df = spark.createDataFrame(rows(200, 1), "doc_id long, text string, source string")
    flat = {r.doc_id: r for r in mixing.taken_words(mixing.mix(df, shard_words=2000)).collect()}
    got = {r.doc_id: r for r in mixing.taken_words(mixture).collect()}
    assert any(flat[k].placement != got[k].placement for k in got) and all(flat[k].taken == got[k].taken for k in got)
    # a shard that drew nothing takes nothing
    monkeypatch.setattr(mixing, "split_quotas", lambda q, depth, seed=0: q.select(F.lit(0).cast("long").alias("shard"), "rank", F.lit(0).cast("long").alias("quota"), F.lit(0).cast("long").alias("first")))
    assert mixing.mix(df, shard_words=2000).spans.count() == 0


def test_placement_digests_every_span(mixture):
    want = {}
    for r in mixture.spans.withColumn("h", F.xxhash64("shard", "place", "block", "pass", "from_word", "to_word")).collect():
        old = want.get(r.doc_id, (0, 0, set()))
        want[r.doc_id] = (old[0] + r.to_word - r.from_word, old[1] ^ r.h, old[2] | {r.shard})
    for r in mixing.taken_words(mixture).collect():
        taken, digest, shards = want.get(r.doc_id, (0, 0, set()))
        assert (r.taken, r.placement, r.first_shard, r.last_shard) == (taken, digest, min(shards, default=None), max(shards, default=None))


def test_documents_come_by_shard_and_place(spark):
    df = spark.createDataFrame(rows(120, 3), "doc_id long, text string, source string")
    first = {}
    for r in mixing.mix(df, shard_words=2000).spans.collect():
        key = (r.doc_id, getattr(r, "pass"))
        first[key] = min(first.get(key, (1 << 60,)), (r.from_word, r.shard, r.place))
    places = {}
    for (doc, _), (_, shard, place) in first.items():
        places.setdefault(doc, set()).add((shard, place))
    rows_ = mixing.mixed_documents(df, length=None, shard_words=2000).withColumn("part", F.spark_partition_id()).collect()
    assert len(rows_) == len(first)
    order = [(r.part, *next(iter(places[r.doc_id]))) for r in rows_ if len(places[r.doc_id]) == 1]
    assert len(order) > 20 and order == sorted(order)


def test_rows_that_differ_elsewhere_are_picked_alike(spark):
    df = spark.createDataFrame([(1, "one two three", "a", k) for k in range(6)], "doc_id long, text string, source string, extra int")
    got = [sorted(r.extra for r in mixing.mixed_documents(df.repartition(n), length=None).collect()) for n in (1, 3, 5)]
    assert got[0] == got[1] == got[2] and set(got[0]) == {0}
