"""Near duplicates of documents and vectors against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm.ann import chi_square_quantile, nearest_neighbours
from textloom.llm.common import components
from textloom.llm.minhash import near_duplicates, sketches
from textloom.llm.pq import near_duplicate_vectors


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def joined(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        u, v = find(a), find(b)
        root[max(u, v)] = min(u, v)
    return [find(k) for k in range(n)]


def texts(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[r.choice(words) for _ in range(r.choice([3, 40, 120]))] for _ in range(12)]
    out = []
    for b in base:
        for _ in range(r.randrange(1, 12)):
            c = [x if r.random() > 0.01 * r.randrange(3) else r.choice(words) for x in b]
            out.append("  ".join(c).upper() if r.random() < 0.3 else " ".join(c))
    # a chain: each links to the next, the ends do not
    chain = [r.choice(words) for _ in range(100)]
    for _ in range(6):
        out.append(" ".join(chain))
        chain = chain[4:] + [r.choice(words) for _ in range(4)]
    return [*out, None, "", " \n\t", "one two", "ONE two", "x" * 5000]


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 80)])
def test_near_duplicates(spark, seed, percent):
    ts = texts(seed)
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").withColumn("component", F.lit("clash")).repartition(4)
    got = {r.doc_id: r for r in near_duplicates(df, percent).collect()}
    s = [shingles(t) for t in ts]
    links = [(a, b) for a in range(len(s)) for b in range(a) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    want = joined(len(s), links)
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(s[k]), want[k], want[k] == k) for k in range(len(s))}


def test_near_duplicates_of_odd_rows(spark):
    long = "a b c d e f g"
    df = spark.createDataFrame([(5, long), (5, long), (None, long), (3, long), (3, "other words entirely here now"), (9, "other words entirely here now")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).where("doc_id is not null").collect())
    assert got == [(3, 3, True), (3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False)]
    assert near_duplicates(df).where("doc_id is null").first().kept
    assert near_duplicates(df.limit(0)).count() == 0


def test_sketches_fill_and_estimate():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 1000, dtype=np.uint64)
    a, b = pool[:800], pool[200:]
    items, off = np.concatenate([a, b, pool[:1]]), np.array([0, 800, 1600, 1601, 1601])
    s = sketches(items, off)
    top = np.iinfo(np.uint64).max
    assert (s[:3] != top).all() and (s[3] == top).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 260)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = joined(300, links)
    ends = {k for a, b in links if a != b for k in (a, b)}
    assert got == {k: want[k] for k in ends}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def vectors(seed, d=12, n=150):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, d))
    v = centres[r.integers(0, 20, n)] + r.normal(size=(n, d)) * r.choice([0.01, 0.2, 1], size=(n, 1))
    v[1] = v[0]
    v[2] = 3 * v[0]
    return v


def odd_rows(v):
    rows = [(k, [float(x) for x in row]) for k, row in enumerate(v)]
    n = len(rows)
    return [*rows, (n, None), (n + 1, []), (n + 2, [0.0] * 12), (n + 3, [1.0, None] + [0.0] * 10), (n + 4, [float("nan")] * 12), (n + 5, [float("inf")] + [1.0] * 11), (n + 6, [1.0, 2.0]), (n + 7, [1.0, 2.0]), (None, rows[0][1])]


def test_vector_near_duplicates(spark):
    v = vectors(3)
    n = len(v)
    df = spark.createDataFrame(odd_rows(v), "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    got = near_duplicate_vectors(df, 0.9, part_rows=20).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    want = joined(n, [(a, b) for a in range(n) for b in range(a) if near[a, b]])
    own = {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None}
    assert {k: own[k] for k in range(n)} == {k: (int(near[k].sum()) - 1, want[k]) for k in range(n)}
    assert [own[n + k] for k in range(6)] == [(0, n + k) for k in range(6)]
    assert own[n + 6] == own[n + 7] == (1, n + 6)
    assert [(r.n_links, r.component_id) for r in got if r.vec_id is None] == [(0, None)]
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_nearest_neighbours(spark):
    v = vectors(4, n=400)
    df = spark.createDataFrame(odd_rows(v), "vec_id long, embedding array<double>").withColumn("part", F.lit(1))
    got = nearest_neighbours(df, df.where("vec_id % 10 = 0"), 10, cell_rows=50).collect()
    hits = total = 0
    for q in range(0, 400, 10):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(400), d))[:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [k for k, *_ in own] == list(range(1, 11))
        assert all(abs(s - d[i]) < 1e-12 for _, i, s in own)
        hits, total = hits + len({i for _, i, _ in own} & set(want.tolist())), total + 10
    assert hits / total >= 0.95
    assert not [r for r in got if r.query_id >= 400 and r.query_id != 406]
    few = df.where("vec_id < 3")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in nearest_neighbours(few, few).collect()) == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 0), (2, 2, 1)]
    assert nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


def test_quantile():
    assert chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
