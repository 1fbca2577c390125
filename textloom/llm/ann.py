"""Nearest neighbours by low-dimensional stable projections, after Sun et al., "SRS" (VLDB 2014).

Vectors are projected on a few Gaussian directions: the squared projected distance over the squared distance is chi-square
distributed. A kd-tree over the projections, fitted on a bounded sample, deals all vectors to cells; each shard
of a cell has a kd-tree of its own down to small leaves. In a shard a query takes leaves within reach, and their vectors
in the order of projected distance, and verifies them in full, until a neighbour nearer than the k-th best so far would have its projection beyond
the next with at most the stated probability. It searches its own cell first; the bound found there decides which others it must
visit, and how far. How many vectors each query verified is counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import forget, small_batches, written
from textloom.llm.vectors import matrices, sample, usable

LEAF = 32
QUERY_ROWS = 1024
#: Vectors that a query verifies before the first stopping test, and the meetings of queries and vectors whose projected distances are held at once.
FIRST, MEETINGS = 64, 1 << 21


def chi_square_quantile(p: float, m: int) -> float:
    """The value below which a chi-square variable of an even number m of degrees stays with probability p."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - tail(mid) < p else (lo, mid)
    return hi


def box_distances(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The squared distance of each point to each box, for some boxes at a time."""
    out = np.empty((len(p), len(lo)))
    for at in range(0, len(lo), 128):
        out[:, at : at + 128] = (np.maximum(0, np.maximum(lo[None, at : at + 128] - p[:, None], p[:, None] - hi[None, at : at + 128])) ** 2).sum(axis=2)
    return out


def kd_leaves(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of a kd-tree's leaves: halves along the widest dimension until a leaf is small or has one point."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        spread = np.ptp(x[rows], axis=0)
        if len(rows) <= leaf or not spread.max() > 0:
            out.append(rows)
            continue
        order = rows[np.argsort(x[rows, spread.argmax()], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


class Cells:
    """The upper kd-tree: for vectors of one length, a projection and the splits that lead to a cell."""

    def __init__(self, x: np.ndarray, depth: int, directions: int, seed: int = 5):
        r = np.random.Generator(np.random.PCG64(seed))
        self.project = r.standard_normal((x.shape[1], directions))
        self.depth = depth
        p = x @ self.project
        self.axis, self.cut = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        own = {1: np.arange(len(p))}
        for node in range(1, 1 << depth):
            rows = own.pop(node)
            if len(rows):
                self.axis[node] = np.ptp(p[rows], axis=0).argmax()
                self.cut[node] = np.median(p[rows, self.axis[node]])
            right = p[rows, self.axis[node]] > self.cut[node]
            own[2 * node], own[2 * node + 1] = rows[~right], rows[right]

    def cell(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (p[np.arange(len(p)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)


def _dealt(models: dict[int, Cells]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, cell = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int32)
            for rows, m in matrices(batch.column("v")):
                dim[rows] = m.shape[1]
                if m.shape[1] in models:
                    cell[rows] = models[m.shape[1]].cell(m @ models[m.shape[1]].project)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(dim), pa.array(cell)], ["vec_id", "v", "dim", "cell"])

    return run


_SHARD = "dim int, cell int, part int, ids binary, member binary, vectors binary, leaves binary, boxes binary"


def _indexed(models: dict[int, Cells], keep: int):
    """A shard as one row: distinct vectors, each with its `keep` smallest ids, in the order of the leaves, and the leaves' boxes."""

    def run(group: pa.Table) -> pa.Table:
        dim, cell, part = (group.column(c)[0].as_py() for c in ("dim", "cell", "part"))
        ((_, m),) = matrices(group.column("v").combine_chunks())
        ids = group.column("vec_id").to_numpy()
        m, of = np.unique(m, axis=0, return_inverse=True)
        order = np.lexsort((ids, of.reshape(-1)))
        of, ids = of.reshape(-1)[order], ids[order]
        turn = np.arange(len(of)) - np.searchsorted(of, of)
        of, ids = of[turn < keep], ids[turn < keep]
        p = m @ models[dim].project if dim in models else np.zeros((len(m), 1))
        leaves = kd_leaves(p, LEAF)
        place = np.concatenate(leaves)
        to = np.empty(len(place), np.int64)
        to[place] = np.arange(len(place))
        order = np.argsort(to[of], kind="stable")
        boxes = np.stack([np.stack([p[rows].min(axis=0), p[rows].max(axis=0)]) for rows in leaves])
        sizes = np.array([len(rows) for rows in leaves], np.int64)
        kinds = [pa.int32()] * 3 + [pa.binary()] * 5
        values = [dim, cell, part, *(np.ascontiguousarray(a).tobytes() for a in (ids[order], to[of][order], m[place], sizes, boxes))]
        return pa.table([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _SHARD.split(", ")])

    return run


def _boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            boxes = np.frombuffer(r["boxes"]).reshape(len(r["leaves"]) // 8, 2, -1)
            rows.append((boxes[:, 0].min(axis=0).tolist(), boxes[:, 1].max(axis=0).tolist()))
        yield pa.RecordBatch.from_arrays([batch.column("dim"), batch.column("cell"), pa.array([a for a, _ in rows], pa.list_(pa.float64())), pa.array([b for _, b in rows], pa.list_(pa.float64()))], ["dim", "cell", "lo", "hi"])


def _routed(models: dict[int, Cells], boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], quantile: float, first: bool):
    """Queries by cell, packed: their own cell, or all others that the bound does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), QUERY_ROWS):
                part = batch.slice(at, QUERY_ROWS)
                ids, bound = part.column("vec_id").to_numpy(), part.column("bound").to_numpy(zero_copy_only=False)
                out: list[tuple] = []
                for rows, m in matrices(part.column("v")):
                    d = m.shape[1]
                    if d in models:
                        p = m @ models[d].project
                        home = models[d].cell(p)
                        names, lo, hi = boxes.get(d, (np.zeros(0, np.int64), np.zeros((0, p.shape[1])), np.zeros((0, p.shape[1]))))
                    else:
                        home, names = np.zeros(len(m), np.int64), np.zeros(1, np.int64)
                    if first:
                        go = home[:, None] == names[None]
                    elif d in models:
                        far = box_distances(p, lo, hi)
                        go = (home[:, None] != names[None]) & ~(far > quantile * bound[rows][:, None] ** 2)
                    else:
                        go = np.zeros((len(m), 1), bool)
                    for k in np.flatnonzero(go.any(axis=0)):
                        some = go[:, k]
                        out.append((d, int(names[k]), ids[rows[some]].tobytes(), m[some].tobytes(), bound[rows[some]].astype(np.float64).tobytes()))
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["dim", "cell", "queries", "points", "bounds"])

    return run


def _merged(k: int, kept: tuple[np.ndarray, np.ndarray], row: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of `kept` (scores, ids; infinite where there is none) and of new entries (row, id, distance)."""
    score, best = kept
    rows = np.concatenate([np.repeat(np.arange(len(score)), k), row])
    ids, dist = np.concatenate([best.reshape(-1), ids]), np.concatenate([score.reshape(-1), dist])
    order = np.lexsort((ids, dist, rows))
    rows = rows[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    order = order[place < k]
    return dist[order].reshape(-1, k), ids[order].reshape(-1, k)


def search_shard(q: np.ndarray, qid: np.ndarray, bound: np.ndarray, project: np.ndarray | None, v: np.ndarray, ids: np.ndarray, member: np.ndarray, sizes: np.ndarray, boxes: np.ndarray, quantile: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some queries: the scores and ids of their k best in a shard, and how many vectors of it they verified.

    v: the shard's distinct vectors in the order of its leaves, of `sizes`, in `boxes`; ids of the vectors `member` names.
    """
    n = len(v)
    first = np.searchsorted(member, np.arange(n))
    times = np.bincount(member, minlength=n)
    p, pv = (q @ project, v @ project) if project is not None else (np.zeros((len(q), 1)), np.zeros((n, 1)))
    near = np.maximum(0, np.einsum("nd,nd->n", p, p)[:, None] + np.einsum("nd,nd->n", pv, pv)[None] - 2 * p @ pv.T)
    reach = quantile * bound**2 if project is not None else np.full(len(q), np.inf)
    near[np.repeat(box_distances(p, boxes[:, 0], boxes[:, 1]) > reach[:, None], sizes, axis=1)] = np.inf
    kept = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    verified, done = np.zeros(len(q), np.int64), np.full(len(q), -1.0)
    step = FIRST
    while True:
        kth = np.minimum(kept[0][:, -1], bound)
        reach = quantile * kth**2 if project is not None else np.full(len(q), np.inf)
        # the projected distance of the step-th nearest, or the stopping test's, if that comes first
        upto = np.partition(near, step - 1, axis=1)[:, step - 1] if step < n else np.full(len(q), np.inf)
        last = upto >= reach
        row, at = np.nonzero((near > done[:, None]) & (near <= np.minimum(upto, reach)[:, None]) & np.isfinite(near))
        for a in range(0, len(row), 16_384):
            i, j = row[a : a + 16_384], at[a : a + 16_384]
            dist = np.sqrt(((v[j] - q[i]) ** 2).sum(axis=1))
            # a vector's ids, of which the query's own is none
            i, dist, place = np.repeat(i, times[j]), np.repeat(dist, times[j]), np.repeat(first[j], times[j])
            place = place + np.arange(len(place)) - np.repeat(np.cumsum(times[j]) - times[j], times[j])
            other = ids[place] != qid[i]
            kept = _merged(k, kept, i[other], ids[place][other], dist[other])
        verified += np.bincount(row, minlength=len(q))
        if last.all():
            return *kept, verified
        done, step = np.maximum(done, np.minimum(upto, reach)), step * 4


def _searched(models: dict[int, Cells], quantile: float, k: int):
    """Each query's best k of a shard, and in a row without vec_id how many vectors it verified there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                d = r["dim"]
                qid, q, bound = np.frombuffer(r["queries"], np.int64), np.frombuffer(r["points"]).reshape(-1, d), np.frombuffer(r["bounds"])
                ids, member, v = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["member"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, d)
                sizes = np.frombuffer(r["leaves"], np.int64)
                boxes = np.frombuffer(r["boxes"]).reshape(len(sizes), 2, -1)
                for at in range(0, len(q), max(1, MEETINGS // len(v))):
                    own = slice(at, at + max(1, MEETINGS // len(v)))
                    score, best, verified = search_shard(q[own], qid[own], bound[own], models[d].project if d in models else None, v, ids, member, sizes, boxes, quantile, k)
                    i, j = np.nonzero(np.isfinite(score))
                    names = pa.concat_arrays([pa.array(best[i, j]), pa.nulls(len(verified), pa.int64())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([qid[own][i], qid[own]])), names, pa.array(np.concatenate([score[i, j], verified.astype(np.float64)]))], ["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, directions: int = 24, confidence: float = 0.95, cell_rows: int = 8192, most_cells: int = 4096, shard_rows: int = 65_536, sample_rows: int = 20_000, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, verified): each query's k nearest by Euclidean distance, ties to the smaller vec_id; all, if there are fewer.

    verified: how many distinct vectors the query was compared with in full, those of several shards counted in each.

    The projection tree is fitted on at most sample_rows vectors; every vector is indexed. A true neighbour is missed with a probability of
    about 1 - confidence at most. A cell beyond twice its share of rows, or beyond shard_rows, is dealt to several shards. Equal vectors of a shard are one point
    with its k + 1 smallest ids, which is all that an answer can name. Rows without id, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part; nor do vectors of another length than the query's. A candidate with the query's id is the query's own. Repeated
    queries count once, and so do repeated candidates of equal id and vector.
    """
    clean = lambda df: df.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v")).where(usable("v") & F.col("vec_id").isNotNull())
    base, asked = clean(small_batches(vectors)), written(clean(queries).distinct(), "asked")
    total = base.count()
    depth = max(0, min(most_cells, -(-total // cell_rows)) - 1).bit_length()
    models = {d: Cells(m, depth, directions) for d, m in sample(base, "vec_id", "v", sample_rows, 13).items()}
    quantile = chi_square_quantile(confidence, directions)
    dealt = written(base.mapInArrow(_dealt(models), "vec_id long, v array<double>, dim int, cell int"), "dealt")
    fair = min(shard_rows, 2 * max(cell_rows, total >> depth))
    sizes = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / fair).alias("parts"))
    parts = dealt.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts").distinct()
    index = written(parts.repartition("dim", "cell", "part").groupBy("dim", "cell", "part").applyInArrow(_indexed(models, k + 1), _SHARD), "index")
    # a box for each cell, of which there are most_cells for a length at most
    low = lambda c, f: F.array(*(f(F.element_at(c, i + 1)) for i in range(directions)))
    edges = index.select("dim", "cell", "leaves", "boxes").mapInArrow(_boxed, "dim int, cell int, lo array<double>, hi array<double>").where(F.size("lo") == directions).groupBy("dim", "cell").agg(low("lo", F.min).alias("lo"), low("hi", F.max).alias("hi"))
    boxes: dict[int, list] = {}
    for r in edges.orderBy("dim", "cell").collect():
        boxes.setdefault(r.dim, []).append((r.cell, r.lo, r.hi))
    boxes = {d: tuple(np.array(c) for c in zip(*rows, strict=True)) for d, rows in boxes.items()}
    packed = "dim int, cell int, queries binary, points binary, bounds binary"

    def search(bounded: DataFrame, first: bool) -> DataFrame:
        routed = bounded.mapInArrow(_routed(models, boxes, quantile, first), packed)
        met = routed.join(index, ["dim", "cell"]).repartition("dim", "cell", "part", F.xxhash64("queries"))
        return written(met.mapInArrow(_searched(models, quantile, k), "query_id long, vec_id long, score double"), "met")

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = search(asked.withColumn("bound", F.lit(float("inf"))), True)
    home = found.where("vec_id is not null")
    kth = home.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    both = found.unionAll(search(asked.join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce("kth", F.lit(float("inf"))).alias("bound")), False))
    verified = both.where("vec_id is null").groupBy("query_id").agg(F.sum("score").cast("long").alias("verified"))
    out = both.where("vec_id is not null").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(verified, "query_id")
    for used in (asked, dealt, index):
        forget(used)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "verified")
