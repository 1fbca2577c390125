"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

The sketch follows Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching" (FOCS 2017): a set is
thrown into the t coordinates by round after round of hashing. In round i below t every element
goes to a hashed bin with value i + h; in round t + j every element goes to bin j. Each coordinate
keeps its smallest value, and a set stops when all its coordinates are filled, after O(log t / n * t)
rounds on average, 2t at the most. Equal coordinates estimate Jaccard similarity with concentration
bounds as for t independent hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import U64, components, forget, mix64, settings, slices, small_batches, text_buffers, written

WIDTH = 5
BINS = 120
BLOCK_ROWS = 256
BLOCK_BYTES = 4 << 20
_SEED = np.random.Generator(np.random.PCG64(20170403))
_BYTE = _SEED.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = U64(0x9E3779B97F4A7C15)
_PLACE = _SEED.integers(0, 2**64, 16, dtype=np.uint64) | U64(1)
_ROUND = mix64(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * U64(0xD1B54A32D192ED03))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = 1 << 20


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z lowered, and the row it stands in. Works through pieces of about 1 MB, cut at white space."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[raw]
    starts, ends = word.copy(), word.copy()
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    starts[1:] &= ~word[:-1]
    starts[inner] = word[inner]
    ends[:-1] &= ~word[1:]
    ends[inner - 1] = word[inner - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    del word, starts, ends
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(first, first[at] + _PIECE)))
        lo, hi = first[at], last[to - 1] + 1
        sizes = last[at:to] - first[at:to] + 1
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        index = place + np.repeat(first[at:to] - lo, sizes)
        power = np.full(int(sizes.max()), _BASE)
        power[0] = 1
        power = np.multiply.accumulate(power)
        value = _BYTE[_LOWER[raw[lo:hi]]][index] * power[place]
        out[at:to] = mix64(np.add.reduceat(value, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64) * _BASE)
        at = to
    return out, np.searchsorted(offsets, first, side="right") - 1


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, sorted, end to end, and their offsets (n + 1).

    A row with fewer than WIDTH words has its whole sequence as one shingle; one without words has none.
    """
    raw, offsets = text_buffers(column)
    words, row = word_hashes(raw, offsets)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    begin = np.cumsum(count) - count
    sets, sizes = [], np.zeros(rows, np.int64)
    for k in range(rows):
        w = words[begin[k] : begin[k] + count[k]]
        if not len(w):
            continue
        if len(w) < WIDTH:
            h = (w * _PLACE[: len(w)]).sum(keepdims=True) + np.uint64([len(w)]) * _PLACE[8]
        else:
            m = len(w) - WIDTH + 1
            h = w[:m] * _PLACE[0]
            for j in range(1, WIDTH):
                h += w[j : j + m] * _PLACE[j]
        h = mix64(h)
        h.sort()
        if len(h) > 1:
            h = h[np.concatenate(([True], h[1:] != h[:-1]))]
        sets.append(h)
        sizes[k] = len(h)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def sketches(items: np.ndarray, offsets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The (rows, bins) fast similarity sketch of non-empty sets; an empty set's row stays at the largest value."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.full(rows * bins, np.iinfo(np.uint64).max, np.uint64)
    row = np.repeat(np.arange(rows), sizes)
    left, x = sizes > 0, items
    for i in range(2 * bins):
        z = mix64(x ^ _ROUND[i])
        to = ((z >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(out, row * bins + to, (z & U64(0xFFFFFFFF)) | U64(i << 32))
        full = (out.reshape(rows, bins) != np.iinfo(np.uint64).max).all(axis=1)
        still = left & ~full
        if not still.any():
            break
        if (still != left).any():
            keep = still[row]
            x, row, left = x[keep], row[keep], still
    return out.reshape(rows, bins)


def bands_of(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of so many rows; the band's number is part of it."""
    n, bins = sketch.shape
    s = sketch.reshape(n, bins // rows, rows)
    key = np.zeros(s.shape[:2], np.uint64)
    for j in range(rows):
        key += mix64(s[:, :, j]) * _PLACE[j]
    return mix64(key ^ (np.arange(bins // rows, dtype=np.uint64) * _BASE)).view(np.int64)


def band_rows(threshold: float) -> int:
    """Rows of a band: a pair at 0.85 is missed with probability 8e-7 by 24 bands of 5, one at 0.8 with 2e-7 by 30 bands of 4."""
    return 5 if threshold >= 0.85 else 4


def _sketched(rows_per_band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, ["text"]):
                items, offsets = shingle_sets(part.column("text"))
                keys = bands_of(sketches(items, offsets), rows_per_band)
                total = lambda salt: np.add.reduceat(np.append(mix64(items ^ U64(salt)), U64(0)), np.minimum(offsets[:-1], len(items))) * (np.diff(offsets) > 0)
                flat = pa.array(keys.reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(total(1).view(np.int64)), pa.array(total(2).view(np.int64)), pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * keys.shape[1], flat)],
                    ["doc_id", "n_shingles", "f1", "f2", "bands"],
                )

    return run


def _over(inter: int, union: int, percent: int) -> bool:
    return 100 * inter >= percent * union


def _verified(percent: int):
    """Rows (a, b) of the pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, ["text_a", "text_b"]):
                first = part.column("text_a").dictionary_encode()
                a, ao = shingle_sets(first.dictionary)
                ia = first.indices.to_numpy(zero_copy_only=False)
                b, bo = shingle_sets(part.column("text_b"))
                keep = np.zeros(len(part), bool)
                for k in range(len(part)):
                    x, y = a[ao[ia[k]] : ao[ia[k] + 1]], b[bo[k] : bo[k + 1]]
                    if not _over(min(len(x), len(y)), max(len(x), len(y)), percent):
                        continue
                    both = np.intersect1d(x, y, assume_unique=True).size
                    keep[k] = _over(both, len(x) + len(y) - both, percent)
                found = part.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([found.column("a"), found.column("b")], ["a", "b"])

    return run


def _block_links(percent: int):
    """Links that join different components among one pair of blocks: a forest of them at most, from all exact intersections."""

    def run(group: pa.Table) -> pa.Table:
        node, comp, side = (group.column(c).to_numpy() for c in ("doc_id", "component", "side"))
        items, off = shingle_sets(group.column("text").combine_chunks())
        sizes = np.diff(off)
        row = np.repeat(np.arange(len(sizes)), sizes)
        _, col, times = np.unique(items, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times[col] > 1)
        number = np.cumsum(times > 1) - 1
        row, col, wide = row[shared], number[col[shared]], int((times > 1).sum())
        inter = np.zeros((len(sizes), len(sizes)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for lo in range(0, wide, 8192):  # counts below 2**24 are exact in single precision
            f, t = np.searchsorted(col, (lo, lo + 8192))
            m = np.zeros((len(sizes), min(8192, wide - lo)), np.float32)
            m[row[f:t], col[f:t] - lo] = 1
            inter += m @ m.T
        union = sizes[:, None] + sizes[None, :] - inter
        i, j = np.nonzero(np.triu((100.0 * inter.astype(np.float64) >= percent * union.astype(np.float64)) & (inter > 0), 1))
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        links = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            u, v = find(int(comp[x])), find(int(comp[y]))
            if u != v:
                root[max(u, v)] = min(u, v)
                links.append((int(node[x]), int(node[y])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Documents link when 100 * intersection >= percent * union of their distinct five-word shingles
    (words `[^\\x20\\x09-\\x0D]+`, A-Z lowered); component_id is the smallest doc_id reachable.

    Equal sets first fall into one class by a 128-bit sum of their elements. Each band bucket then
    offers its smallest class to every other: those pairs are verified on whole texts and joined to
    components. A bucket that still holds several components has all its pairs settled exactly, in
    block pairs of bounded rows and bytes. So no pair in a bucket goes unchecked unless its two
    ends are joined already, and no group's pairs are ever written out.

    A null or empty text, or one of white space, has no shingles and stays alone. A null doc_id
    keeps its row, with a null component, and is kept. Repeated rows of one doc_id are one node: each
    gets its row, and whatever links any of them links the id. Other columns are not read.
    """
    docs = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = band_rows(percent / 100)
    seen = written(docs.mapInArrow(_sketched(rows), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"), "sketch")
    key = ["f1", "f2", "n_shingles"]
    classes = written(seen.where("n_shingles > 0 and doc_id is not null").groupBy(key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    # rows of one id with different texts are one node
    twice = seen.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    same = seen.join(twice, "doc_id").join(classes.drop("bands"), key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    slots = classes.select("rep", F.explode("bands").alias("bucket"))
    buckets = written(slots.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("bucket", "least"), "buckets")
    members = written(slots.join(buckets, "bucket").select("bucket", "least", "rep"), "members")
    stars = written(members.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    # the texts that stand in any pair, once; Spark drops most others by a Bloom filter of bounded size before they are shuffled
    needed = written(stars.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needed")
    with settings(docs.sparkSession, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0", spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold="64MB"):
        one = written(docs.join(needed.where(F.col("doc_id") >= F.lit(-(2**63))), "doc_id", "left_semi"), "texts", compression="zstd")
    text_b = stars.join(one.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    texts = text_b.join(one.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    links = written(texts.mapInArrow(_verified(percent), "a long, b long").distinct().unionAll(same), "links")
    found = written(components(links, "a", "b"), "found")

    # buckets whose members are still apart
    named = members.join(found.withColumnsRenamed({"node": "rep"}), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    apart = written(named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket"), "apart")
    if apart.limit(1).count():
        open_ = written(named.join(apart, "bucket"), "open")
        group = written(components(members.join(apart, "bucket").select("least", "rep"), "least", "rep"), "groups").withColumnsRenamed({"component": "grp"})
        sized = open_.select("rep", "component").distinct().join(one.select(F.col("doc_id").alias("rep"), "text"), "rep").join(group.withColumnsRenamed({"node": "rep"}), "rep")
        sized = written(sized.groupBy("rep", "component", "grp", F.xxhash64("text"), F.octet_length("text")).agg(F.min("text").alias("text")).select("rep", "component", "grp", "text"), "sized")
        many = sized.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).alias("n"))
        many = written(many, "many")
        placed = sized.join(many, "grp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n")))
        where = written(placed.select("rep", "grp", "block"), "where")
        touched = open_.join(where, "rep").select("bucket", "grp", "block").distinct()
        pairs = touched.withColumnRenamed("block", "x").join(touched.withColumnRenamed("block", "y"), ["bucket", "grp"]).where("x <= y").select("grp", "x", "y").distinct()
        pairs = written(pairs, "pairs")
        sides = pairs.select("grp", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
        full = sides.join(placed.select("grp", "block", "rep", "component", "text"), ["grp", "block"])
        full = full.select("grp", "x", "y", F.col("rep").alias("doc_id"), "component", F.when(F.col("block") == F.col("x"), 0).otherwise(1).alias("side"), "text")
        more = full.groupBy("grp", "x", "y").applyInArrow(_block_links(percent), "a long, b long")
        links = written(links.select("a", "b").unionAll(more), "links")
        found = written(components(links, "a", "b"), "found")
        for used in (open_, sized, many, where, pairs):
            forget(used)
    of = written(classes.select(*key, "rep").join(found.withColumnsRenamed({"node": "rep"}), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component")), "of")
    for used in (classes, buckets, members, stars, needed, one, links, found, apart):
        forget(used)
    out = seen.select("doc_id", *key).join(of, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
