"""Vectors of an Arrow list column as numpy matrices, and k-means on bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str | Column) -> Column:
    """True for a vector that is there, not empty or zero, and free of null and non-finite components."""
    v = F.col(vector).cast("array<double>") if isinstance(vector, str) else vector
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the vectors in a column of usable ones."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[begin[rows][:, None] + np.arange(d)]


def sample(vectors: DataFrame, id_: str, vector: str, rows: int, seed: int) -> dict[int, np.ndarray]:
    """For each length, at most `rows` vectors in all, those of the smallest hashes: the bound of what models are fitted on."""
    some = vectors.orderBy(F.xxhash64(F.lit(seed), id_), id_).limit(rows).select(F.col(vector).alias("v")).toArrow()
    column = some.column("v").combine_chunks()
    return {m.shape[1]: m for _, m in matrices(column)} if len(column) else {}


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, for some rows at a time."""
    square = np.einsum("kd,kd->k", centres, centres)[None]
    parts = [(square - 2 * x[at : at + 1024] @ centres.T).argmin(axis=1) for at in range(0, len(x), 1024)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """At most k centres by Lloyd's rounds from distinct rows; an empty one keeps its place."""
    r = np.random.Generator(np.random.PCG64(seed))
    distinct = np.unique(x, axis=0)
    centres = distinct[r.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
    return centres
