"""Whitening of embeddings by MLlib's singular values of the centred rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import written
from textloom.llm.vectors import matrices

SCALE, SHIFT = 64, 1_000_000
#: What an entry times 64 must stay below for x to be a long.
LARGEST = 2.0**62
#: Singular values below this part of the largest are rounding of the Gramian.
LEAST = 3e-7
BASE = 10**18


def _whole_numbers(rows: DataFrame, vector: str) -> DataFrame:
    """rows with x_: floor(64 * c) + 1000000 of each entry; without rows whose vector is null, holds a null or a non-finite entry, or one beyond a long."""
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * SCALE))
    fine = F.forall(F.col(vector).cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / SCALE))
    return rows.where(F.coalesce(fine, F.lit(False))).withColumn("x_", F.transform(scaled, lambda v: v.cast("long") + SHIFT))


def _exact(x: np.ndarray, terms: int) -> np.ndarray:
    """x, as Python's integers where sums of so many terms as large as its largest would leave 64 bits."""
    return x if not x.size or int(np.abs(x).max()) * terms < 2**62 else x.astype(object)


def _deviations(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """sum over dimensions of (n * x - S) ** 2, exactly; S = n * whole + rest."""
    d = x - whole
    largest = n * (int(np.abs(d).max()) + 1) if d.size else 0
    if largest**2 * x.shape[1] >= 2**62:
        d, rest = d.astype(object), rest.astype(object)
    z = d * n - rest
    return (z * z).sum(axis=1)


class Whitener:
    """The fit of vectors of one length: n distinct ones with means whole + rest / n, the axes of their covariance and its eigenvalues."""

    def __init__(self, fit: DataFrame, d: int, components: int):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros(d, object)
            for batch in batches:
                for rows, x in _wholes(batch.column(0)):
                    n += len(rows)
                    total = total + _exact(x, len(rows)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(d)], pa.int32()), pa.array([str(v) for v in (n, *total)])], ["i", "s"])

        # d + 1 rows
        got = dict(fit.select("x_").mapInArrow(sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
        self.n = int(got.get(-1, 0))
        total = [int(got.get(i, 0)) for i in range(d)]
        self.whole = np.array([s // self.n if self.n else 0 for s in total], np.int64)
        self.rest = np.array([s % self.n if self.n else 0 for s in total], np.int64)
        self.d, self.axes, self.values, self.trace, self.error = d, np.zeros((0, d)), np.zeros(0), 0.0, None
        if self.n and d:
            self._decompose(fit, components)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: a difference of integers less a fraction below one."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def _decompose(self, fit: DataFrame, components: int) -> None:
        whole = F.array(*(F.lit(int(v)) for v in self.whole))
        part = F.array(*(F.lit(float(v)) for v in self.rest / self.n))
        rows = fit.select(array_to_vector(F.zip_with(F.zip_with("x_", whole, lambda x, w: (x - w).cast("double")), part, lambda x, r: x - r)).alias("v"))
        # all singular values, so that the local decomposition of the Gramian runs to double precision and not to an iteration's tolerance
        svd = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v")).computeSVD(self.d, computeU=False, rCond=LEAST)
        values = svd.s.toArray() ** 2 / self.n
        self.values = values[values > 0][:components]
        self.axes = svd.V.toArray().T[: len(self.values)]
        self._moments(fit)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes.T / np.sqrt(self.values)

    def _moments(self, fit: DataFrame) -> None:
        """The trace of the covariance, from exact deviations, and how far the whitened rows' covariance is from the identity."""
        k, own = len(self.values), self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            exact, products, sums = 0, np.zeros((k, k)), np.zeros(k)
            for batch in batches:
                for _, x in _wholes(batch.column(0)):
                    exact += int(_deviations(x, own.n, own.whole, own.rest).sum(dtype=object))
                    w = own.whitened(x)
                    products += w.T @ w
                    sums += w.sum(axis=0)
            digits = []
            while exact:
                exact, low = divmod(exact, BASE)
                digits.append(low)
            at = [*range(-len(digits), 0), *range(k * k + k)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([*digits[::-1], *[0] * (k * k + k)], pa.int64()), pa.array([0.0] * len(digits) + [*products.ravel(), *sums], pa.float64())], ["i", "digit", "v"])

        # rows by power of BASE and by pair of components
        parts = fit.select("x_").mapInArrow(run, "i int, digit long, v double").groupBy("i")
        got = {r["i"]: (int(r["digit"]), r["v"]) for r in parts.agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit"), F.sum("v").alias("v")).collect()}
        self.trace = float(sum(v[0] * BASE ** (-i - 1) for i, v in got.items() if i < 0) / self.n**3)
        if k:
            both = np.array([got[i][1] for i in range(k * k + k)]) / self.n
            # rows are centred before they are multiplied; what rounding leaves of their mean goes here
            self.error = float(np.abs(both[: k * k].reshape(k, k) - np.outer(both[k * k :], both[k * k :]) - np.eye(k)).max())


def _wholes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of int64) for each length of the vectors in a column."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[begin[rows][:, None] + np.arange(d)].astype(np.int64)


def whiten(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): every vector on each of the first principal components, at unit variance.

    An entry c counts as x = floor(64 * c) + 1000000. The fit is over distinct x vectors, n of them with sums S: components are the unit eigenvectors
    of their covariance (divisor n), numbered from 1 by falling eigenvalue e; `whitened` is x - S / n on the component over sqrt(e), `deviation` the
    sum of (n * x - S) ** 2 as an exact decimal without fraction (null beyond 38 digits), `explained` e over the covariance's trace, which comes from
    the deviations, and `identity_error` the largest entry of the whitened fit rows' covariance minus the identity.

    Vectors that are null or hold a null or non-finite entry have no rows, nor has one with an entry beyond 2 ** 56, whose x is no long. Repeated rows
    and null ids are rows like others. Vectors of another length are another fit. There are fewer components than asked for where there are fewer
    dimensions or the distinct vectors span fewer (singular values below 3e-7 of the largest are none), so no rows where all vectors are equal. Other
    columns are left aside.

    Distinct rows are written once and read for sums, for the decomposition and for the moments; rows stay distributed, and only numbers by dimension
    or pair of dimensions reach the driver.
    """
    rows = _whole_numbers(vectors.select(F.col(id_).alias("i_"), F.col(vector).alias("v_")), "v_").select("i_", "x_")
    fit = written(rows.select("x_").distinct(), "whitening")
    lengths = sorted(r[0] for r in fit.select(F.size("x_")).distinct().collect())
    kind = vectors.schema[id_].dataType.simpleString()
    fields = f"i_ {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    done = [_projected(rows.where(F.size("x_") == d), Whitener(fit.where(F.size("x_") == d), d, components), fields) for d in lengths if d]
    out = reduce(DataFrame.unionAll, done) if done else vectors.sparkSession.createDataFrame([], fields)
    return out.withColumnRenamed("i_", id_)


def _projected(rows: DataFrame, model: Whitener, fields: str) -> DataFrame:
    k = len(model.values)
    explained = model.values / model.trace if k else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _wholes(batch.column(1)):
                n = len(at) * k
                deviation = [str(v) if v < 10**38 else None for v in _deviations(x, model.n, model.whole, model.rest).tolist()]
                columns = [
                    batch.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(n, model.n)),
                    pa.array(deviation, pa.string()).cast(pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(explained, len(at))),
                    pa.array(np.full(n, model.error if k else 0.0)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["i_", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, fields)
