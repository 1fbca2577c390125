"""Whitening against numpy and Python's integers."""

import math

import numpy as np
import pytest

from textloom.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, components=16):
    """{id: deviation}, and of the fit: n, eigenvalues, trace, rows centred by id."""
    x = {}
    for i, v, _ in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            x[i] = tuple(math.floor(64 * float(c)) + 1_000_000 for c in np.array(v, np.float32))
    fit = sorted(set(x.values()))
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(v, total, strict=True)) for i, v in x.items()}
    centre = lambda v: np.array([float(c - s // n) - (s % n) / n for c, s in zip(v, total, strict=True)])
    c = np.array([centre(v) for v in fit])
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    return n, deviation, values[::-1][:components], axes.T[::-1][:components], np.trace(v), {i: centre(r) for i, r in x.items()}


def check(spark, rows, components=16):
    got = whiten(spark.createDataFrame(rows, SCHEMA), components=components).collect()
    n, deviation, values, axes, trace, centred = plain(rows, components)
    assert len(got) == len(values) * sum(r[0] in centred for r in rows)
    for r in got:
        k = r.component - 1
        assert r.n == n and int(r.deviation) == deviation[r.vec_id]
        assert r.explained == pytest.approx(values[k] / trace, rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(axes[k] @ centred[r.vec_id]) / math.sqrt(values[k]), abs=1e-7)
        assert r.identity_error < 1e-9 and r.identity_error == got[0].identity_error
    # one sign for all rows of a component
    for k in {r.component for r in got}:
        signs = {np.sign(r.whitened * (axes[k - 1] @ centred[r.vec_id])) for r in got if r.component == k and abs(r.whitened) > 1e-6}
        assert len(signs) == 1


def test_random_vectors_with_nulls_and_repeats(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(300, 20)) * np.linspace(1, 3, 20) + 5
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[i][1], 1) for i in range(40)] + [rows[3], rows[3]]
    rows += [(2000, None, 0), (2001, [None, *rows[0][1][1:]], 0), (2002, [float("nan"), *rows[0][1][1:]], 0), (2003, [float("inf"), *rows[0][1][1:]], 0), (2004, [0.0] * 20, 0)]
    check(spark, rows)


def test_large_entries_stay_exact(spark):
    r = np.random.default_rng(4)
    check(spark, [(i, [float(c) for c in v], 0) for i, v in enumerate(r.normal(size=(50, 4)) * 1e9)], components=4)


def test_fewer_components_than_asked_for(spark):
    rows = [(i, [float(i), float(2 * i), 1.0], 0) for i in range(10)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(i, 1) for i in range(10)]
    assert all(r.explained == pytest.approx(1) for r in got)


def test_equal_empty_and_no_vectors(spark):
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, [], 0), (2, None, 0)], SCHEMA)).collect() == []
    none = whiten(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_clashing_columns_null_ids_and_two_lengths(spark):
    rows = [(None, [1.0, 2.0], 1, 2), (1, [3.0, 1.0], 1, 2), (2, [0.5, 0.0], 1, 2), (3, [1.0], 1, 2), (4, [2.0], 1, 2)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, x_ int")).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 3), (0, 2, 3), (1, 1, 3), (1, 2, 3), (2, 1, 3), (2, 2, 3), (3, 1, 2), (4, 1, 2)]
