"""The model queries against plain Python and numpy."""

import math
import random
import re
from collections import Counter

import numpy as np

from textloom.plans import registry as R

WORDS = "river stone garden winter letter quiet morning paper window travel market silver été œuvre 日本語 ß 𝒳𝒴".split()


def word_terms(t):
    ws = re.findall(r"\b\w\w+\b", t.lower())
    return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]


def char_terms(t):
    t = re.sub(r"\s\s+", " ", t.lower())
    return [t[i : i + k] for k in (3, 4, 5) for i in range(len(t) - k + 1)]


def matrix(train, texts, terms):
    """Sublinear TF-IDF in rows of length one, terms in two documents at least and 95 % at most."""
    df = Counter(g for t in train for g in set(terms(t)))
    vocabulary = sorted(g for g, n in df.items() if 2 <= n <= 0.95 * len(train))
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(at)))
    for k, t in enumerate(texts):
        for g, n in Counter(terms(t)).items():
            if g in at:
                x[k, at[g]] = (1 + math.log(n)) * (math.log((1 + len(train)) / (1 + df[g])) + 1)
        x[k] /= np.linalg.norm(x[k]) or 1
    return x


def fitted(x, y, w):
    """The weights, the intercept last, that minimise half their square and the weighted log loss: in the space of the rows, by Newton's method."""
    u, s, v = np.linalg.svd(x, full_matrices=False)
    z, b = np.column_stack([u * s, np.ones(len(x))]), np.zeros(len(s) + 1)
    ridge = np.ones(len(s) + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b += np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (w * (y - p)) - ridge * b)
    return v.T @ b[:-1], b[-1]


def texts_of(n, seed):
    r = random.Random(seed)
    # spelling and punctuation alone tell the labels apart
    return [r.choice([" ", "  ", "\n\n"]).join(r.choice(WORDS) + (r.choice(["!?", ";-"]) if y else ".") for _ in range(r.randrange(1, 25))) for y in (k % 3 == 0 for k in range(n))]


def test_tfidf_logistic_is_the_whole_model(spark, tmp_path):
    texts = [*texts_of(90, 1), "", "ab"]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 == 0), 0) for k in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(R.QUERIES["ml01_tfidf_logistic"](spark, str(tmp_path)).collect(), key=lambda r: r.id)
    assert [r.id for r in got] == list(range(len(texts)))
    on = np.array([r.split == "train" for r in got])
    y = np.array([r.label for r in got], float)
    train = [t for t, k in zip(texts, on, strict=True) if k]
    x = np.hstack([matrix(train, texts, word_terms), matrix(train, texts, char_terms)])
    share = y[on].mean()
    w, b = fitted(x[on], y[on], np.where(y[on] == 1, 0.5 / share, 0.5 / (1 - share)))
    assert np.abs(np.array([r.p for r in got]) - 1 / (1 + np.exp(-(x @ w + b)))).max() < 2e-5


def _newton(x, y, w, c=1.0):
    """A ridge logistic regression by Newton steps: weights, then the intercept, which is free."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1] - 1, 1.0 / c), 0.0)
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (w * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-12:
            break
    return beta


def test_logistic_is_the_ridge_solution(spark):
    from textloom.operators import models as N

    r = np.random.default_rng(1)
    x = r.normal(size=(300, 3))
    y = (r.random(300) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] - 1)))).astype(int)
    df = spark.createDataFrame([(i, *map(float, a), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, c double, label int")
    got = {v.id: v.p for v in N.scored(N.logistic(df, ["a", "b", "c"], iterations=200), df).collect()}
    n1 = y.sum()
    w = np.where(y == 1, 300 / (2 * n1), 300 / (2 * (300 - n1)))
    beta = _newton(x, y, w)
    want = 1 / (1 + np.exp(-(x @ beta[:3] + beta[3])))
    assert max(abs(got[i] - want[i]) for i in range(300)) < 1e-4


def test_calibration_is_platt_and_pooled_violators(spark):
    from textloom.operators import models as N

    r = np.random.default_rng(3)
    p = np.round(r.random(120), 3)
    y = (r.random(120) < p).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y, strict=True))], "id int, p double, label int")
    got = {v.id: (v.p_platt, v.p_isotonic) for v in N.calibrated(df, df).collect()}
    beta = _newton(p[:, None], y, np.ones(120))
    # pool adjacent violators over equal scores
    blocks = [[float(y[p == v].sum()), float((p == v).sum()), [v]] for v in np.unique(p)]
    out = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][0] / out[-2][1] >= out[-1][0] / out[-1][1]:
            last = out.pop()
            out[-1] = [out[-1][0] + last[0], out[-1][1] + last[1], out[-1][2] + last[2]]
    want = {v: b[0] / b[1] for b in out for v in b[2]}
    for i in range(120):
        assert abs(got[i][0] - 1 / (1 + np.exp(-(p[i] * beta[0] + beta[1])))) < 1e-4
        assert abs(got[i][1] - want[p[i]]) < 1e-9


def test_style_scales_are_population_deviations(spark):
    from textloom.operators import models as N

    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, 8.0, 5.0)], "id int, a double, b double")
    out, scales = N.style_matrix(df, ["a", "b"], "v")
    assert scales["a"] == np.std([1.0, 3.0, 8.0]) and scales["b"] == 1.0
    assert [v.v.tolist() for v in out.orderBy("id").collect()] == [[a / scales["a"], 5.0] for a in (1.0, 3.0, 8.0)]
