"""The stopping test ends searches early, at the stated recall."""

import numpy as np

from textloom.llm import ann


def shard(n, d, directions, seed, repeat=0):
    r = np.random.Generator(np.random.PCG64(seed))
    v = r.standard_normal((n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    project = r.standard_normal((d, directions))
    leaves = ann.kd_leaves(v @ project, ann.LEAF)
    place = np.concatenate(leaves)
    p = (v @ project)
    boxes = np.stack([np.stack([p[rows].min(axis=0), p[rows].max(axis=0)]) for rows in leaves])
    member = np.sort(np.concatenate([np.arange(n), r.integers(0, n, repeat)]))
    return v[place], project, member, np.array([len(x) for x in leaves]), boxes


def brute(v, ids, member, q, qid, k):
    d = np.sqrt(((v[member] - q) ** 2).sum(axis=1))
    d[ids == qid] = np.inf
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


def test_searches_stop_early_and_find_nearly_all():
    v, project, member, sizes, boxes = shard(6000, 64, 24, 1, repeat=300)
    ids = np.random.Generator(np.random.PCG64(2)).permutation(len(member)).astype(np.int64)
    rows = np.arange(0, 6000, 60)
    first = np.searchsorted(member, rows)
    score, best, verified = ann.search_shard(v[rows], ids[first], np.full(len(rows), np.inf), project, v, ids, member, sizes, boxes, ann.chi_square_quantile(0.95, 24), 10)
    hits = 0
    for n, row in enumerate(rows):
        names, d = brute(v, ids, member, v[row], ids[first[n]], 10)
        hits += len(set(names.tolist()) & set(best[n].tolist()))
        assert np.all(score[n] >= d - 1e-12) and np.all(np.diff(score[n]) >= 0)
    assert hits / (10 * len(rows)) >= 0.95
    assert verified.max() < 6000 and verified.mean() < 0.75 * 6000
    # a bound from elsewhere lets it stop earlier still, and no stopping test never does
    bounded = ann.search_shard(v[rows], ids[first], score[:, -1], project, v, ids, member, sizes, boxes, ann.chi_square_quantile(0.95, 24), 10)
    assert bounded[2].sum() < verified.sum() and np.mean([len(set(a) & set(b)) for a, b in zip(bounded[1].tolist(), best.tolist(), strict=True)]) > 9.5
    whole = ann.search_shard(v[rows], ids[first], np.full(len(rows), np.inf), project, v, ids, member, sizes, boxes, np.inf, 10)
    assert (whole[2] == 6000).all()
    for n, row in enumerate(rows):
        names, d = brute(v, ids, member, v[row], ids[first[n]], 10)
        assert whole[1][n].tolist() == names.tolist() and np.allclose(whole[0][n], d)


def test_near_copies_end_a_search_at_once():
    r = np.random.Generator(np.random.PCG64(3))
    v, project, member, sizes, boxes = shard(4000, 32, 8, 4)
    q = v[:20] + 1e-3 * r.standard_normal((20, 32))
    bound = np.full(20, 0.02)
    score, best, verified = ann.search_shard(q, np.full(20, -1), bound, project, v, np.arange(4000), member, sizes, boxes, ann.chi_square_quantile(0.95, 8), 1)
    assert best[:, 0].tolist() == list(range(20)) and verified.mean() < 40
