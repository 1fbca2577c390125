"""The registered queries themselves: against their SQL, or against brute force on the small tables."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from textloom.llm import queries as Q

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return sorted((r.doc_id, r.text or "", r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect())


@pytest.fixture(scope="module")
def vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    return {r.vec_id: np.array(r.embedding, float) for r in rows if r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding)}


def run(spark, sf, name):
    return Q.QUERIES[name](spark, sf).collect()


def rows_of(names, rows):
    at = [names.index(c) for c in sorted(names)]
    return sorted(repr(tuple(r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, sf), con.sql(Q.SQL[name])
    assert rows_of(got.columns, map(tuple, got.collect())) == rows_of(list(want.columns), want.fetchall())


def components(ids, links):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op1_finds_most_neighbours_with_their_distances(spark, sf, vectors):
    got = defaultdict(list)
    for r in sorted(run(spark, sf, "op1_nearest_neighbours"), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    own = {i: v for i, v in vectors.items() if v.any()}
    assert set(got) == {i for i in own if i % 100 == 0}
    ids, x = np.array(list(own)), np.array(list(own.values()))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - own[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        assert [s for _, s in found] == pytest.approx([np.sqrt(((own[i] - own[q]) ** 2).sum()) for i, _ in found])
        assert found == sorted(found, key=lambda p: (p[1], p[0])) and len(found) == 10
        hits += len({i for i, _ in found} & {int(ids[k]) for k in np.lexsort((ids, d))[:10]})
    assert hits >= 0.9 * 10 * len(got)


def test_op3_files_hold_the_librarys_ids(spark, sf, docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(_path("byte_bpe_50k.json"))
    got, start = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, sf, "op3_token_files")}, 0
    for i, t, *_ in docs:
        ids = [*model.encode(t, add_special_tokens=False).ids, 0]
        assert got[i] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def _path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_op4_scores_every_document(spark, sf, docs):
    got = run(spark, sf, "op4_toxicity")
    assert sorted(r.doc_id for r in got) == [d[0] for d in docs]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_op5_takes_what_it_aims_at(spark, sf, docs):
    got = {r.doc_id: r for r in run(spark, sf, "op5_mixing")}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, *_ in docs}
    assert {i: r.size for i, r in got.items()} == size
    by, taken, target = defaultdict(int), defaultdict(int), {}
    for i, _, _, s in docs:
        by[s] += size[i]
        taken[s] += got[i].taken
        target[s] = got[i].target
        assert got[i].taken <= 2 * size[i]
    assert all(got[i].source_size == by[s] for i, _, _, s in docs)
    assert sum(target.values()) == pytest.approx(min(1.5, 2) * sum(by.values()), rel=1e-6)
    assert all(abs(taken[s] - target[s]) <= max(0.05 * target[s], 2 * max(size.values())) for s in target)


def test_op6_keeps_the_base_emails(spark, sf, docs):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    got = {r.doc_id: r for r in run(spark, sf, "op6_personal_data")}
    for i, t, *_ in docs:
        own = [f"email:{m.start()}:{m.end()}" for m in email.finditer(t)]
        spans = got[i].spans.split(",") if got[i].spans else []
        assert got[i].n_email == len(own) and set(own) <= set(spans)


def test_op7_links_are_those_of_all_pairs(spark, sf, vectors):
    own = {i: v / np.linalg.norm(v) for i, v in vectors.items() if v.any()}
    ids, x = list(own), np.array(list(own.values()))
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    links = [(ids[p], ids[q]) for p, q in zip(a, b, strict=True)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in run(spark, sf, "op7_vector_near_dedup")}
    n = defaultdict(int)
    for p, q in links:
        n[p] += 1
        n[q] += 1
    want = components(got, links)
    assert got == {i: (n[i], want[i], want[i] == i) for i in got} and set(ids) <= set(got)


def test_op8_returns_every_page(spark, sf):
    got = run(spark, sf, "op8_html_extraction")
    assert len(got) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) for r in got) and sum(bool(r.text) for r in got) > 0.9 * len(got)


def test_op9_is_the_library(spark, sf, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=_path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, sf, "op9_sentencepiece")}
    for i, t, *_ in docs:
        ids = model.encode(t, add_bos=True, add_eos=True)
        assert got[i] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())


def test_op10_links_are_those_of_all_pairs(spark, sf, docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(ids, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in run(spark, sf, "op10_minhash_near_dedup")}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_op11_whitens_every_vector(spark, sf, vectors):
    x = {i: np.floor(64 * v).astype(int) + 1_000_000 for i, v in vectors.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    c = fit - total / n
    values = np.linalg.eigvalsh(c.T @ c / n)[::-1]
    got = run(spark, sf, "op11_embedding_whitening")
    assert len(got) == 16 * len(x) and len({(r.vec_id, r.component) for r in got}) == len(got)
    for r in got:
        assert r.n == n and r.deviation == int(((n * x[r.vec_id] - total) ** 2).sum()) and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    assert sum(r.whitened**2 for r in got) == pytest.approx(16 * n, rel=1e-6)
