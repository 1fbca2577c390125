"""Token files and SentencePiece coding against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from textloom.llm import pieces, tokens

pytest.importorskip("public_tokenizers")
ODD = [None, "", " ", "  a  b\tc\n\nd", "▁ x▁y", "日本語 текст 🙂", "<s> <unk> <0x0A>", "a" * 3000, "it's <|endoftext|> x\x1cy", "\x00", "don't — 'll 1234,word;next", "é" * 50 + "\r\n\r\n"]


def fuzz(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(["a", "the", " ", "  ", "\n", "é", "日", "🙂", "'s", "12", "!", ",", "x", "\t"]) for _ in range(r.randrange(50))) for _ in range(n)]


def test_variable_length_coding_round_trips():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 1001):
        v = np.array([r.randrange(2 ** r.randrange(1, 33)) for _ in range(n)], dtype=np.uint32)
        control, data = tokens.encode_values(v)
        assert len(control) == (n + 3) // 4
        assert (tokens.decode_values(control, data, n) == v).all()


def test_encoder_is_the_library():
    texts = [t or "" for t in ODD] + fuzz(500, 2)
    e = tokens.Encoder(tokens.default_tokenizer())
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts)] == want


def test_token_files(spark, tmp_path):
    texts = ODD + ["again"] * 2
    rows = [(k * 3, t, k) for k, t in enumerate(texts)] + [(0, "again", 99), (None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_values int").repartition(3)
    folder = tokens.write_tokens(df, f"file://{tmp_path}/t", segment_values=500)
    got = tokens.read_tokens(spark, folder).collect()
    lib = tokens.Encoder(tokens.default_tokenizer()).tokenizer
    at = 0
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(r[0] for r in rows if r[0] is not None)
    want = sorted((d, t or "") for d, t, _ in rows if d is not None)
    for r, (d, t) in zip(sorted(got, key=lambda r: r.start), want, strict=True):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (d, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_token_files_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.read_tokens(spark, tokens.write_tokens(empty, f"file://{tmp_path}/e")).count() == 0


def test_pieces_are_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    m = pieces.model(pieces.default_model())
    r = random.Random(3)
    texts = ODD + fuzz(500, 4) + ["".join(r.choice(m.pieces) for _ in range(r.randrange(20))) for _ in range(500)] + ["".join(r.choice(" ai") for _ in range(60)) for _ in range(100)]
    want = [[1, *ids, 2] for ids in sp.encode([t or "" for t in texts])]
    got = m.encode(texts)
    assert [g.tolist() for g in got] == want
    assert [m.decode(g) for g in got] == [sp.decode(w) for w in want]


def test_piece_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "héllo", 6)], "doc_id long, text string, ids int")
    got = sorted(pieces.encode_decode(df).collect(), key=lambda r: (r.doc_id is None, r.n_tokens))
    assert [(r.doc_id, r.n_tokens, r.decoded) for r in got] == [(1, 2, ""), (1, 2, ""), (None, got[2].n_tokens, "héllo")]
    assert got[2].ids_sha256 == hashlib.sha256(np.array(got[2].ids, "<u4").tobytes()).hexdigest()
    assert pieces.encode_decode(df.limit(0)).count() == 0
