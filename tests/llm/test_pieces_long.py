"""Texts of one very long word, against the library."""

import random
import time

import numpy as np
import pytest
import sentencepiece

from textloom.llm import pieces

R = random.Random(5)
LETTERS = "etaoinshrdlu"
LONG = {
    "letters": "".join(R.choice(LETTERS) for _ in range(60_000)),
    "spaces": " " * 30_000,
    "spaces and letters": "".join(R.choice(["  ", " " * 17, "a", "the", " " * 40]) for _ in range(6000)),
    "one letter": "a" * 30_000,
    "two letters": "ab" * 15_000,
    "unknown": "日本\U00010400é" * 5000,
    "words without spaces": "".join(R.choice(["the", "ing", "tion", "ness", "able"]) for _ in range(10_000)),
    "digits": "".join(R.choice("0123456789") for _ in range(20_000)),
    "lines": "\n" * 20_000 + "\t" * 5000,
    "marked": "▁" * 9000 + "x" + "▁" * 9000,
}


@pytest.fixture(scope="module")
def both():
    path = pieces.default_model()
    return pieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)


@pytest.mark.parametrize("name", LONG)
def test_long_words(both, name):
    own, library = both
    text = LONG[name]
    want = library.encode(text, add_bos=True, add_eos=True)
    (got,) = own.encode([text])
    assert got.tolist() == want and own.decode(got) == library.decode(want)


def test_long_and_short_words_together(both):
    own, library = both
    texts = [f"some words {LONG['letters'][:5000]} and   more", None, "", LONG["spaces"][:5000] + "x", "short"]
    assert [g.tolist() for g in own.encode(texts)] == [library.encode(t or "", add_bos=True, add_eos=True) for t in texts]


@pytest.mark.parametrize("text", ["".join(random.Random(2).choice(LETTERS) for _ in range(1_000_000)), " " * 1_000_000], ids=["letters", "spaces"])
def test_a_million_symbols_in_seconds(both, text):
    begin = time.perf_counter()
    (got,) = both[0].encode([text])
    assert time.perf_counter() - begin < 40 and len(got) > 2 and np.all(got >= 0)
