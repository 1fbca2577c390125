"""Source divergence against plain Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm.divergence import SCALE, _p, source_divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least_docs=3, top=200):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + SCALE * (c[t] + 1) // total for t in kept}

        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        p = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if count[lang, s][t] and p[s][t] > whole[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:limit], 1)]
    return out


def rows_of(spark, rows, **parameters):
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    return [tuple(r) for r in source_divergence(docs, **parameters).select("lang", "source", "part", "item", "value", "rank").collect()]


CASES = [
    ("The cat, the CAT's hat", "en", "a"),
    ("the hat 12 é Ünder über", "en", "b"),
    ("the cat\x7fhat 𝒳𝒴 ünder", "en", None),
    ("the hat ünder", "en", "b"),
    ("the hat ünder", "en", "b"),
    (None, "en", "empty"),
    ("", None, "x"),
    ("12 34 [] {}", None, None),
    ("allein allein", "de", "a"),
    ("allein zwei", "de", "a"),
    ("allein", "de", "a"),
    ("un deux", "fr", "a"),
    ("trois", "fr", "b"),
]


def test_cases(spark):
    got = rows_of(spark, CASES)
    assert sorted(map(repr, got)) == sorted(map(repr, plain(CASES)))
    # without kept terms a pair has the value 0; a language of one source has no rows
    assert {("fr", "a", "pair", "b", 0, 1), ("fr", "b", "pair", "a", 0, 1)} <= set(got)
    assert not [r for r in got if r[0] == "de"]


@pytest.mark.parametrize("sizes", [{}, {"tile": 7, "matrix": 1}, {"tile": 40, "matrix": 24, "top": 5}])
def test_blocks_slabs_and_heaps(spark, sizes):
    r = random.Random(11)
    words = ["".join(r.choice("abcdé") for _ in range(r.randrange(1, 4))) for _ in range(80)]
    rows = [(" ".join(r.choices(words, k=r.randrange(40))), r.choice(["en", "en", "en", "de"]), f"s{min(r.randrange(12), r.randrange(12))}") for _ in range(150)]
    assert sorted(rows_of(spark, rows, **sizes)) == sorted(plain(rows, top=sizes.get("top", 200)))


def test_a_very_long_text_and_clashing_names(spark):
    rows = [("word " * 50_000 + "tail", "en", "a", 1), ("tail word", "en", "b", 2), ("word tail", "en", "b", 3)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string, term int")
    got = [tuple(r) for r in docs.transform(source_divergence).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == sorted(plain([r[:3] for r in rows]))


def test_no_documents(spark):
    assert rows_of(spark, []) == []


def test_shares_of_large_counts():
    count, total = np.array([0, 7, 10**12, 8 * 10**15 - 1]), np.array([3, 3 * 10**15, 2 * 10**12, 8 * 10**15])
    assert _p(count, total).tolist() == [1 + SCALE * (int(c) + 1) // int(t) for c, t in zip(count, total, strict=True)]
