"""Line dedup against a plain loop."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm.lines import drop_repeated_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least_chars=10, least_docs=2):
    """{(id, text): (kept, n, dropped)} of (id, text) rows; the document without id comes last."""
    rank = lambda i: (i is None, i or 0)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(rank(i))
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs or min(holders[key(x)]) == rank(i)]
        out[i, t] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def check(spark, rows, **parameters):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = drop_repeated_lines(docs.withColumn("raw", F.col("text")), **parameters).collect()
    want = plain(rows, **{k: v for k, v in parameters.items() if k != "hot"})
    assert sorted((repr((r.doc_id, r.raw)), r.text, r.n_lines, r.n_dropped) for r in got) == sorted((repr(k), *want[k]) for k in rows)


CASES = [
    (3, "Shared line of text\nown line three here\n  SHARED LINE of text\t"),
    (2, "shared line of text\r\nshort\nshared line of text"),
    (2, "shared line of text\r\nshort\nshared line of text"),
    (2, "another text of the same id\nown line three here"),
    (7, None),
    (8, ""),
    (9, "\n\n"),
    (None, "shared line of text\nonly without an id\nonly without an id"),
    (None, "only without an id"),
    (10, "ÄÖ ÜBER dem Fluss\nshort"),
    (11, "äö über dem fluss\nÄÖ über DEM Fluss\nshort"),
    (12, "own line three here\nshared line of text"),
    (13, "\x85shared line of text"),
    (14, "tenletters\nnineletts"),
    (15, "TENLETTERS\nNINELETTS\n"),
]


@pytest.mark.parametrize("hot", [4096, 0])
@pytest.mark.parametrize("least_docs", [2, 3])
def test_cases(spark, hot, least_docs):
    check(spark, CASES, hot=hot, least_docs=least_docs)


@pytest.mark.parametrize("hot", [4096, 3])
def test_random_texts(spark, hot):
    r = random.Random(5)
    pool = [f"line number {k} of many" for k in range(40)] + ["", "x", "Line Number 3 of many "]
    check(spark, [(i, "\n".join(r.choice(pool if r.random() < 0.9 else ["line number 0 of many"]) for _ in range(r.randrange(30)))) for i in range(200)], hot=hot)


def test_a_very_long_text(spark):
    long = "\n".join(f"sentence number {k % 70_000}" for k in range(100_000))
    check(spark, [(1, "sentence number 5\nsentence number 69999"), (2, long), (3, long[:1000])])


def test_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "a line to repeat", "x", 5), (2, "b", "a line to repeat", None, 6)], "doc_id long, n_lines string, text string, d_ string, a_ int")
    got = drop_repeated_lines(docs)
    assert got.columns == ["doc_id", "text", "d_", "a_", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect())) == [(1, "a line to repeat", "x", 5, 1, 0), (2, "", None, 6, 1, 1)]
    assert drop_repeated_lines(docs.where("false")).collect() == []
