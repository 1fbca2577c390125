"""What the method adds to the base spans, and what it leaves."""

import random

import pytest

from textloom.llm import pii

R = random.Random(3)
NAMES = "anna bert carla dieter eva frank".split()


def digits(n):
    return "".join(R.choice("0123456789") for _ in range(n))


def phone():
    return f"{R.choice('23456789')}{digits(2)}-{digits(3)}-{digits(4)}"


def luhn(n):
    own = [int(c) for c in "4" + digits(n - 2)]
    total = sum(sum(divmod(d * 2, 10)) if k % 2 == 0 else d for k, d in enumerate(reversed(own)))
    return "".join(map(str, own)) + str(-total % 10)


def documents():
    out = []
    for k in range(240):
        name = R.choice(NAMES) + digits(2)
        real = [f"please call {phone()} today", f"write to {name} [at] mail [dot] org for it", f"my credit card {luhn(15)} was used", f"login from host 2001:0db8:85a3:{digits(4)}:0000:8a2e:0370:{digits(4)} seen"]
        other = [f"invoice # {phone()}", f"serial number order # {digits(15)}"]
        base = [f"mail {name}@site.com", f"phone +1 226 555 {digits(4)}", f"card {luhn(16)}", f"server 10.2.{R.randrange(256)}.{R.randrange(1, 256)} up"]
        out += [(len(out) + j, t, t in real, t in other) for j, t in enumerate([real[k % 4], other[k % 2], base[k % 4], "nothing to see here"])]
    return out


@pytest.fixture(scope="module")
def found(spark):
    rows = documents()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return {r.doc_id: r.spans for r in pii.personal_data(df).collect()}, rows


def test_loose_spans_with_good_votes_are_accepted(found):
    spans, rows = found
    by_kind = {}
    for i, text, real, _ in rows:
        if real:
            kind = next(k for k, w in (("phone", "call"), ("email", "write"), ("card", "credit"), ("ip", "login")) if w in text)
            by_kind.setdefault(kind, []).append(spans[i].startswith(f"{kind}:"))
    assert {k: sum(v) / len(v) >= 0.9 for k, v in by_kind.items()} == dict.fromkeys(("phone", "email", "card", "ip"), True)


def test_loose_spans_with_votes_against_them_are_left(found):
    spans, rows = found
    other = [spans[i] == "" for i, _, _, o in rows if o]
    assert sum(other) / len(other) >= 0.9
    assert all(spans[i] == "" for i, t, *_ in rows if t.startswith("nothing"))


def test_context_counts_on_both_sides(spark):
    df = spark.createDataFrame([(1, "212-555-1234 is my phone"), (2, "phone: 212-555-1234"), (3, "212-555-1234 it is")], "doc_id long, text string")
    got = {r.doc_id: r.spans_[0].votes >> 3 & 1 for r in pii.candidates(df, df.text).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_shapes_decide_where_votes_are_equal():
    # votes 0b00110 of both; only what touches the span tells one from the other
    good, bad, base, none = 0b000000110, 0b110000110, 0b000001111, 0b110010000
    c = pii.classifier_of({3: [(good, 200), (bad, 40), (base, 300), (none, 300)]})
    score = lambda bits: c.weights[3][0] + sum(w for k, w in enumerate(c.weights[3][1:]) if bits >> k & 1)
    assert score(good) > score(bad)
