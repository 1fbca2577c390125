"""Allocators of groups against a plain walk over all of them."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from textloom.operators import splits as S
from textloom.operators.carry import carried


def rows(seed, n=300):
    r = random.Random(seed)
    return [(k, r.choice([0, 0, 1, 2, 5]), r.choice([0, 1, 1, 3])) for k in range(n)]


@pytest.fixture(params=[1, 2, 3])
def groups(request, spark):
    own = rows(request.param)
    return own, spark.createDataFrame(own, "g int, n0 long, n1 long").repartition(4)


WANT = {"probe": {"0": 6, "1": 9}, "dev": {"0": 3, "1": 0}, "train": {"0": 20, "1": 14}}


def test_greedy(groups):
    own, df = groups
    held, want = {s: [0, 0] for s in WANT}, {}
    for g, *n in own:
        best, most = None, -1
        for s, t in WANT.items():
            gain = sum(min(n[k], max(0, t[str(k)] - held[s][k])) for k in (0, 1))
            if gain > most:
                best, most = s, gain
        want[g] = best
        held[best] = [a + b for a, b in zip(held[best], n, strict=True)]
    assert {r.g: r.split for r in S.greedy_groups(df, WANT, {"0": "n0", "1": "n1"}, ["g"]).collect()} == want


def test_scored(groups):
    own, df = groups
    held, want = {s: [0, 0] for s in WANT}, {}
    for g, *n in own:
        def score(s):
            useful = sum(min(n[k], max(0, WANT[s][str(k)] - held[s][k])) for k in (0, 1))
            over = sum(max(0, held[s][k] + n[k] - WANT[s][str(k)]) for k in (0, 1) if n[k])
            return useful, max(0, sum(WANT[s].values()) - sum(held[s])), -over, {"dev": 2, "probe": 1, "train": 0}[s]

        want[g] = max(WANT, key=score)
        held[want[g]] = [a + b for a, b in zip(held[want[g]], n, strict=True)]
    assert {r.g: r.split for r in S.scored_groups(df, WANT, {"0": "n0", "1": "n1"}, ["g"], ["train", "probe", "dev"]).collect()} == want


@pytest.mark.parametrize("ranges", [3, 40])
def test_capped(groups, ranges):
    own, df = groups
    held, want = [0, 0], {}
    for g, *n in own:
        fits = held[0] + n[0] <= 7 and held[1] + n[1] <= 12
        want[g] = "dev" if fits else "train"
        held = [a + b for a, b in zip(held, n, strict=True)] if fits else held
    assert {r.g: r.split for r in S.capped_groups(df, {"n0": 7, "n1": 12}, ["g"], ranges).collect()} == want


def test_until(groups):
    own, df = groups
    held, want = [0, 0], {}
    for g, *n in own:
        want[g] = any(n[k] > 0 and held[k] < t for k, t in enumerate((11, 25)))
        held = [a + b for a, b in zip(held, n, strict=True)] if want[g] else held
    assert {r.g: r.selected for r in S.groups_until(df, {"n0": 11, "n1": 25}, ["g"]).collect()} == want


def test_a_walk_over_many_rows_goes_by_ranges(spark):
    """100,000 rows whose choices all hang on the ones before, none of the tasks with an eighth of them."""
    r = random.Random(9)
    own = [(k, r.randrange(4)) for k in range(100_000)]
    df = spark.createDataFrame(own, "g int, n long").repartition(5)

    def choose(state, row):
        state[0] = (state[0] * 31 + row["n"]) % 1009
        return state[0]

    got = carried(df, ["g"], [7], choose, "v", LongType())
    state, want = 7, {}
    for g, n in own:
        want[g] = state = (state * 31 + n) % 1009
    assert {r.g: r.v for r in got.collect()} == want
    files = [f for f in spark.read.parquet(*got.inputFiles()).groupBy(F.input_file_name()).count().collect()]
    assert max(f["count"] for f in files) < 100_000 / 8


def test_an_empty_table_has_no_walk(spark):
    assert carried(spark.createDataFrame([], "g int, n long"), ["g"], [0], lambda s, r: 0, "v", LongType()).collect() == []


@pytest.mark.parametrize(("exact_limit", "target", "minimums"), [(3, 14, {"a": 4, "b": 2}), (-1, 5, {"b": 3}), (0, 40, {}), (2, 0, {"c": 100})])
def test_unique_fill_is_the_scan(spark, exact_limit, target, minimums):
    r = random.Random(exact_limit + target)
    own = [(k, r.choice([None, *range(15)]), r.choice(["t", None, *map(str, range(20))]), r.choice("abc"), r.random() < 0.2) for k in range(60)]
    df = spark.createDataFrame(own, "id int, g int, t string, b string, e boolean").repartition(3)
    groups, texts, taken = set(), set(), []

    def add(row):
        if row[1] not in groups and row[2] not in texts:
            groups.add(row[1])
            texts.add(row[2])
            taken.append(row)

    exact, rest = [x for x in own if x[4]], [x for x in own if not x[4]]
    for x in exact if exact_limit < 0 else exact[:exact_limit]:
        add(x)
    for b, least in minimums.items():
        for x in rest:
            if x[3] == b and sum(y[3] == b for y in taken) < least:
                add(x)
    for x in rest:
        if len(taken) < target:
            add(x)
    got = S.unique_fill(df, "g", "t", "b", "e", target, minimums, exact_limit, ["id"]).collect()
    assert sorted(x.id for x in got if x.selected) == sorted(x[0] for x in taken) and len(got) == 60
