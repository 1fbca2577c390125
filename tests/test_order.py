"""Positions over tables larger than a range exchange's sample."""

import pytest
from pyspark.sql import functions as F

from textloom.operators.order import positions


@pytest.fixture(params=[8, 200])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def rows(spark):
    """100,000 rows; a third of them in one group, a null group, and a column that is not needed for the order."""
    g = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 97))
    return spark.range(100_000).select("id", F.xxhash64("id").alias("k"), g.alias("g"), F.md5(F.col("id").cast("string").cast("binary")).alias("extra"))


def test_positions_over_all_rows(rows, partitions):
    got = positions(rows, ["k"]).select("k", "position").collect()
    assert [k for k, _ in sorted(got, key=lambda r: r[1])] == sorted(r.k for r in rows.select("k").collect())
    assert sorted(r.position for r in got) == list(range(1, 100_001))


def test_positions_within_groups(rows, partitions):
    got = positions(rows, [-F.col("k")], ["g"], "n").select("g", "k", "n").toPandas()
    assert len(got) == 100_000
    got["g"] = got["g"].fillna("")
    want = got.sort_values("k", ascending=False).groupby("g").cumcount() + 1
    assert (want.sort_index() == got["n"]).all()


def test_positions_of_no_rows(rows, partitions):
    assert positions(rows.where("id < 0"), ["k"], ["g"]).collect() == []
    assert positions(rows.where("id < 0"), ["k"]).columns == [*rows.columns, "position"]
