"""Exact order statistics in passes over a column, against sorting it."""

import random
from statistics import quantiles

import pytest
from pyspark.sql import functions as F

from stepfold.operators import leaderboard

RNG = random.Random(4)
COLUMNS = {
    "distinct": [RNG.uniform(-1e6, 1e6) for _ in range(3000)],
    "two values": [RNG.choice([0.0, 1.0]) for _ in range(3000)],
    "one value": [7.5] * 2000,
    "heavy tail": [RNG.paretovariate(0.3) for _ in range(3000)] + [1.0] * 500 + [-1e300, 1e300],
    "few": [3.0, 1.0, 2.0],
}


@pytest.mark.parametrize("name", COLUMNS)
@pytest.mark.parametrize("accuracy,at_once", [(10_000, 100), (8, 5)])
def test_ranks(spark, monkeypatch, name, accuracy, at_once):
    monkeypatch.setattr(leaderboard, "ACCURACY", accuracy)
    values = COLUMNS[name]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double").repartition(3)
    n = len(values)
    ranks = sorted({0, n // 4, n // 2, 3 * n // 4, n - 1})
    got = leaderboard.order_statistics(df, F.col("v"), [*ranks, n, -1], at_once)
    assert got == {r: sorted(values)[r] for r in ranks}


def test_described(spark):
    values = COLUMNS["distinct"][:501]
    got = leaderboard.described(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert [got.p25, got.p50, got.p75] == pytest.approx(quantiles(values, n=4, method="inclusive")) and got["count"] == 501
    empty = leaderboard.described(spark.createDataFrame([], "v double"), "v").first()
    assert empty["count"] == 0 and empty.p50 is None
