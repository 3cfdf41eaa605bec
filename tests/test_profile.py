"""Column statistics and exact quantiles against plain Python and Spark's own percentile."""

import random

import pytest
from pyspark.sql import functions as F

from hearthlens.operators import profile

PS = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]


def wanted(df, cols):
    row = df.agg(*[F.percentile(F.col(c).cast("double"), p) for c in cols for p in PS]).first()
    return {c: {p: row[len(PS) * i + j] for j, p in enumerate(PS)} for i, c in enumerate(cols)}


@pytest.mark.parametrize("held", [1, 7, 10_000])
def test_quantiles_of_few_rows(spark, held):
    rng = random.Random(held)
    # A third of a column is one value; others are NULL, far apart, alike, or alone.
    rows = [(rng.choice([1.5, rng.random(), None]), 10.0 ** rng.randrange(-300, 300), 7, None, i // 2) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c int, d double, e long")
    got = profile.exact_quantiles(df, list("abcde"), PS, held)
    for c, values in wanted(df, list("abcde")).items():
        assert got[c] == {p: v if v is None else pytest.approx(v, rel=1e-12) for p, v in values.items()}, c


def test_quantiles_of_none_one_and_nan(spark):
    df = spark.createDataFrame([(1.0, 3.0), (float("nan"), None)], "a double, `b.c` double")
    got = profile.exact_quantiles(df, ["a", "b.c"], [0.0, 1.0])
    assert got["a"][0.0] == 1.0 and got["a"][1.0] != got["a"][1.0] and got["b.c"] == {0.0: 3.0, 1.0: 3.0}
    assert profile.exact_quantiles(df.limit(0), ["a"], [0.5]) == {"a": {0.5: None}}
    assert profile.describe(df.limit(0), ["a"]).count() == 0


def test_quantiles_of_ten_million_values_hold_few(spark):
    n = 10_000_000
    rows = spark.range(n, numPartitions=16)
    # Each number once in a mixed order, squared so that they crowd at one end, and a column of which most is one value.
    mixed = (F.col("id") * 7_368_787) % n
    df = rows.select((mixed * mixed).cast("double").alias("a"), F.when(mixed < n * 0.7, 0.5).otherwise(mixed.cast("double")).alias("b"))
    got = profile.exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75])
    for p in (0.25, 0.5, 0.75):
        at = p * (n - 1)
        low, part = int(at), at - int(at)
        assert got["a"][p] == pytest.approx((1 - part) * low**2 + part * (low + 1) ** 2, rel=1e-12)
        assert got["b"][p] == (0.5 if p < 0.7 else pytest.approx(at, rel=1e-12))


def test_both_ways_to_describe_agree(spark):
    rng = random.Random(5)
    rows = [(rng.gauss(0, 1), rng.randrange(9), None if i % 3 else 2.5) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b int, c double")
    one, other = (profile.describe(df, ["a", "b", "c"], **o).collect() for o in ({"summary": True}, {"held": 20}))
    for x, y in zip(one, other):
        assert x.asDict() == {k: v if isinstance(v, str) else pytest.approx(v, rel=1e-12) for k, v in y.asDict().items()}
