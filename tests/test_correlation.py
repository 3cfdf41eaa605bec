import math
import random

import pandas as pd
import pytest

from hearthlens.operators import correlation, profile


def frame(spark, rows, schema="g string, x double, y double, z double"):
    return spark.createDataFrame(rows, schema)


def random_rows(seed, n=200):
    rng = random.Random(seed)

    def number():
        return None if rng.random() < 0.2 else round(rng.gauss(100, 3), 2)

    return [(rng.choice("abc"), number(), number(), number()) for _ in range(n)]


def test_groups_without_a_defined_r_are_left_out(spark):
    rows = [("one", 1.0, 2.0, 0.0)]
    rows += [("two", 1.0, 2.0, 0.0), ("two", 2.0, 1.0, 0.0)]
    rows += [("flat x", 0.1, float(i), 0.0) for i in range(50)]
    rows += [("flat y", float(i), 0.1, 0.0) for i in range(50)]
    rows += [("perfect", float(i), 2.0 * i + 1, 0.0) for i in range(10)]
    rows += [("half", 1.0, 1.0, 0.0), ("half", 2.0, 2.0, 0.0), ("half", None, 9.0, 0.0), ("half", 7.0, None, 0.0)]
    rows += [("null", None, 1.0, 0.0), ("null", 1.0, None, 0.0)]
    got = {r.g: r.r for r in correlation.pearson(frame(spark, rows), "x", "y", ["g"]).collect()}
    assert got == {"half": pytest.approx(1), "perfect": pytest.approx(1), "two": pytest.approx(-1)}


def test_a_constant_stays_undefined_over_many_partitions(spark):
    df = spark.range(200_000, numPartitions=16).selectExpr("0.1d as x", "cast(id % 7 as double) as y")
    assert correlation.pearson(df, "x", "y", []).count() == 0
    assert correlation.pearson_moments(df, "x", "y").count() == 0


def test_a_large_mean_does_not_cancel(spark):
    df = spark.range(10_000).selectExpr("1e9 + id % 10 as x", "id % 10 as y")
    assert correlation.pearson(df, "x", "y", []).first().r == pytest.approx(1, abs=1e-9)


def test_symmetry_and_row_order(spark):
    df = frame(spark, random_rows(1))
    xy = {r.g: r.r for r in correlation.pearson(df, "x", "y", ["g"]).collect()}
    yx = {r.g: r.r for r in correlation.pearson(df.orderBy("z"), "y", "x", ["g"]).collect()}
    assert xy == pytest.approx(yx) and len(xy) == 3


def test_moments(spark):
    rows = [("a", 1.0, 2.0, 0.0), ("a", 3.0, 5.0, 0.0), ("a", 4.0, 4.0, 0.0)]
    m = correlation.pearson_moments(frame(spark, rows), "x", "y").first()
    assert (m.n, m.sx, m.sy, m.sxy, m.sx2, m.sy2) == (3, 8.0, 11.0, 33.0, 26.0, 45.0)
    raw = (3 * 33 - 8 * 11) / math.sqrt((3 * 26 - 64) * (3 * 45 - 121))
    assert m.r == pytest.approx(raw)


@pytest.mark.parametrize("seed", [2, 3])
def test_matrix_equals_pandas(spark, seed):
    rows = random_rows(seed) + [("flat", 1.0, 2.0, float(i)) for i in range(5)] + [("lone", 1.0, 2.0, 3.0)]
    cols = ["x", "y", "z"]
    pdf = pd.DataFrame(rows, columns=["g", *cols]).astype({c: float for c in cols})
    for by in (None, "g"):
        got = correlation.correlation_matrix(frame(spark, rows), cols, by).collect()
        groups = [(None, pdf)] if by is None else list(pdf.groupby("g"))
        assert len(got) == 9 * len(groups)
        for name, part in groups:
            want = part[cols].corr()
            for r in got:
                if by is None or r.g == name:
                    expected = want.loc[r.col_x, r.col_y]
                    assert (r.r is None) == math.isnan(expected), (name, r)
                    assert r.r is None or r.r == pytest.approx(expected, abs=1e-9)


def test_matrix_keeps_one_state_where_nothing_is_null(spark):
    cols = list("abcdef")
    rows = spark.range(1000, numPartitions=7).selectExpr("id % 3 as g", *[f"1e9 + (id * {i + 3}) % {11 + i} as {c}" for i, c in enumerate(cols)])
    states = correlation.shared_moments(rows, cols, "g")
    assert states.count() == 3
    k = len(cols)
    assert len(states.columns) - 2 == k * (k + 1) // 2 + 3 * k + 1
    plan = correlation.correlation_matrix(rows, cols, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1
    pdf = rows.toPandas()
    for r in correlation.correlation_matrix(rows, cols, "g").collect():
        part = pdf[pdf.g == r.g]
        expected = part[r.col_x].corr(part[r.col_y])
        # Column b is the same in all rows of a group.
        assert (r.r is None) == math.isnan(expected) == ("b" in (r.col_x, r.col_y))
        assert r.r is None or r.r == pytest.approx(expected, abs=1e-7)


def test_matrix_of_columns_that_never_meet(spark):
    rows = [("a", float(i), None, 0.1) for i in range(9)] + [("a", None, float(i), 0.1) for i in range(9)] + [(None, 1.0, 2.0, 3.0)]
    rows += [(None, 2.0, 4.0, 1.0)]
    got = {(r.g, r.col_x, r.col_y): r.r for r in correlation.correlation_matrix(frame(spark, rows), ["x", "y", "z"], "g").collect()}
    assert len(got) == 18 and got["a", "x", "y"] is None and got["a", "z", "z"] is None and got["a", "x", "x"] == 1
    assert got[None, "x", "y"] == pytest.approx(1) and got[None, "z", "x"] == pytest.approx(-1)
    assert correlation.correlation_matrix(frame(spark, []), ["x", "y"]).count() == 0


def test_heatmap_labels(spark):
    labels = correlation.rounded_for_heatmap(correlation.correlation_matrix(frame(spark, random_rows(4)), ["x", "y"]))
    assert all(r.r == round(r.r, 1) for r in labels.collect())


def test_describe_equals_pandas(spark):
    rows = random_rows(5)
    pdf = pd.DataFrame(rows, columns=["g", "x", "y", "z"]).astype({"x": float, "y": float, "z": float})
    want = pdf.describe()
    names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "p25": "25%", "p50": "50%", "p75": "75%", "max": "max"}
    got = profile.describe(frame(spark, rows), ["x", "y", "z"]).collect()
    assert len(got) == 3
    for r in got:
        for ours, theirs in names.items():
            assert r[ours] == pytest.approx(want.loc[theirs, r.measure])


def test_head_and_tail(spark):
    df = spark.createDataFrame([(i,) for i in (5, 3, 9, 1, 7, 2)], "v int")
    assert [r.v for r in profile.head(df, ["v"], 2).collect()] == [1, 2]
    assert [r.v for r in profile.tail(df, ["v"], 2).collect()] == [7, 9]
    assert profile.distinct_values(df.union(df), "v").count() == 6
