import pytest
from pyspark.sql import functions as F

from hearthlens.functions import measures, text
from hearthlens.functions.area_map import new_york_areas


def apply(spark, function, values, type_name):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_name}")
    return [r.out for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_money(spark):
    cases = {
        "$1,234.00": 1234.0,
        "$0.00": 0.0,
        "$10.00": 10.0,
        "$999,999.99": 999999.99,
        "$12,345,678.90": 12345678.9,
        "$1,234,567.89": 1234567.89,
        "$100,000,000.00": 100000000.0,
        "1234.00": 1234.0,
        "€99.50": 99.5,
        "$$5": None,
        "$-5.00": -5.0,
        "$ 7.5": 7.5,
        None: None,
        "": 0.0,
        "$": 0.0,
        "$abc": None,
        "$NaN": None,
        "$Infinity": None,
        "$12d": None,
    }
    assert apply(spark, text.parse_money, cases, "string") == list(cases.values())


def test_money_equals_the_double_of_its_text(spark):
    shown = [f"${cents // 100:,}.{cents % 100:02d}" for cents in range(1, 20_000_000, 97_531)]
    assert apply(spark, text.parse_money, shown, "string") == [float(s[1:].replace(",", "")) for s in shown]


def test_bathrooms(spark):
    cases = {
        "1 bath": 1.0,
        "1.5 shared baths": 1.5,
        "Half-bath": 0.0,
        "Private half-bath": 0.0,
        "12": 12.0,
        "0 baths": 0.0,
        "": 0.0,
        None: 0.0,
    }
    assert apply(spark, text.parse_bathrooms, cases, "string") == list(cases.values())


def test_flag_counts_unknown_as_set_but_label_does_not(spark):
    assert apply(spark, text.flag, ["t", "f", None], "string") == [1, 0, 1]
    assert apply(spark, text.superhost_label, ["t", "f", None], "string") == ["Superhost", "Not Superhost", None]


def test_score_bucket(spark):
    cases = {0.0: "0-1", 0.99: "0-1", 1.0: "1-2", 4.99: "4-5", 5.0: "5", 5.1: None, -1.0: None, None: None}
    assert apply(spark, measures.score_bucket, cases, "double") == list(cases.values())


def test_number_text(spark):
    cases = {
        10.0: "10",
        10000.0: "10000",
        100000.0: "100000",
        163.49: "163.49",
        104997.88: "104998",
        52927.85: "52927.9",
        0.01: "0.01",
        0.0: "0",
        -2.5: "-2.5",
        1000000.0: "1e+006",
        1234567.0: "1.23457e+006",
        0.00001: "1e-005",
        None: "",
    }
    assert apply(spark, text.number_text, cases, "double") == list(cases.values())


def test_money_and_range_text(spark):
    row = spark.range(1).select(
        text.money_text(F.lit(165.59)).alias("m"), text.range_text(F.lit(3.37), F.lit(5.0)).alias("r")
    )
    assert row.first() == ("$165.59", "3.37 - 5")


@pytest.mark.parametrize(
    "part, whole, shown",
    [(2865, 9224, "31.06%"), (2688, 6530, "41.16%"), (2940, 6727, "43.70%"), (3, 88, "3.41%"), (1, 0, None)],
)
def test_percent_text(spark, part, whole, shown):
    assert spark.range(1).select(text.percent_text(F.lit(part), F.lit(whole))).first()[0] == shown


def test_fold(spark):
    assert apply(spark, text.fold, ["Bob ", "BOB", " bob", None], "string") == ["bob", "bob", " bob", None]


def test_rounding_ignores_summation_noise(spark):
    noisy = [1.005, 1.0049999999999997, 1.0050000000000003, -1.005, 2.0]
    assert apply(spark, lambda c: measures.round_to(c, 2), noisy, "double") == [1.01, 1.01, 1.01, -1.01, 2.0]


def test_significant(spark):
    assert apply(spark, lambda c: measures.significant(c, 4), [123456.0, 0.00123456, None], "double") == [
        123500.0,
        0.001235,
        None,
    ]


def test_new_york_areas(spark):
    areas = new_york_areas(spark)
    assert areas.count() == areas.select("area").distinct().count() == 125
    mapped = dict(areas.collect())
    assert mapped["South Slope"] == "Williamsbridge-Olinville"
    assert mapped["Richmondtown"] == "Richmondtown"
    assert mapped["Prince's Bay"] == "Annadale-Huguenot-Prince's Bay-Woodrow"
