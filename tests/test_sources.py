import pytest
from fixtures import listings, random_changes
from pyspark.sql import functions as F

from hearthlens.functions.area_map import new_york_areas
from hearthlens.operators import clean, correlation, hosts, regions, title_join
from hearthlens.schema import LISTINGS, REGION_MEASURES
from hearthlens.sources import files, orders_binding

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_listings_survive_each_format(spark, scratch, format):
    rows = listings(spark, *random_changes(14, 40), {"name": 'Quote " and, comma'})
    rows = rows.withColumn("price", F.nullif(F.col("price"), F.lit("")))
    path = f"{scratch}/listings"
    files.write_table(rows, path, format)
    back = files.read_listings(spark, path, format)
    assert back.schema == LISTINGS
    assert sorted(back.collect(), key=lambda r: r.id) == sorted(rows.collect(), key=lambda r: r.id)


def test_write_replaces_and_returns_the_stored_table(spark, scratch):
    rows = listings(spark, {}, {"price": "$0.00"})
    first = files.write_table(clean.review_fact(rows), f"{scratch}/fact", partition_by=["room_type"])
    assert first.count() == 2
    again = files.write_table(clean.scored(clean.review_fact(rows)), f"{scratch}/fact")
    assert again.count() == 1 and set(again.columns) == set(clean.review_fact(rows).columns)


CSV = "price,id,extra,host_since,host_response_rate,bedrooms,accommodates,name\n"


def _csv(spark, scratch, *lines, header=CSV, **options):
    whole = [c for c in LISTINGS.fieldNames() if c not in header.strip().split(",")]
    with open(f"{scratch}/listings.csv", "w") as f:
        f.write(header.strip() + "".join(f",{c}" for c in whole) + "\n")
        f.writelines(line + "," * len(whole) + "\n" for line in lines)
    return files.read_listings(spark, f"{scratch}/listings.csv", "csv", **options)


def test_csv_columns_are_found_by_name(spark, scratch):
    rows = _csv(spark, scratch, '"$1,234.00",7,x,2015-03-01,53%,2.0,3.0,Loft', "$5.00,8,y,,N/A,,,")
    assert rows.schema == LISTINGS
    first, second = rows.orderBy("id").collect()
    assert (first.price, first.id, first.host_response_rate, first.bedrooms, first.accommodates) == ("$1,234.00", 7, 0.53, 2.0, 3)
    assert str(first.host_since) == "2015-03-01" and first.name == "Loft"
    assert (second.price, second.host_response_rate, second.bedrooms, second.host_since) == ("$5.00", None, None, None)


@pytest.mark.parametrize("line", ["$5.00,8,y,2015-03-01,two,1,1,a", "$5.00,8,y,2015-03-01,1%,1,1.5,a", "$5.00,8,y,soon,1%,1,1,a"])
def test_csv_cells_of_another_type_fail_or_are_reported(spark, scratch, line):
    with pytest.raises(Exception, match="not a"):
        _csv(spark, scratch, line).collect()
    (row,) = _csv(spark, scratch, line, malformed="report").collect()
    assert row.id == 8 and len(row._malformed) == 1


def test_csv_without_a_column_of_the_table_fails(spark, scratch):
    with open(f"{scratch}/listings.csv", "w") as f:
        f.write("id,price\n1,$5.00\n")
    with pytest.raises(ValueError, match="listing_url"):
        files.read_listings(spark, f"{scratch}/listings.csv", "csv")


def test_json_of_another_type_fails(spark, scratch):
    with open(f"{scratch}/listings.json", "w") as f:
        f.write('{"id": 1, "bedrooms": "two"}\n')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        files.read_listings(spark, f"{scratch}/listings.json", "json").collect()


def test_region_summary_round_trip_feeds_the_correlations(spark, scratch):
    summary = regions.area_summary_remapped(listings(spark, *random_changes(15)), new_york_areas(spark))
    files.write_table(summary, f"{scratch}/regions", "csv")
    back = files.read_region_summary(spark, f"{scratch}/regions", "csv")
    assert back.columns == summary.columns
    matrix = correlation.correlation_matrix(back, REGION_MEASURES)
    assert matrix.count() == 64


def test_binding_column_alone_equals_column_of_the_whole(spark):
    whole = orders_binding.listings(spark, SMALL)
    assert {f.name: f.dataType for f in whole.schema} == {f.name: f.dataType for f in LISTINGS}
    for column in ("neighbourhood_group_cleansed", "host_neighbourhood", "property_type", "host_since"):
        alone = orders_binding.listings(spark, SMALL, ["id", column])
        both = whole.select("id", column)
        assert alone.exceptAll(both).count() == both.exceptAll(alone).count() == 0


def test_predicates_keep_some_of_the_binding_and_reject_some(spark):
    whole = orders_binding.listings(spark, SMALL).persist()
    everyone = whole.filter("host_name is not null").select("host_id").distinct().count()
    assert 0 < hosts.local_hosts(whole).count() < everyone
    shares = hosts.host_concentration(whole).collect()
    assert all(0 < r.host_share < 1 for r in shares) and len({r.host_share for r in shares}) == 3
    boroughs = whole.groupBy("neighbourhood_cleansed").agg(F.countDistinct("neighbourhood_group_cleansed").alias("n"))
    assert boroughs.filter("n > 1").count() > 0
    for rejected in ("accommodates = 0", "review_scores_rating <= 0", "review_scores_rating > 5", "room_type is null", "price = '$0.00'"):
        assert 0 < whole.filter(rejected).count() < whole.count(), rejected
    whole.unpersist()


def test_groups_without_a_correlation_and_every_band_occur(spark):
    whole = orders_binding.listings(spark, SMALL).persist()
    fact = clean.review_fact(whole)
    for dim, positive, why in (("property_type", True, "n = 1"), ("room_type", False, "n > 1 and low = high")):
        rows = clean.scored(fact, positive=positive)
        groups = rows.groupBy(dim).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        left_out = groups.filter(why).select(dim)
        kept = correlation.pearson(rows, "price", "score", [dim]).select(dim)
        assert left_out.count() > 0 and left_out.join(kept, dim).count() == 0, dim
        assert 0 < kept.count() < groups.count()
    bands = {r.range for r in title_join.score_histogram(whole).collect()}
    assert bands == {"0-1", "1-2", "2-3", "3-4", "4-5", "5", None}
    whole.unpersist()


def test_binding_reads_no_table_it_does_not_need(spark):
    plan = orders_binding.listings(spark, SMALL, ["host_id", "price"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in plan
