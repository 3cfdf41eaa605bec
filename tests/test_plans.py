"""What the physical plans of all registered queries must and must not hold."""

import re

import pytest

from hearthlens.operators import clean, hosts, spread, summary
from hearthlens.plans.catalogue import QUERIES
from hearthlens.sources import files, orders_binding, versions

SMALL = "/root/testdata/sf0.001"
FORBIDDEN = ["Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin", "ExistingRDD"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {key: plan_of(query(spark, SMALL)) for key, query in QUERIES.items()}


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_and_no_cross_join(plans, key):
    assert not [word for word in FORBIDDEN if word in plans[key]]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_only_aggregates_go_to_a_single_task(plans, key):
    lines = plans[key].splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = (li for li in lines[i + 1 :] if not re.search(r"[-+:] (\*\(\d+\) )?(Project|Filter|Generate)", li))
            assert "HashAggregate" in next(below), line


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_windows_run_over_aggregates_only(plans, key):
    lines = plans[key].splitlines()
    for i, line in enumerate(lines):
        if re.search(r"[-+:] Window ", line):
            nodes = [li for li in lines[i + 1 :] if not re.search(r"[-+:] (Project|Filter|Generate|Sort|Exchange|Window)", li)]
            assert "HashAggregate" in nodes[0], nodes[0]


def test_only_needed_columns_and_tables_are_read(plans):
    plan = plans["price_by_room_type"]
    assert "struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double,l_discount:double>" in plan
    assert "struct<o_orderkey:bigint,o_orderpriority:string>" in plan
    assert plan.count("FileScan") == 2
    assert plans["listings_per_host"].count("FileScan") == 1


@pytest.mark.parametrize("key", ["local_host_count_any_case", "superhost_rates_any_case", "price_by_property_type_any_case"])
def test_text_without_case_is_grouped_by_hash(plans, key):
    rows = [li for li in plans[key].splitlines() if re.search(r"[-+:] (\*\(\d+\) )?(Sort|Hash|ObjectHash)Aggregate", li)]
    # What stands next to the listings; only sums by spelling may be sorted.
    assert "HashAggregate" in rows[-1] and "HashAggregate" in rows[-2]


def test_the_dashboard_reads_and_shuffles_once(plans):
    plan = plans["dashboard"]
    assert plan.count("lineitem.parquet") == 1 and len(re.findall(r"[-+:] (\*\(\d+\) )?Expand ", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(.*spark_grouping_id", plan)) == 1


def test_the_title_join_reads_and_shuffles_its_rows_once(plans):
    for key in ("superhost_scorecard", "superhost_rates", "superhost_instant_bookable", "score_histogram", "superhost_share_by_borough", "superhost_share_by_room_type"):
        plan = plans[key]
        assert plan.count("lineitem.parquet") == 1, key
        assert len(re.findall(r"hashpartitioning\(title#", plan)) == 1, key
        assert "Window" not in plan.split("HashAggregate", 3)[-1], key


@pytest.mark.parametrize("key", ["local_hosts", "local_host_count", "local_host_listings", "local_host_by_borough"])
def test_local_hosts_use_a_semi_join_of_two_scans(plans, key):
    assert "LeftSemi" in plans[key] and plans[key].count("lineitem.parquet") == 2


@pytest.mark.parametrize("key", ["listings_scan", "clean_prices", "bathrooms", "bedrooms", "listing_details"])
def test_sorts_read_once(plans, key):
    assert plans[key].count("lineitem.parquet") == 1


@pytest.mark.parametrize("key", ["region_corr", "region_heatmap", "region_describe", "region_corr_by_borough"])
def test_statistics_neither_sort_nor_explode_before_they_aggregate(plans, key):
    lines = plans[key].splitlines()
    last = max(i for i, li in enumerate(lines) if "Generate inline" in li)
    assert "rangepartitioning" not in plans[key]
    assert "HashAggregate" in "".join(lines[last + 1 : last + 4])


def test_the_area_mapping_meets_aggregates_only(plans):
    lines = plans["area_summary_remapped"].splitlines()
    join = next(i for i, li in enumerate(lines) if "merged_area" not in li and re.search(r"Join \[neighbourhood_cleansed", li))
    below = (li for li in lines[join + 1 :] if not re.search(r"[-+:] (Project|Sort|Exchange)", li))
    assert "HashAggregate" in next(below)


def test_filters_reach_the_scan(spark, scratch, monkeypatch):
    path = f"{scratch}/listings"
    files.write_table(orders_binding.listings(spark, SMALL), path)
    stored = files.read_listings(spark, path)
    plan = plan_of(hosts.listings_per_host(stored))
    assert "PushedFilters: [IsNotNull(review_scores_rating), GreaterThan(review_scores_rating,0.0)]" in plan
    assert "ReadSchema: struct<host_id:bigint,price:string,review_scores_rating:double>" in plan
    # The rows to repeat are counted and stored first; that is the job which reads the listings.
    counted = []
    monkeypatch.setattr(spread, "write_version", lambda df, folder: counted.append(plan_of(df)) or versions.write_version(df, folder))
    hosts.signup_running(stored)
    (plan,) = counted
    assert "GreaterThanOrEqual(host_since,2001-01-01)" in plan
    assert "ReadSchema: struct<host_since:date,price:string>" in plan
    plan = plan_of(summary.score_range(clean.review_fact(stored), "room_type"))
    assert "GreaterThan(number_of_reviews,10)" in plan
    assert "ReadSchema: struct<room_type:string,price:string,number_of_reviews:int,review_scores_rating:double>" in plan
