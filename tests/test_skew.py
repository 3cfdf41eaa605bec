"""Registered queries on order tables where single keys, and copies of one line, hold a third of the rows."""

import os
import tempfile

import duckdb
import pytest
from test_oracle import TABLES, assert_equal, connect

import __spark_entry__ as contract

SOURCE = "/root/testdata/sf0.001"
# Every query that sorts rows, joins rows by a key, multiplies counts or repeats rows.
KEYS = [
    "listings_scan", "clean_prices", "bathrooms", "bedrooms", "listing_details", "local_hosts", "local_host_count",
    "local_host_listings", "local_host_by_borough", "host_signup_running", "listings_per_host", "top_host_share",
    "host_concentration", "superhost_scorecard", "superhost_rates", "superhost_instant_bookable",
    "superhost_share_by_borough", "superhost_share_by_room_type", "superhost_availability", "score_histogram",
    "area_window_metrics", "area_summary_remapped", "corr_price_score_by_area_room",
]


@pytest.fixture(scope="module")
def skewed():
    path = tempfile.mkdtemp(prefix="run-")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SOURCE}/{t}.parquet'")
        if t != "lineitem":
            con.execute(f"COPY {t} TO '{os.path.join(path, t)}.parquet' (FORMAT parquet)")
    con.execute(f"""
      COPY (
        SELECT * FROM (
          SELECT * EXCLUDE (n) REPLACE (
            CASE n % 3 WHEN 0 THEN 7 ELSE l_orderkey END AS l_orderkey,
            CASE n % 3 WHEN 1 THEN 3 ELSE l_suppkey END AS l_suppkey,
            CASE n % 3 WHEN 2 THEN 5 ELSE l_partkey END AS l_partkey)
          FROM (SELECT *, row_number() OVER () AS n FROM lineitem) WHERE n <= 1200)
        UNION ALL
        SELECT l.* FROM (SELECT * FROM lineitem WHERE l_discount > 0 AND l_tax > 0 LIMIT 1) l, range(600)
      ) TO '{path}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)""")
    return path


@pytest.mark.parametrize("key", KEYS)
def test_hot_keys_and_copies(spark, skewed, key):
    assert_equal(contract.queries()[key](spark, skewed), connect(skewed), contract.oracle_sql()[key])
