import datetime
import math
import random
from collections import Counter, defaultdict

import pytest
from fixtures import listings, money, random_changes, rows_of
from pyspark.sql import functions as F

from hearthlens.operators import clean, hosts, running, spread


def is_local(row, rows):
    """Whether the row's host name has a listing in the row's home area, row by row."""
    return row["host_name"] is not None and any(
        o["neighbourhood_cleansed"] == row["host_neighbourhood"] and o["host_name"] == row["host_name"] for o in rows
    )


@pytest.fixture(params=[6, 7])
def random_rows(request):
    return rows_of(*random_changes(request.param))


def test_local_hosts(spark, random_rows):
    want = {(r["host_id"], r["host_name"], r["host_neighbourhood"]) for r in random_rows if is_local(r, random_rows)}
    got = hosts.local_hosts(listings(spark, *random_rows)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert [r.host_neighbourhood for r in got] == sorted(r.host_neighbourhood for r in got)


def test_local_host_count(spark, random_rows):
    homes = defaultdict(set)
    for r in random_rows:
        if is_local(r, random_rows):
            homes[r["host_neighbourhood"]].add(r["host_id"])
    got = hosts.local_host_count(listings(spark, *random_rows)).collect()
    assert {r.host_neighbourhood: r.hosts_live_here for r in got} == {h: len(ids) for h, ids in homes.items()}


DETAILS = (
    "host_name host_neighbourhood name neighborhood_overview neighbourhood_group_cleansed property_type room_type "
    "accommodates price review_scores_rating number_of_reviews"
).split()


def test_local_host_listings(spark, random_rows):
    want = {
        (r["host_id"], *[r[c] for c in DETAILS])
        for r in random_rows
        if is_local(r, random_rows) and r["neighbourhood"] is not None and r["review_scores_rating"] is not None
    }
    got = hosts.local_host_listings(listings(spark, *random_rows)).collect()
    assert Counter(tuple(r) for r in got) == Counter(w[1:] for w in want)


@pytest.mark.parametrize("borough", [None, "Queens"])
def test_local_host_by_borough(spark, random_rows, borough):
    want = {
        (r["host_id"], *[money(r[c]) if c == "price" else r[c] for c in DETAILS])
        for r in random_rows
        if is_local(r, random_rows)
        and r["neighbourhood"] is not None
        and (r["review_scores_rating"] or 0) > 0
        and (money(r["price"]) or 0) > 0
        and (r["number_of_reviews"] or 0) > 10
        and borough in (None, r["neighbourhood_group_cleansed"])
    }
    frame = listings(spark, *random_rows)
    narrow = frame.select("host_id", "host_name", "host_neighbourhood", "neighbourhood_cleansed")
    for given in (None, narrow):
        got = hosts.local_host_by_borough(frame, given, borough=borough).collect()
        assert Counter(tuple(r) for r in got) == Counter(w[1:] for w in want)


def test_names_may_match_without_case(spark):
    rows = listings(
        spark,
        {"host_name": "Ann ", "host_neighbourhood": "HARLEM", "neighbourhood_cleansed": "Chelsea"},
        {"host_id": 2, "host_name": "ann", "host_neighbourhood": None, "neighbourhood_cleansed": "Harlem"},
    )
    assert hosts.local_hosts(rows).count() == 0
    assert [r.host_id for r in hosts.local_hosts(rows, match="ci").collect()] == [1]


def test_sorted_rows_orders_and_keeps_copies(spark):
    rng = random.Random(16)
    rows = [(7, "copy", 1.5)] * 400 + [(rng.randrange(50), rng.choice("ab"), None) for _ in range(800)]
    df = spark.createDataFrame(rows, "id int, k string, v double")
    got = [tuple(r) for r in spread.sorted_rows(df, F.desc("id")).collect()]
    assert [r[0] for r in got] == sorted((r[0] for r in rows), reverse=True)
    assert Counter(got) == Counter(rows)


def test_repeat_rows(spark):
    df = spark.createDataFrame([("a", 7), ("b", 1), ("c", 0), ("d", 3)], "k string, n long")
    got = spread.repeat_rows(df, "n", "nth", chunk=3).collect()
    assert sorted((r.k, r.nth) for r in got) == [("a", i) for i in range(1, 8)] + [("b", 1)] + [("d", i) for i in (1, 2, 3)]


def test_numbering_equals_row_number(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.4 else rng.choice("abc"), rng.choice([0.5, 1.0, 1.25, 1.5, 99.0, 1e6])) for _ in range(500)]
    got = running.numbered_within(spark.createDataFrame(rows, "k string, v double"), "k", "v", "n").collect()
    by_key = defaultdict(list)
    for k, v in rows:
        by_key[k].append(v)
    want = [(v, k, i) for k, vs in by_key.items() for i, v in enumerate(sorted(vs), 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_signup_running(spark):
    day, later = datetime.date(2001, 5, 1), datetime.date(2003, 5, 1)
    rows = listings(
        spark,
        {"host_since": later, "price": "$30.00"},
        {"host_since": later, "price": "$20.00"},
        {"host_since": later, "price": "$20.00"},
        {"host_since": day, "price": "$10.00"},
        {"host_since": day, "price": "$0.00"},
        {"host_since": datetime.date(2000, 12, 31)},
        {"host_since": None},
    )
    assert [tuple(r) for r in hosts.signup_running(rows).collect()] == [
        (10.0, day, 1),
        (20.0, later, 1),
        (20.0, later, 2),
        (30.0, later, 3),
    ]


def hosts_with(spark, *sizes):
    return listings(spark, *[{"host_id": h} for h, size in enumerate(sizes) for _ in range(size)])


def test_listings_per_host(spark):
    rows = hosts_with(spark, 1, 5, 2, 4)
    assert [tuple(r) for r in hosts.listings_per_host(rows).collect()] == [(1, 5), (3, 4), (2, 2), (0, 1)]
    assert [tuple(r) for r in hosts.listings_per_host(rows, 3).collect()] == [(1, 5), (3, 4)]
    assert hosts.listings_of_hosts_over(rows).first().listings == 12
    assert hosts.listings_of_hosts_over(rows, 3).first().listings == 9


@pytest.mark.parametrize("count, percent", [(26, 4), (25, 4), (75, 4), (75, 10), (1, 4), (10, 100), (40, 2.5)])
def test_top_host_share(spark, count, percent):
    rng = random.Random(count)
    sizes = [rng.choice([1, 1, 1, 2, 2, 3, 6]) for _ in range(count)]
    top = math.ceil(round(count * percent / 100, 9))
    want = sum(sorted(sizes, reverse=True)[:top]) * 100 / sum(sizes)
    assert hosts.top_host_share(hosts_with(spark, *sizes), percent).first().percent == pytest.approx(want)


def test_host_concentration(spark):
    got = {r.more_than: r for r in hosts.host_concentration(hosts_with(spark, 1, 1, 2, 4)).collect()}
    assert {t: (r.hosts, r.listings) for t, r in got.items()} == {1: (2, 6), 2: (1, 4), 3: (1, 4)}
    assert (got[1].host_share, got[1].listing_share) == (0.5, 0.75)


@pytest.mark.parametrize("columns", [["host_name"], ["host_neighbourhood"], ["neighbourhood_cleansed"], ["host_name", "host_neighbourhood"]])
@pytest.mark.parametrize("match", ["binary", "ci"])
def test_any_collated_columns_join(spark, columns, match):
    rows = listings(spark, {}, {"host_name": "Bo", "host_neighbourhood": "harlem "}, {"host_name": None})
    found = hosts.local_hosts(clean.collated(rows, columns), match=match)
    assert [r.host_name for r in found.orderBy("host_name").collect()] == ["Ann", "Bo"]
    assert hosts.local_host_listings(clean.collated(rows, columns), match=match).count() == 2
