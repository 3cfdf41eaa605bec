"""The title join against the join carried out row by row."""

from collections import Counter, defaultdict

import pytest
from fixtures import listings, money, random_changes, rows_of
from pyspark.sql import functions as F

from hearthlens.operators import title_join


def joined(rows, min_reviews=10, key=lambda name: name):
    facts = defaultdict(list)
    for r in rows:
        good = (money(r["price"]) or 0) > 0 and (r["number_of_reviews"] or 0) > min_reviews
        if r["name"] is not None and good and r["review_scores_rating"] is not None:
            facts[key(r["name"])].append(r)
    return [(t, f) for t in rows if t["name"] is not None for f in facts[key(t["name"])]]


def superhost(row):
    return 0 if row["host_is_superhost"] == "f" else 1


def groups(pairs, key):
    grouped = defaultdict(list)
    for t, f in pairs:
        grouped[key(t)].append((t, f))
    return grouped


def mean(values):
    known = [v for v in values if v is not None]
    return pytest.approx(sum(known) / len(known)) if known else None


@pytest.fixture(params=[10, 11, 12])
def rows(request):
    return rows_of(*random_changes(request.param))


def test_scorecard(spark, rows):
    want = groups(joined(rows), superhost)
    got = {r.superhost: r for r in title_join.superhost_scorecard(listings(spark, *rows)).collect()}
    assert set(got) == set(want) == {0, 1}
    for flag, pairs in want.items():
        prices = [money(f["price"]) for _, f in pairs]
        assert got[flag].price_range == f"{min(prices):g} - {max(prices):g}"
        listing_prices = [p for p in (money(t["price"]) for t, _ in pairs) if p is not None]
        assert got[flag].avg_price == pytest.approx(sum(listing_prices) / len(listing_prices), abs=0.0051)
        assert got[flag].score == mean([f["review_scores_rating"] for _, f in pairs])
        assert got[flag].score_accuracy == mean([f["review_scores_accuracy"] for _, f in pairs])
        assert got[flag].cleanliness == mean([f["review_scores_cleanliness"] for _, f in pairs])


def test_rates(spark, rows):
    got = {r.superhost: r for r in title_join.superhost_rates(listings(spark, *rows)).collect()}
    for flag, pairs in groups(joined(rows), superhost).items():
        assert got[flag].avg_response_rate == mean([t["host_response_rate"] or 0 for t, _ in pairs])
        assert got[flag].avg_acceptance_rate == mean([t["host_acceptance_rate"] or 0 for t, _ in pairs])


def test_availability_filters_listings_only(spark, rows):
    pairs = [(t, f) for t, f in joined(rows) if (t["availability_30"] or 0) > 0]
    got = {r.superhost: r for r in title_join.superhost_availability(listings(spark, *rows)).collect()}
    for flag, side in groups(pairs, superhost).items():
        assert got[flag].a30 == mean([t["availability_30"] for t, _ in side])
        assert got[flag].a60 == mean([t["availability_60"] for t, _ in side])


def test_instant_bookable(spark, rows):
    got = {r.superhost: r for r in title_join.superhost_instant_bookable(listings(spark, *rows)).collect()}
    for flag, pairs in groups(joined(rows), superhost).items():
        bookable = sum(t["instant_bookable"] != "f" for t, _ in pairs)
        assert (got[flag].instant_bookable, got[flag].total) == (bookable, len(pairs))


@pytest.mark.parametrize("dim", ["neighbourhood_group_cleansed", "room_type"])
def test_superhost_share(spark, rows, dim):
    got = {r[dim]: (r.total_hosts, r.superhosts) for r in title_join.superhost_share(listings(spark, *rows), dim).collect()}
    want = groups(joined(rows), lambda t: t[dim])
    assert got == {k: (len(p), sum(superhost(t) for t, _ in p)) for k, p in want.items()}


@pytest.mark.parametrize("most", [0, 2, 64])
def test_superhost_share_of_few_and_many_values(spark, rows, monkeypatch, most):
    monkeypatch.setattr(title_join, "MOST_VALUES", most)
    rows = [r | {"room_type": None} if i % 7 == 0 else r for i, r in enumerate(rows)]
    got = title_join.superhost_share(listings(spark, *rows), "room_type").collect()
    want = groups(joined(rows), lambda t: t["room_type"])
    assert {r.room_type: (r.total_hosts, r.superhosts) for r in got} == {k: (len(p), sum(superhost(t) for t, _ in p)) for k, p in want.items()}


def test_superhost_share_of_given_values(spark, rows):
    frame = listings(spark, *rows)
    values = spark.createDataFrame([("Private room",), ("Shared room",), ("Hotel room",), ("Castle",)], "v string")
    got = title_join.superhost_share(frame, "room_type", values=values).collect()
    assert got == title_join.superhost_share(frame, "room_type").collect()
    with pytest.raises(Exception, match="not given"):
        title_join.superhost_share(frame, "room_type", values=values.limit(2)).collect()
    assert title_join.superhost_share(frame.limit(0), "room_type").count() == 0


def test_histogram(spark, rows):
    def band(score):
        if score == 5:
            return "5"
        return f"{int(score)}-{int(score) + 1}" if 0 <= score < 5 else None

    want = Counter(band(f["review_scores_rating"]) for _, f in joined(rows))
    got = title_join.score_histogram(listings(spark, *rows)).collect()
    assert {r.range: r["count"] for r in got} == want
    assert all(r.percent.endswith("%") for r in got)
    assert sum(float(r.percent[:-1]) for r in got) == pytest.approx(100, abs=0.05)


def test_all_statements_agree_on_the_joined_rows(spark, rows):
    frame = listings(spark, *rows)
    bookable = title_join.superhost_instant_bookable(frame).collect()
    by_borough = title_join.superhost_share(frame, "neighbourhood_group_cleansed").collect()
    by_room = title_join.superhost_share(frame, "room_type").collect()
    total = sum(r.total for r in bookable)
    assert total == sum(r.total_hosts for r in by_borough) == sum(r.total_hosts for r in by_room) == len(joined(rows))
    superhosts = [r.total for r in bookable if r.superhost == 1][0]
    assert superhosts == sum(r.superhosts for r in by_borough) == sum(r.superhosts for r in by_room)


def test_duplicate_titles_multiply(spark):
    rows = listings(spark, {"name": "a"}, {"name": "a", "host_is_superhost": "t"}, {"name": "b"}, {"name": None})
    got = {r.superhost: r.total for r in title_join.superhost_instant_bookable(rows).collect()}
    assert got == {0: 3, 1: 2}


def test_titles_may_match_without_case(spark):
    rows = listings(spark, {"name": "Loft"}, {"name": "LOFT  ", "number_of_reviews": 0})
    assert title_join.superhost_instant_bookable(rows).first().total == 1
    assert title_join.superhost_instant_bookable(rows, match="ci").first().total == 2


def test_counts_beyond_a_long(spark):
    titles = spark.range(3).select(F.lit(2**33).alias("n"), F.lit(2**33).alias("n_facts"))
    total = titles.agg(title_join._sum_over_join("n", "n_facts").alias("total")).first().total
    assert int(total) == 3 * 2**66
