import datetime

import pytest
from fixtures import listings, random_changes

from hearthlens.functions.area_map import new_york_areas
from hearthlens.operators import clean, correlation, regions, summary
from hearthlens.schema import AREA, BOROUGH


def test_review_fact_has_all_columns_and_typed_values(spark):
    fact = clean.review_fact(listings(spark, {"price": "$1,250.00", "bathrooms_text": "Half-bath", "bedrooms": None}))
    assert fact.columns[:4] == ["name", "neighbourhood_group", "neighbourhood", "property_type"]
    row = fact.first()
    assert (row.price, row.bathrooms, row.bedrooms, row.neighbourhood) == (1250.0, 0.0, 0.0, "Harlem")


def test_scored_filters(spark):
    fact = clean.review_fact(
        listings(
            spark,
            {"name": "ok"},
            {"name": "free", "price": "$0.00"},
            {"name": "unrated", "review_scores_rating": None},
            {"name": "zero", "review_scores_rating": 0.0},
            {"name": "few", "number_of_reviews": 10},
        )
    )

    def names(df):
        return {r.name for r in df.collect()}

    assert names(clean.scored(fact)) == {"ok", "zero", "few"}
    assert names(clean.scored(fact, positive=True)) == {"ok", "few"}
    assert names(clean.scored(fact, 10)) == {"ok", "zero"}


def test_named_matches_exactly_or_folded(spark):
    rows = listings(spark, {"name": "Loft"}, {"name": "LOFT "}, {"name": "Attic"}, {"name": None})
    assert clean.named(rows, ["Loft"]).count() == 1
    assert clean.named(rows, ["loft "], match="ci").count() == 2


def test_collated_text_groups_without_case(spark):
    rows = listings(spark, {"room_type": "Hotel room"}, {"room_type": "hotel ROOM  "}, {"room_type": "Hotel"})
    assert summary.price_summary(rows, "room_type").count() == 3
    folded = clean.collated(rows, ["room_type"])
    assert sorted(r.units for r in summary.price_summary(folded, "room_type").collect()) == [1, 2]


def test_clean_prices_are_sorted(spark):
    rows = clean.clean_prices(listings(spark, *[{"price": f"${p}.00"} for p in (5, 0, 70, 12, 70)])).collect()
    assert [r.pricing for r in rows] == [70.0, 70.0, 12.0, 5.0]


def test_bathrooms_and_bedrooms_follow_listing_order(spark):
    rows = listings(
        spark,
        {"id": 3, "bathrooms_text": "3 baths", "bedrooms": None},
        {"id": 1, "bathrooms_text": None, "bedrooms": 4.0},
    )
    assert [r[0] for r in clean.bathrooms(rows).collect()] == [0.0, 3.0]
    assert [r[0] for r in clean.bedrooms(rows).collect()] == [4.0, 0.0]


def test_listing_details(spark):
    rows = clean.listing_details(
        listings(
            spark,
            {"name": None, "host_is_superhost": "t", "bedrooms": None},
            {"host_is_superhost": None},
            {"host_is_superhost": "f"},
            {"host_name": None},
            {"review_scores_rating": 0.0},
        )
    ).collect()
    assert [r.superhost for r in rows] == [None, "Not Superhost", "Superhost"]
    assert (rows[2].name, rows[2].neighborhood_overview, rows[2].bedrooms) == (" - ", " - ", 0.0)


def test_kpi(spark):
    rows = listings(
        spark,
        {"price": "$100.00", "accommodates": 2, "number_of_reviews": 3, "review_scores_rating": 4.0},
        {"price": "$101.01", "accommodates": 5, "number_of_reviews": 4, "review_scores_rating": None},
        {"price": "$0.00", "accommodates": 9},
    )
    assert summary.kpi(rows).first() == (2, 7, 7, 4.0, "$100.51")
    assert summary.kpi(rows, BOROUGH).collect() == [("Manhattan", 1, 2, 3, 4.0, "$100")]


def test_price_summary_counts_the_group_without_value_as_zero(spark):
    rows = listings(spark, {"price": "$10.00"}, {"price": "$10,000.00"}, {"property_type": None, "price": "$0.50"})
    got = {r.category: tuple(r)[1:] for r in summary.price_summary(rows, "property_type").collect()}
    assert got == {
        "Entire home": (2, 10.0, 10000.0, 5005.0, "10 - 10000"),
        None: (0, 0.5, 0.5, 0.5, "0.5 - 0.5"),
    }


def test_units_add_up_over_every_dimension(spark):
    rows = listings(spark, *random_changes(4))
    totals = {
        dim: sum(r.units for r in summary.price_summary(rows, dim).collect()) for dim in (AREA, BOROUGH, "room_type")
    }
    assert len(set(totals.values())) == 1 and totals[AREA] == clean.priced(rows).count() > 0


def test_weighted_score(spark):
    rows = listings(
        spark,
        {"review_scores_rating": 5.0, "number_of_reviews": 1},
        {"review_scores_rating": 2.0, "number_of_reviews": 3},
        {"review_scores_rating": 4.0, "number_of_reviews": 0, "room_type": "Hotel room"},
    )
    got = {r.room_type: r.avg_mod_score for r in summary.weighted_score(clean.review_fact(rows), "room_type").collect()}
    assert got == {"Entire home/apt": 2.75, "Hotel room": None}


def test_score_range_and_lowest(spark):
    fact = clean.review_fact(
        listings(
            spark,
            {"review_scores_rating": 3.37},
            {"review_scores_rating": 5.0},
            {"review_scores_rating": 3.37, "neighbourhood_cleansed": "Chelsea"},
            {"review_scores_rating": 1.0, "number_of_reviews": 10},
        )
    )
    got = {r.neighbourhood: r.range_of_ratings for r in summary.score_range(fact, "neighbourhood").collect()}
    assert got == {"Harlem": "3.37 - 5", "Chelsea": "3.37 - 3.37"}
    assert summary.lowest_scored(fact, "neighbourhood").collect() == [("Chelsea", 3.37)]


def test_area_summary_and_merged_areas(spark):
    rows = listings(
        spark,
        {AREA: "Kips Bay", "price": "$100.00", "number_of_reviews": 1},
        {AREA: "Murray Hill", "price": "$50.00", "number_of_reviews": 2},
        {AREA: "Murray Hill", "price": "$30.01", "number_of_reviews": 3},
        {AREA: "Inwood", "price": "$10.00"},
        {AREA: "Inwood", "accommodates": 0},
        {AREA: "Inwood", "review_scores_rating": 0.0},
        {AREA: "Richmondtown", BOROUGH: "Staten Island"},
    )
    plain = {r[AREA]: r for r in regions.area_summary(rows).orderBy(1, 2).collect()}
    assert (plain["Murray Hill"].listings, plain["Murray Hill"].avgp, plain["Inwood"].listings) == (2, 40.01, 1)
    merged = regions.area_summary_remapped(rows, new_york_areas(spark)).orderBy(1, 2).collect()
    assert [(r[BOROUGH], r.neighbourhood_area, r.listings) for r in merged] == [
        ("Manhattan", "Inwood", 1),
        ("Manhattan", "Murray Hill-Kips Bay", 3),
        ("Staten Island", "Richmondtown", 1),
    ]
    both = merged[1]
    assert (both.minp, both.maxp, both.avgp, both.rev, both.acc) == (30.01, 100.0, 60.0, 6, 6)


def test_merging_areas_keeps_the_totals(spark):
    rows = listings(spark, *random_changes(5))
    mapping = spark.createDataFrame([("Harlem", "North"), ("Chelsea", "South"), ("Astoria", "North")], "area string, merged_area string")
    plain, merged = regions.area_summary(rows).collect(), regions.area_summary_remapped(rows, mapping).collect()
    for total in ("listings", "rev", "acc"):
        assert sum(r[total] or 0 for r in plain) == sum(r[total] or 0 for r in merged) > 0


def test_host_since_may_be_text(spark):
    from hearthlens.operators import hosts

    rows = listings(spark, {}).drop("host_since").selectExpr("*", "'2015-06-01' as host_since")
    assert hosts.signup_running(rows).collect() == [(100.0, datetime.date(2015, 6, 1), 1)]


def test_dashboard_equals_the_single_summaries(spark):
    rows = [r | {"room_type": None} if i % 9 == 0 else r for i, r in enumerate(random_changes(21))]
    frame = listings(spark, *rows)
    borough, area = "neighbourhood_group_cleansed", "neighbourhood_cleansed"
    groupings = [[], [borough], [area], ["room_type"], [borough, "room_type"]]
    found = summary.dashboard(frame, groupings).collect()
    fact = clean.review_fact(frame)

    def of(*names):
        return {tuple(r[c] for c in names): r for r in found if r.dimension == (", ".join(names) or "all")}

    def same(singles, own, names, figures):
        singles = {tuple(r[c] for c in names): r for r in singles.collect()}
        for key, r in of(*own).items():
            for wanted, mine in figures.items():
                if key in singles:
                    assert singles[key][wanted] == (pytest.approx(r[mine]) if isinstance(r[mine], float) else r[mine]), (own, key, wanted)
                else:
                    assert not r[mine] or r[mine] in (" - ", "$")
        assert singles and set(singles) <= set(of(*own))

    kpis = {c: c for c in ("listings", "accommodations", "reviews", "average_rating", "average_pricing")}
    same(summary.kpi(frame), [], [], kpis)
    same(summary.kpi(frame, borough), [borough], [borough], kpis)
    for dim, in_fact in ((area, "neighbourhood"), ("room_type", "room_type"), (borough, "neighbourhood_group")):
        prices = {c: c for c in ("units", "min_price", "max_price", "avg_price", "price_range")}
        same(summary.price_summary(frame, dim), [dim], ["category"], prices)
        same(summary.score_mean(fact, in_fact), [dim], [in_fact], {"avg_score": "avg_score"})
        same(summary.weighted_score(fact, in_fact), [dim], [in_fact], {"avg_mod_score": "avg_mod_score"})
        ratings = {"range_of_ratings": "range_of_ratings", "average_rating": "average_reliable_rating"}
        same(summary.score_range(fact, in_fact), [dim], [in_fact], ratings)
        ratings = {"range_of_ratings": "range_of_cleanliness", "average_rating": "average_cleanliness"}
        same(summary.score_range(fact, in_fact, "cleanliness"), [dim], [in_fact], ratings)
    pairs = correlation.pearson(clean.scored(fact), "price", "score", ["neighbourhood_group", "room_type"])
    same(pairs, [borough, "room_type"], ["neighbourhood_group", "room_type"], {"r": "price_score_r"})
    assert summary.dashboard(frame.limit(0), groupings).filter("listings > 0").count() == 0
