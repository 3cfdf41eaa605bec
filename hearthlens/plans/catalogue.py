"""Every registered query: the listings columns it reads and what it does with them.

Measures that are sums or means of floats are rounded here, and dates given as text, so that they compare equal
to another engine's; the operators themselves return them as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import round_to, significant
from ..operators import clean, correlation, hosts, profile, regions, running, summary, title_join
from ..schema import AREA, BOROUGH, RATING, REGION_MEASURES
from ..session import tune
from ..sources import orders_binding, versions

PRICED = ["price"]
PRICED_RATED = ["price", RATING]
SCORED = ["price", RATING]
RELIABLE = [*SCORED, "number_of_reviews"]
TITLED = ["name", *RELIABLE, "host_is_superhost"]
SUB_SCORES = [
    f"review_scores_{s}" for s in ("accuracy", "cleanliness", "checkin", "communication", "location", "value")
]
LOCAL = ["host_id", "host_name", "host_neighbourhood", AREA]
LOCAL_DETAILS = [
    *LOCAL, "name", "neighborhood_overview", "neighbourhood", BOROUGH, "property_type", "room_type", "accommodates",
    *RELIABLE,
]
FACT = ["name", BOROUGH, AREA, "property_type", "room_type", *RELIABLE, *SUB_SCORES]
ROOMS_FACT = [c for c in FACT if c != AREA] + ["bedrooms", "bathrooms_text"]
AREA_SUMMARY = [BOROUGH, AREA, *RELIABLE, "accommodates"]
DETAILS = [
    "id", "host_id", "host_name", "name", "neighborhood_overview", AREA, BOROUGH, "property_type", "room_type",
    "host_is_superhost", "latitude", "longitude", "accommodates", "bathrooms_text", "bedrooms", "minimum_nights",
    "maximum_nights", *RELIABLE, *SUB_SCORES, "listing_url",
]
DASHBOARD = [[], [BOROUGH], [AREA], ["room_type"], ["property_type"], [BOROUGH, "room_type"], [AREA, "room_type"]]
SPOT_CHECK = ["Order 100", "Order 2024", "Order 5979"]
ONE_BOROUGH = "ASIA"
# No listing of the test tables has more than 50 reviews, the number the report asks for.
MANY_REVIEWS = 25


@dataclass(frozen=True)
class Query:
    """``run`` gets the listings with ``columns``, then the ``others``."""

    columns: list[str]
    run: Callable[..., DataFrame]
    others: tuple[Callable[[SparkSession, str], DataFrame], ...] = ()

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        listings = orders_binding.listings(tune(spark), sf_dir, self.columns)
        return self.run(listings, *[other(spark, sf_dir) for other in self.others])


def _host_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_binding.listings(spark, sf_dir, LOCAL)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: round_to(F.col(c), 6) for c in cols})


def _plain_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def _dates_as_text(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.col(col).cast("string"))


def _scored_by(operator: Callable[..., DataFrame], dim: str, source: str, reviews: bool = False) -> Query:
    columns = [source, *(RELIABLE if reviews else SCORED)]
    return Query(columns, lambda li: operator(clean.review_fact(li), dim))


def _range_by(dim: str, source: str, measure: str = "score") -> Query:
    columns = [source, *RELIABLE, *(["review_scores_cleanliness"] if measure == "cleanliness" else [])]

    def run(listings: DataFrame) -> DataFrame:
        return _rounded(summary.score_range(clean.review_fact(listings), dim, measure), "average_rating")

    return Query(columns, run)


def _respelled(listings: DataFrame, *cols: str) -> DataFrame:
    """Texts of every other host in capitals, and of every third with blanks at the end, so that equal texts differ in spelling."""
    host = F.col("host_id")
    cased = {c: F.when(host % 2 == 0, F.upper(c)).otherwise(F.col(c)) for c in cols}
    return listings.withColumns({c: F.when(host % 3 == 0, F.concat(v, F.lit("  "))).otherwise(v) for c, v in cased.items()})


def _half_titles(listings: DataFrame) -> DataFrame:
    """Titles that two orders share, one of them in another spelling."""
    return _respelled(listings.withColumn("name", F.concat(F.lit("Orders "), F.floor(F.col("host_id") / 2).cast("string"))), "name")


def _stored(df: DataFrame, name: str, **layout) -> DataFrame:
    """``df`` written as a version of a table of its own, and read back."""
    folder = f"{versions.shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    return versions.write_version(df, folder, **layout)


_SOURCES = {
    "neighbourhood": AREA,
    "neighbourhood_group": BOROUGH,
    "property_type": "property_type",
    "room_type": "room_type",
    "price": "price",
    "bedrooms": "bedrooms",
    "bathrooms": "bathrooms_text",
}


def _corr(x: str, by: list[str], min_reviews: int | None = None, positive: bool = False) -> Query:
    columns = list(dict.fromkeys([*RELIABLE, *[_SOURCES[c] for c in [x, *by]]]))
    if min_reviews is None:
        columns.remove("number_of_reviews")

    def run(listings: DataFrame) -> DataFrame:
        rows = clean.scored(clean.review_fact(listings), min_reviews, positive)
        if by:
            return _rounded(correlation.pearson(rows, x, "score", by), "r")
        moments = correlation.pearson_moments(rows, x, "score")
        sums = {c: significant(F.col(c)) for c in ("sx", "sy", "sxy", "sx2", "sy2")}
        return _rounded(moments.withColumns(sums), "r")

    return Query(columns, run)


def _remapped(run: Callable[[DataFrame], DataFrame]) -> Query:
    """A step over the merged-area summary."""
    return Query(AREA_SUMMARY, lambda li, pairs: run(regions.area_summary_remapped(li, pairs)), (orders_binding.area_pairs,))


# Columns of any number of rows and different values.
_DESCRIBED = ["price", RATING, "number_of_reviews", "bedrooms", "host_response_rate", "id"]
_STATISTICS = ["mean", "std", "min", "p25", "p50", "p75", "max"]
_REGION_KEY = [BOROUGH, "neighbourhood_area"]

QUERIES: dict[str, Query] = {
    # cleaning and base rows
    "listings_scan": Query(
        list(orders_binding.COLUMNS), lambda li: _dates_as_text(clean.ordered_listings(li), "host_since")
    ),
    "clean_prices": Query(["id", "property_type", *PRICED], clean.clean_prices),
    "bathrooms": Query(["id", "bathrooms_text"], clean.bathrooms),
    "bedrooms": Query(["id", "bedrooms"], clean.bedrooms),
    "review_fact": Query(FACT, clean.review_fact),
    "review_fact_scored": Query(FACT, lambda li: clean.scored(clean.review_fact(li))),
    "review_fact_rooms": Query(
        ROOMS_FACT, lambda li: clean.review_fact(li).withColumnRenamed("neighbourhood_group", "neighbourhood")
    ),
    "rooms_spot_check": Query(
        ["name", "bedrooms", "bathrooms_text"], lambda li: clean.named(clean.review_fact(li), SPOT_CHECK)
    ),
    "rooms_spot_check_raw": Query(["name", "bedrooms", "bathrooms_text"], lambda li: clean.named(li, SPOT_CHECK)),
    "priced_rated_listings": Query(
        list(orders_binding.COLUMNS), lambda li: _dates_as_text(clean.priced_and_rated(li), "host_since")
    ),
    "listing_details": Query(DETAILS, clean.listing_details),
    # key figures and price ranges
    "kpi_overall": Query([*RELIABLE, "accommodates"], summary.kpi),
    "kpi_by_borough": Query([BOROUGH, *RELIABLE, "accommodates"], lambda li: summary.kpi(li, BOROUGH)),
    "dashboard": Query(
        [BOROUGH, AREA, "room_type", "property_type", *RELIABLE, "accommodates", "review_scores_cleanliness"],
        lambda li: _rounded(summary.dashboard(li, DASHBOARD), "average_reliable_rating", "average_cleanliness", "price_score_r"),
    ),
    "price_by_property_type": Query(["property_type", *PRICED], lambda li: summary.price_summary(li, "property_type")),
    "price_by_room_type": Query(["room_type", *PRICED], lambda li: summary.price_summary(li, "room_type")),
    "price_by_property_type_any_case": Query(
        ["property_type", "host_id", *PRICED],
        lambda li: summary.price_summary(_respelled(li, "property_type"), "property_type", match="ci"),
    ),
    "price_by_borough": Query([BOROUGH, *PRICED], lambda li: summary.price_summary(li, BOROUGH)),
    "price_by_area": Query([AREA, *PRICED_RATED], lambda li: summary.price_summary(li, AREA, rated_only=True)),
    "listings_describe": Query(
        _DESCRIBED, lambda li: _rounded(profile.describe(clean.with_price(li), [*_DESCRIBED[1:], "pricing"]), *_STATISTICS)
    ),
    # scores
    "score_by_area": _scored_by(summary.score_mean, "neighbourhood", AREA),
    "score_by_property_type": _scored_by(summary.score_mean, "property_type", "property_type"),
    "score_by_room_type": _scored_by(summary.score_mean, "room_type", "room_type"),
    "weighted_score_by_room_type": _scored_by(summary.weighted_score, "room_type", "room_type", reviews=True),
    "score_range_by_property_type": _range_by("property_type", "property_type"),
    "score_range_by_room_type": _range_by("room_type", "room_type"),
    "score_range_by_area": _range_by("neighbourhood", AREA),
    "score_range_by_borough": _range_by("neighbourhood_group", BOROUGH),
    "lowest_scored_area": _scored_by(summary.lowest_scored, "neighbourhood", AREA, reviews=True),
    "cleanliness_by_room_type": _range_by("room_type", "room_type", "cleanliness"),
    "cleanliness_by_area": _range_by("neighbourhood", AREA, "cleanliness"),
    "cleanliness_by_borough": _range_by("neighbourhood_group", BOROUGH, "cleanliness"),
    # correlations
    "corr_price_score": _corr("price", []),
    "corr_price_score_by_area": _corr("price", ["neighbourhood"]),
    "corr_price_score_by_property_type": _corr("price", ["property_type"], positive=True),
    "corr_price_score_by_room_type": _corr("price", ["room_type"], MANY_REVIEWS, positive=True),
    "corr_price_score_by_area_room": _corr("price", ["neighbourhood", "room_type"]),
    "corr_price_score_by_borough_room": _corr("price", ["neighbourhood_group", "room_type"]),
    "corr_bedrooms_score": _corr("bedrooms", []),
    "corr_bedrooms_score_by_borough": _corr("bedrooms", ["neighbourhood_group"]),
    "corr_bedrooms_score_by_property_type": _corr("bedrooms", ["property_type"], positive=True),
    "corr_bedrooms_score_by_room_type": _corr("bedrooms", ["room_type"], positive=True),
    "corr_bedrooms_score_by_borough_room": _corr("bedrooms", ["neighbourhood_group", "room_type"]),
    "corr_bathrooms_score": _corr("bathrooms", []),
    "corr_bathrooms_score_by_borough": _corr("bathrooms", ["neighbourhood_group"]),
    "corr_bathrooms_score_by_room_type": _corr("bathrooms", ["room_type"], positive=True),
    "corr_bathrooms_score_by_borough_room": _corr("bathrooms", ["neighbourhood_group", "room_type"]),
    # hosts
    "local_hosts": Query(LOCAL, hosts.local_hosts),
    "local_host_count": Query(LOCAL, hosts.local_host_count),
    "local_host_count_any_case": Query(
        LOCAL,
        # The home is shown in its spelling, so hosts alone are respelled.
        lambda li: hosts.local_host_count(_respelled(li, "host_name"), match="ci"),
    ),
    "local_host_listings": Query(LOCAL_DETAILS, hosts.local_host_listings, (_host_columns,)),
    "local_host_by_borough": Query(LOCAL_DETAILS, hosts.local_host_by_borough, (_host_columns,)),
    "local_host_in_borough": Query(
        LOCAL_DETAILS, lambda li, all_: hosts.local_host_by_borough(li, all_, borough=ONE_BOROUGH), (_host_columns,)
    ),
    "host_signup_running": Query(
        ["host_since", *PRICED], lambda li: _dates_as_text(hosts.signup_running(li), "host_date")
    ),
    "listings_per_host": Query(["host_id", *PRICED_RATED], hosts.listings_per_host),
    "multi_listing_hosts": Query(["host_id", *PRICED_RATED], lambda li: hosts.listings_per_host(li, 3)),
    "listings_of_hosts_over": Query(["host_id", *PRICED_RATED], hosts.listings_of_hosts_over),
    "top_host_share": Query(["host_id", *PRICED_RATED], lambda li: _rounded(hosts.top_host_share(li), "percent")),
    "host_concentration": Query(
        ["host_id", *PRICED_RATED], lambda li: _rounded(hosts.host_concentration(li), "host_share", "listing_share")
    ),
    # superhosts, over the title join
    "superhost_scorecard": Query(
        [*TITLED, *SUB_SCORES], lambda li: _rounded(title_join.superhost_scorecard(li), "score", *clean.SUB_SCORES)
    ),
    "superhost_rates_any_case": Query(
        [*TITLED, "host_id", "host_response_rate", "host_acceptance_rate"],
        lambda li: _rounded(title_join.superhost_rates(_half_titles(li), match="ci"), "avg_response_rate", "avg_acceptance_rate"),
    ),
    "superhost_scorecard_stored": Query(
        [*TITLED, *SUB_SCORES],
        lambda li: _rounded(
            title_join.superhost_scorecard(_stored(li, "by-title", bucket_by="name", buckets=16)), "score", *clean.SUB_SCORES
        ),
    ),
    "superhost_rates": Query(
        [*TITLED, "host_response_rate", "host_acceptance_rate"],
        lambda li: _rounded(title_join.superhost_rates(li), "avg_response_rate", "avg_acceptance_rate"),
    ),
    "superhost_instant_bookable": Query(
        [*TITLED, "instant_bookable"],
        lambda li: _plain_counts(title_join.superhost_instant_bookable(li), "instant_bookable", "total"),
    ),
    "superhost_share_by_borough": Query(
        [*TITLED, BOROUGH],
        lambda li, v: _plain_counts(title_join.superhost_share(li, BOROUGH, values=v), "total_hosts", "superhosts"),
        (orders_binding.boroughs,),
    ),
    "superhost_share_by_room_type": Query(
        [*TITLED, "room_type"],
        lambda li, v: _plain_counts(title_join.superhost_share(li, "room_type", values=v), "total_hosts", "superhosts"),
        (orders_binding.room_types,),
    ),
    "superhost_availability": Query(
        [*TITLED, *[f"availability_{d}" for d in (30, 60, 90, 365)]],
        lambda li: _rounded(title_join.superhost_availability(li), "a30", "a60", "a90", "a365"),
    ),
    "score_histogram": Query(
        ["name", *RELIABLE], lambda li: _plain_counts(title_join.score_histogram(li), "count")
    ),
    # areas
    "area_window_metrics": Query(
        [BOROUGH, AREA, *RELIABLE], lambda li: _rounded(running.area_window_metrics(li), "avgp", "scores")
    ),
    "area_summary": Query(AREA_SUMMARY, lambda li: regions.area_summary(li).orderBy(BOROUGH, AREA)),
    "area_summary_remapped": _remapped(lambda summary_: summary_.orderBy(*_REGION_KEY)),
    "region_head": _remapped(lambda s: profile.head(s, _REGION_KEY)),
    "region_describe": _remapped(
        lambda s: _rounded(profile.describe(s, ["listings", *REGION_MEASURES], summary=True), *_STATISTICS)
    ),
    "region_describe_measures": _remapped(lambda s: _rounded(profile.describe(s, REGION_MEASURES, summary=True), *_STATISTICS)),
    "region_corr": _remapped(lambda s: _rounded(correlation.correlation_matrix(s, REGION_MEASURES), "r")),
    "region_corr_stored": _remapped(
        lambda s: _rounded(correlation.correlation_matrix(_stored(s, "regions"), REGION_MEASURES), "r")
    ),
    "region_heatmap": _remapped(
        lambda s: correlation.rounded_for_heatmap(correlation.correlation_matrix(s, REGION_MEASURES))
    ),
    "region_filter": _remapped(lambda s: s.filter(F.col(BOROUGH) == ONE_BOROUGH)),
    "region_tail": _remapped(lambda s: profile.tail(s.filter(F.col(BOROUGH) == ONE_BOROUGH), _REGION_KEY)),
    "region_corr_by_borough": _remapped(
        lambda s: _rounded(correlation.correlation_matrix(s, REGION_MEASURES, BOROUGH), "r")
    ),
    "boroughs": _remapped(lambda s: profile.distinct_values(s, BOROUGH)),
}
