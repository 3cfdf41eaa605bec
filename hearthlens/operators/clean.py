"""Typed listings and the review facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, parse_bathrooms, parse_money, superhost_label
from ..schema import AREA, BOROUGH, RATING
from .spread import sorted_rows

# review fact column -> listings column and the expression over it
_FACT = {
    "name": ("name", F.col),
    "neighbourhood_group": (BOROUGH, F.col),
    "neighbourhood": (AREA, F.col),
    "property_type": ("property_type", F.col),
    "room_type": ("room_type", F.col),
    "price": ("price", lambda c: parse_money(F.col(c))),
    "reviews": ("number_of_reviews", F.col),
    "score": (RATING, F.col),
    "score_accuracy": ("review_scores_accuracy", F.col),
    "cleanliness": ("review_scores_cleanliness", F.col),
    "checkin": ("review_scores_checkin", F.col),
    "communication": ("review_scores_communication", F.col),
    "location": ("review_scores_location", F.col),
    "value": ("review_scores_value", F.col),
    "bedrooms": ("bedrooms", lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))),
    "bathrooms": ("bathrooms_text", lambda c: parse_bathrooms(F.col(c))),
}
SUB_SCORES = ["score_accuracy", "cleanliness", "checkin", "communication", "location", "value"]


def fact_column(name: str) -> Column:
    """The review fact column ``name`` as an expression over a listings row."""
    source, expression = _FACT[name]
    return expression(source)


def collated(listings: DataFrame, columns: list[str], collation: str = "UTF8_LCASE_RTRIM") -> DataFrame:
    """Text columns that every operator then compares without case and trailing blanks.

    Grouping collated text sorts it where plain text is hashed. The joins over host names and titles do the
    same by hash with ``match='ci'``.
    """
    return listings.withColumns({c: F.collate(F.col(c), collation) for c in columns})


def with_price(listings: DataFrame) -> DataFrame:
    """Listings with the money text as a number in ``pricing``."""
    return listings.withColumn("pricing", parse_money(F.col("price")))


def priced(listings: DataFrame) -> DataFrame:
    """Listings asking more than nothing."""
    return with_price(listings).filter("pricing > 0")


def priced_and_rated(listings: DataFrame) -> DataFrame:
    # The rating first: it is the cheaper test, and the one a Parquet scan can take over.
    return priced(listings.filter(F.col(RATING) > 0))


def review_fact(listings: DataFrame) -> DataFrame:
    """One row per listing with numeric price, scores and room counts.

    A listings frame holding only some columns gives the fact columns that follow from those.
    """
    return listings.select(*[fact_column(c).alias(c) for c, (source, _) in _FACT.items() if source in listings.columns])


def scored(fact: DataFrame, min_reviews: int | None = None, positive: bool = False) -> DataFrame:
    """Priced rows with a score; more than ``min_reviews`` reviews, and a score above 0, if asked for."""
    rows = fact.filter("score > 0" if positive else "score is not null")
    if min_reviews is not None:
        rows = rows.filter(F.col("reviews") > min_reviews)
    return rows.filter("price > 0")


def ordered_listings(listings: DataFrame) -> DataFrame:
    """All listings by id."""
    return sorted_rows(listings, "id")


def clean_prices(listings: DataFrame) -> DataFrame:
    """Property type and price of the priced listings, dearest first."""
    rows = priced(listings).select("id", "property_type", "pricing")
    return sorted_rows(rows, F.desc("pricing")).select("property_type", "pricing")


def bathrooms(listings: DataFrame) -> DataFrame:
    """Number of bathrooms of every listing, in listing order."""
    rows = listings.select("id", parse_bathrooms(F.col("bathrooms_text")).alias("bathrooms"))
    return sorted_rows(rows, "id").select("bathrooms")


def bedrooms(listings: DataFrame) -> DataFrame:
    """Number of bedrooms of every listing, unknown as 0, in listing order."""
    rows = listings.select("id", F.coalesce(F.col("bedrooms").cast("double"), F.lit(0.0)).alias("bedrooms"))
    return sorted_rows(rows, "id").select("bedrooms")


def named(rows: DataFrame, names: list[str], match: str = "binary") -> DataFrame:
    """Rows with one of the given titles; ``match='ci'`` ignores case and trailing blanks."""
    if match == "ci":
        return rows.filter(fold(F.col("name")).isin(*[n.rstrip(" ").lower() for n in names]))
    return rows.filter(F.col("name").isin(*names))


def listing_details(listings: DataFrame) -> DataFrame:
    """Detail rows for a dashboard: priced, rated and with a named host, sorted by superhost label."""
    rows = priced_and_rated(listings).filter(F.col("host_name").isNotNull())
    details = rows.select(
        "id",
        "host_id",
        "host_name",
        F.coalesce("name", F.lit(" - ")).alias("name"),
        F.coalesce("neighborhood_overview", F.lit(" - ")).alias("neighborhood_overview"),
        AREA,
        BOROUGH,
        F.col("pricing").alias("price"),
        "property_type",
        "room_type",
        superhost_label(F.col("host_is_superhost")).alias("superhost"),
        RATING,
        "latitude",
        "longitude",
        "accommodates",
        parse_bathrooms(F.col("bathrooms_text")).alias("bathrooms"),
        F.coalesce("bedrooms", F.lit(0.0)).alias("bedrooms"),
        "minimum_nights",
        "maximum_nights",
        "review_scores_accuracy",
        "review_scores_checkin",
        "review_scores_cleanliness",
        "review_scores_communication",
        "review_scores_location",
        "review_scores_value",
        "number_of_reviews",
        "listing_url",
    )
    return sorted_rows(details, "superhost").drop("id")
