"""Borough and area summaries, on the areas as listed or as merged by a mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import round_to
from ..schema import AREA, BOROUGH, RATING
from .clean import priced_and_rated


def _area_parts(listings: DataFrame) -> DataFrame:
    """Counts, sums and extremes of each area, which combine into those of larger areas."""
    rows = priced_and_rated(listings).filter("accommodates <> 0")
    return rows.groupBy(BOROUGH, AREA).agg(
        F.count(F.lit(1)).alias("listings"),
        F.min("pricing").alias("minp"),
        F.max("pricing").alias("maxp"),
        F.sum("pricing").alias("sump"),
        F.min(RATING).alias("minscores"),
        F.max(RATING).alias("maxscores"),
        F.sum(RATING).alias("sumscores"),
        F.sum("number_of_reviews").alias("rev"),
        F.sum("accommodates").alias("acc"),
    )


def _summary(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.select(
        *keys,
        "listings",
        F.round("minp", 2).alias("minp"),
        F.round("maxp", 2).alias("maxp"),
        round_to(F.col("sump") / F.col("listings"), 2).alias("avgp"),
        F.round("minscores", 2).alias("minscores"),
        F.round("maxscores", 2).alias("maxscores"),
        round_to(F.col("sumscores") / F.col("listings"), 2).alias("avgscores"),
        "rev",
        "acc",
    )


def area_summary(listings: DataFrame) -> DataFrame:
    """Listings, price and rating ranges and means, reviews and beds of each area, in no order."""
    return _summary(_area_parts(listings), BOROUGH, AREA)


def area_summary_remapped(listings: DataFrame, mapping: DataFrame) -> DataFrame:
    """The same for merged areas. ``mapping`` has ``(area, merged_area)``; other areas keep their name.

    Listings are summed up by area before the mapping is looked up, so the join sees one row for each
    area whatever the number of listings or the size of the mapping.
    """
    targets = mapping.groupBy("area").agg(F.min("merged_area").alias("merged_area"))
    merged = (
        _area_parts(listings)
        .join(targets, F.col(AREA) == F.col("area"), "left")
        .withColumn("neighbourhood_area", F.coalesce("merged_area", AREA))
        .groupBy(BOROUGH, "neighbourhood_area")
        .agg(
            *[F.min(c).alias(c) for c in ("minp", "minscores")],
            *[F.max(c).alias(c) for c in ("maxp", "maxscores")],
            *[F.sum(c).alias(c) for c in ("listings", "sump", "sumscores", "rev", "acc")],
        )
    )
    return _summary(merged, BOROUGH, "neighbourhood_area")
