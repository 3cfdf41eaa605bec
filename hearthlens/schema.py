"""The listings table: one wide row per listing."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _LONG, _INT, _DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

LISTINGS = T.StructType(
    [
        T.StructField("id", _LONG),
        T.StructField("listing_url", _STRING),
        T.StructField("name", _STRING),
        T.StructField("neighborhood_overview", _STRING),
        T.StructField("host_id", _LONG),
        T.StructField("host_name", _STRING),
        T.StructField("host_since", T.DateType()),
        T.StructField("host_response_rate", _DOUBLE),
        T.StructField("host_acceptance_rate", _DOUBLE),
        T.StructField("host_is_superhost", _STRING),
        T.StructField("host_neighbourhood", _STRING),
        T.StructField("neighbourhood", _STRING),
        T.StructField("neighbourhood_cleansed", _STRING),
        T.StructField("neighbourhood_group_cleansed", _STRING),
        T.StructField("latitude", _DOUBLE),
        T.StructField("longitude", _DOUBLE),
        T.StructField("property_type", _STRING),
        T.StructField("room_type", _STRING),
        T.StructField("accommodates", _INT),
        T.StructField("bathrooms_text", _STRING),
        T.StructField("bedrooms", _DOUBLE),
        T.StructField("price", _STRING),
        T.StructField("minimum_nights", _INT),
        T.StructField("maximum_nights", _INT),
        T.StructField("availability_30", _DOUBLE),
        T.StructField("availability_60", _DOUBLE),
        T.StructField("availability_90", _DOUBLE),
        T.StructField("availability_365", _DOUBLE),
        T.StructField("number_of_reviews", _INT),
        T.StructField("review_scores_rating", _DOUBLE),
        T.StructField("review_scores_accuracy", _DOUBLE),
        T.StructField("review_scores_cleanliness", _DOUBLE),
        T.StructField("review_scores_checkin", _DOUBLE),
        T.StructField("review_scores_communication", _DOUBLE),
        T.StructField("review_scores_location", _DOUBLE),
        T.StructField("review_scores_value", _DOUBLE),
        T.StructField("instant_bookable", _STRING),
    ]
)

AREA = "neighbourhood_cleansed"
BOROUGH = "neighbourhood_group_cleansed"
RATING = "review_scores_rating"

# The area summary once its areas are merged; also the input of the correlation steps.
REGION_MEASURES = ["minp", "maxp", "avgp", "minscores", "maxscores", "avgscores", "rev", "acc"]
REGION_SUMMARY = T.StructType(
    [
        T.StructField(BOROUGH, _STRING),
        T.StructField("neighbourhood_area", _STRING),
        T.StructField("listings", _LONG),
        *[T.StructField(c, _DOUBLE) for c in REGION_MEASURES[:6]],
        T.StructField("rev", _LONG),
        T.StructField("acc", _LONG),
    ]
)
