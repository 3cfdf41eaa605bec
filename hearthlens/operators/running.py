"""Window results worked out from counts, so that no key's rows have to meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import AREA, BOROUGH, RATING
from .clean import priced_and_rated
from .spread import repeat_rows


def numbered_within(df: DataFrame, key: str, value: str, number: str, band: float = 1.0) -> DataFrame:
    """``(value, key, number)`` with the rows of each key numbered 1, 2, ... by rising value.

    The rows shrink to counts of equal (key, value) first. Values are
    then taken in bands of width ``band``: the numbers before a band come from the band totals, the
    numbers inside it from a window over that band alone.
    """
    pairs = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_band", F.floor(F.col(value) / band))
    in_band = Window.partitionBy(key, "_band").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    bands = pairs.groupBy(key, "_band").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy(key).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0))
    offsets = bands.select(F.col(key).alias("_of"), F.col("_band").alias("_at"), offset.alias("_before"))
    # Null-safe equality adds no NULL filters to either side, so both read the same shuffle of the counts.
    same_band = F.col(key).eqNullSafe(F.col("_of")) & F.col("_band").eqNullSafe(F.col("_at"))
    placed = (
        pairs.withColumn("_inside", F.coalesce(F.sum("_n").over(in_band), F.lit(0)))
        .join(offsets, same_band)
        .select(key, value, (F.col("_before") + F.col("_inside")).alias("_first"), "_n")
    )
    each = repeat_rows(placed, "_n", "_nth")
    return each.select(value, key, (F.col("_first") + F.col("_nth")).alias(number))


def area_window_metrics(listings: DataFrame) -> DataFrame:
    """For every priced and rated listing: mean price, mean rating and review total of its area so far.

    "So far" runs over the area's boroughs in order, with all listings of a borough at once. The three
    values are thus the same for all listings of one area in one borough: they are worked out from one row
    for each of those, which is then repeated.
    """
    parts = (
        priced_and_rated(listings)
        .groupBy(BOROUGH, AREA)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("pricing").alias("_price"),
            F.sum(RATING).alias("_rating"),
            F.sum("number_of_reviews").alias("_reviews"),
        )
    )
    so_far = Window.partitionBy(AREA).orderBy(BOROUGH)
    listings_so_far = F.sum("_n").over(so_far)
    metrics = parts.select(
        BOROUGH,
        AREA,
        (F.sum("_price").over(so_far) / listings_so_far).alias("avgp"),
        (F.sum("_rating").over(so_far) / listings_so_far).alias("scores"),
        F.sum("_reviews").over(so_far).alias("rev"),
        "_n",
    )
    return repeat_rows(metrics, "_n", "_nth").drop("_nth")
