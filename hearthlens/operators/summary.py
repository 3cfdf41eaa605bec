"""Grouped price and rating summaries. All of them combine on the map side before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import pearson_r, round_to
from ..functions.text import fold, money_text, range_text
from ..schema import RATING
from .clean import priced, priced_and_rated, scored


def kpi(listings: DataFrame, by: str | None = None) -> DataFrame:
    """Listings, beds, reviews, mean rating and mean price; per ``by`` only rated listings count."""
    rows = priced(listings.filter(F.col(RATING).isNotNull()) if by else listings)
    return rows.groupBy(*[by] if by else []).agg(
        F.count(F.lit(1)).alias("listings"),
        F.sum("accommodates").alias("accommodations"),
        F.sum("number_of_reviews").alias("reviews"),
        round_to(F.avg(RATING), 2).alias("average_rating"),
        money_text(round_to(F.avg("pricing"), 2)).alias("average_pricing"),
    )


def price_summary(listings: DataFrame, dim: str, rated_only: bool = False, match: str = "binary") -> DataFrame:
    """Units with lowest, highest and mean price for each value of ``dim``.

    Units count the values of ``dim``, so the group without a value has 0. With ``match="ci"`` values that differ in case or trailing
    blanks are one, shown in the spelling that is first in byte order. Rows are grouped by spelling, which hashes, and only these sums by the
    folded text, as a least spelling can't be kept in a hash table.
    """
    rows = priced_and_rated(listings) if rated_only else priced(listings)
    parts = rows.groupBy(F.col(dim).alias("category")).agg(
        F.count(dim).alias("units"),
        F.count(F.lit(1)).alias("_n"),
        F.min("pricing").alias("min_price"),
        F.max("pricing").alias("max_price"),
        F.sum("pricing").alias("_sum"),
    )
    if match == "ci":
        parts = parts.groupBy(fold(F.col("category")).alias("_key")).agg(
            F.min("category").alias("category"),
            *[F.sum(c).alias(c) for c in ("units", "_n", "_sum")],
            F.min("min_price").alias("min_price"),
            F.max("max_price").alias("max_price"),
        )
    mean = round_to(F.col("_sum") / F.col("_n"), 2)
    summary = parts.select("category", "units", "min_price", "max_price", mean.alias("avg_price"))
    return summary.withColumn("price_range", range_text(F.col("min_price"), F.col("max_price")))


def score_mean(fact: DataFrame, dim: str) -> DataFrame:
    """Mean score for each value of ``dim``."""
    return scored(fact).groupBy(dim).agg(round_to(F.avg("score"), 2).alias("avg_score")).orderBy(dim)


def weighted_score(fact: DataFrame, dim: str) -> DataFrame:
    """Mean score weighted by the number of reviews; NULL where nobody has reviewed."""
    weighted = F.try_divide(F.sum(F.col("score") * F.col("reviews")), F.sum("reviews").cast("double"))
    return scored(fact).groupBy(dim).agg(round_to(weighted, 2).alias("avg_mod_score")).orderBy(dim)


def score_range(fact: DataFrame, dim: str, measure: str = "score", min_reviews: int = 10) -> DataFrame:
    """Range text and mean of a score over listings with more than ``min_reviews`` reviews."""
    rows = scored(fact, min_reviews)
    return rows.groupBy(dim).agg(
        range_text(F.min(measure), F.max(measure)).alias("range_of_ratings"),
        F.avg(measure).alias("average_rating"),
    )


def lowest_scored(fact: DataFrame, dim: str, min_reviews: int = 10) -> DataFrame:
    """The value of ``dim`` with the lowest single score, the first by name on a tie."""
    return scored(fact, min_reviews).groupBy(dim).agg(F.min("score").alias("minimum")).orderBy("minimum", dim).limit(1)


def dashboard(listings: DataFrame, groupings: Sequence[Sequence[str]], min_reviews: int = 10) -> DataFrame:
    """All key figures of the priced listings for many groupings at once: one pass, and one shuffle of what each task has added up.

    ``groupings`` are lists of columns, the empty one for all listings. A row has the names of its grouping in ``dimension`` and the values
    in the columns, which are NULL where the grouping lacks them; a listing without a value is in the group without one. The figures are
    those of :func:`kpi`, :func:`price_summary`, :func:`score_mean`, :func:`weighted_score` and :func:`score_range` (for the rating and for
    cleanliness) and the correlation of price and rating, each over the listings that it takes. They are NULL, and texts of ranges empty at both
    ends, where a group has none of these. An empty table gives no rows.
    """
    columns = list(dict.fromkeys(c for g in groupings for c in g))
    rated, clean_score = F.col(RATING).isNotNull(), F.col("review_scores_cleanliness")
    reliable = rated & (F.col("number_of_reviews") > min_reviews)
    rows = priced(listings).select(
        *columns,
        "pricing",
        F.col("accommodates").alias("_beds"),
        F.col("number_of_reviews").alias("_reviews"),
        F.col(RATING).alias("_score"),
        rated.alias("_rated"),
        F.when(reliable, F.col(RATING)).alias("_reliable"),
        F.when(reliable, clean_score).alias("_clean"),
    )

    def of_rated(value: str) -> Column:
        return F.when(F.col("_rated"), F.col(value))

    sums = rows.groupingSets([[F.col(c) for c in g] for g in groupings], *columns).agg(
        *[F.grouping(c).alias(f"_without_{c}") for c in columns],
        F.count(F.lit(1)).alias("_listings"),
        F.count_if("_rated").alias("_rated_listings"),
        *[F.sum(v).alias(f"_sum{v}") for v in ("_beds", "_reviews")],
        *[F.sum(of_rated(v)).alias(f"_rated{v}") for v in ("_beds", "_reviews")],
        round_to(F.avg("_score"), 2).alias("avg_score"),
        round_to(F.avg("pricing"), 2).alias("avg_price"),
        round_to(F.avg(of_rated("pricing")), 2).alias("_rated_price"),
        F.min("pricing").alias("min_price"),
        F.max("pricing").alias("max_price"),
        round_to(F.try_divide(F.sum(F.col("_score") * F.col("_reviews")), F.sum(of_rated("_reviews")).cast("double")), 2).alias("avg_mod_score"),
        range_text(F.min("_reliable"), F.max("_reliable")).alias("range_of_ratings"),
        F.avg("_reliable").alias("average_reliable_rating"),
        range_text(F.min("_clean"), F.max("_clean")).alias("range_of_cleanliness"),
        F.avg("_clean").alias("average_cleanliness"),
        pearson_r(of_rated("pricing"), F.col("_score")).alias("price_score_r"),
    )
    # Which columns a row is grouped by tells its grouping.
    label, valued = F.lit(None).cast("string"), F.lit(True)
    for g in groupings:
        own = [F.col(f"_without_{c}") == (0 if c in g else 1) for c in columns]
        label = F.when(reduce(and_, own, F.lit(True)), ", ".join(g) or "all").otherwise(label)
    for c in columns:
        valued = valued & ((F.col(f"_without_{c}") == 1) | F.col(c).isNotNull())
    whole = label == "all"

    def by_grouping(all_listings: str, rated_listings: str) -> Column:
        return F.when(whole, F.col(all_listings)).otherwise(F.col(rated_listings))

    return sums.select(
        label.alias("dimension"),
        *columns,
        by_grouping("_listings", "_rated_listings").alias("listings"),
        by_grouping("_sum_beds", "_rated_beds").alias("accommodations"),
        by_grouping("_sum_reviews", "_rated_reviews").alias("reviews"),
        F.col("avg_score").alias("average_rating"),
        money_text(by_grouping("avg_price", "_rated_price")).alias("average_pricing"),
        F.when(valued, F.col("_listings")).otherwise(0).alias("units"),
        "min_price",
        "max_price",
        "avg_price",
        range_text(F.col("min_price"), F.col("max_price")).alias("price_range"),
        "avg_score",
        "avg_mod_score",
        "range_of_ratings",
        "average_reliable_rating",
        "range_of_cleanliness",
        "average_cleanliness",
        "price_score_r",
    )
