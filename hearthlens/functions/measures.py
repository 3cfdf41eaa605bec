"""Numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(number: Column, digits: int) -> Column:
    """Round half up, the same whatever order the partitions were summed in.

    The first rounding takes away the noise in the last bits of a floating-point sum, so that a
    value standing exactly on a half always goes the same way.
    """
    return F.round(F.round(number, 8 if digits < 4 else digits + 4), digits)


def significant(number: Column, digits: int = 10) -> Column:
    """Keep ``digits`` significant digits, for sums too large for a fixed number of decimals."""
    return F.format_string(f"%.{digits - 1}e", number.cast("double")).try_cast("double")


def pearson_r(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r over the rows that have both values.

    NULL for a group of one row or with a constant side. Constants are told by their extremes: both raw and
    centred moments may leave them a small positive variance once partial results are merged.
    """
    paired_x, paired_y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    varies = (F.min(paired_x) < F.max(paired_x)) & (F.min(paired_y) < F.max(paired_y))
    spread = F.stddev_pop(paired_x) * F.stddev_pop(paired_y)
    return F.when(varies, F.try_divide(F.covar_pop(x, y), spread))


SCORE_BUCKETS = ["0-1", "1-2", "2-3", "3-4", "4-5", "5"]


def score_bucket(score: Column) -> Column:
    """Whole-point band of a score; exactly 5 is its own band, outside 0 to 5 is NULL."""
    bucket = F.when((score >= 0) & (score < 1), SCORE_BUCKETS[0])
    for low in range(1, 5):
        bucket = bucket.when((score >= low) & (score < low + 1), SCORE_BUCKETS[low])
    return bucket.when(score == 5, SCORE_BUCKETS[5])
