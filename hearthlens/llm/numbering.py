"""Places of rows in an order, within each of many lists at once, however unevenly the lists are filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


def numbered(rows: DataFrame, lists: str, order: list[str], place: str, name: str) -> DataFrame:
    """``rows`` with their ``place`` from 0 within ``lists`` by ``order``, NULL before all else; a written table.

    One global sort, whose range partitions cut a long list into many. What stands before a partition's part of a list is added up from
    one row for each partition and list. Ranges can only split rows that differ somewhere in ``order``.
    """
    parts = [F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")]
    done = written(rows.orderBy(lists, *order).select("*", *parts), name)
    counts = done.groupBy("_part", lists).agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(lists).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    offsets = counts.select(F.col("_part").alias("_in"), F.col(lists).alias("_of"), (before - F.col("_first")).alias("_shift"))
    offsets = written(offsets, f"{name}-offsets")
    same = (F.col("_part") == F.col("_in")) & F.col(lists).eqNullSafe(F.col("_of"))
    placed = done.join(offsets, same).withColumn(place, F.col("_seq") + F.col("_shift"))
    return placed.drop("_part", "_seq", "_in", "_of", "_shift")
