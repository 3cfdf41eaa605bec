"""Connected components of a graph given as links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node in ``links`` (``a``, ``b``).

    Stars alternate: each node first passes its smallest neighbour to the larger ones, then to the smaller ones, until
    every node hangs on its component's smallest. Every round is one query, written to the shared folder. A hub's links are not
    gathered; they meet its smallest neighbour in a join.
    """
    links = written(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_low")).select("a", F.least("a", "_low").alias("_low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("_low"))
        under = large.join(low, "a")
        small = under.select("a", F.col("_low").alias("b")).unionByName(
            under.filter("b != _low").select(F.col("b").alias("a"), F.col("_low").alias("b"))
        )
        links = written(small.distinct(), "links")
        after = _state(links)
        if after == state:
            break
        state = after
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
