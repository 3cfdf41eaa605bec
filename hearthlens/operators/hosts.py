"""Hosts: who lives where they list, sign-ups over time, how concentrated listings are."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import fold, parse_money
from ..schema import AREA, BOROUGH, RATING
from .clean import priced, priced_and_rated
from .running import numbered_within
from .spread import sorted_rows

_KEYS = ["_name_key", "_home_key"]
PLAIN = "UTF8_BINARY"


def _as_key(listings: DataFrame, match: str) -> Callable[[str], Column]:
    """How names and places are compared: exactly, without case, or as the first collated one of these columns is."""
    kinds = [listings.schema[c].dataType for c in ("host_name", "host_neighbourhood", AREA) if c in listings.columns]
    collations = [k.collation for k in kinds if isinstance(k, StringType) and k.collation != PLAIN]
    if not collations:
        return (lambda c: fold(F.col(c))) if match == "ci" else F.col
    if match == "ci":
        return lambda c: fold(F.collate(F.col(c), PLAIN))
    return lambda c: F.collate(F.col(c), collations[0])


def _keyed(rows: DataFrame, key: Callable[[str], Column]) -> DataFrame:
    """Rows with a host name and a home area, and the keys these are matched by."""
    keyed = rows.select("*", key("host_name").alias("_name_key"), key("host_neighbourhood").alias("_home_key"))
    return keyed.filter("_name_key is not null and _home_key is not null")


def _places(listings: DataFrame, key: Callable[[str], Column]) -> DataFrame:
    """The (host name, area) pairs that are both lived in and listed in, once each.

    Each listing is counted once for its host's home and once for its own area, so one pass and one
    group-by replace the self-join.
    """
    lives = F.struct(key("host_neighbourhood").alias("_home_key"), F.lit(True).alias("home"))
    lists = F.struct(key(AREA).alias("_home_key"), F.lit(False).alias("home"))
    places = listings.select(key("host_name").alias("_name_key"), F.inline(F.array(lives, lists)))
    told = places.filter("_name_key is not null and _home_key is not null").groupBy(*_KEYS)
    both = told.agg(F.bool_or("home").alias("_lived"), F.bool_or(~F.col("home")).alias("_listed"))
    return both.filter("_lived and _listed").select(*_KEYS)


def _local_host_rows(listings: DataFrame, match: str) -> DataFrame:
    """Distinct hosts with a listing under their name in their home area.

    Adaptive execution splits the rows of a name that holds many of them, as the places hold each name and area once.
    """
    key = _as_key(listings, match)
    hosts = _keyed(listings.select("host_id", "host_name", "host_neighbourhood").distinct(), key)
    return hosts.join(_places(listings, key), _KEYS, "left_semi").drop(*_KEYS)


def local_hosts(listings: DataFrame, match: str = "binary") -> DataFrame:
    """Hosts with a listing under their name in the area they live in."""
    return _local_host_rows(listings, match).orderBy("host_neighbourhood", "host_id", "host_name")


def local_host_count(listings: DataFrame, match: str = "binary") -> DataFrame:
    """Number of such hosts in each home area. Hosts are matched by name, so namesakes count."""
    per_home = _local_host_rows(listings, match).groupBy("host_neighbourhood")
    return per_home.agg(F.countDistinct("host_id").alias("hosts_live_here")).orderBy("host_neighbourhood")


_DETAILS = [
    "host_id",
    "host_name",
    "host_neighbourhood",
    "name",
    "neighborhood_overview",
    BOROUGH,
    "property_type",
    "room_type",
    "accommodates",
    "price",
    RATING,
    "number_of_reviews",
]


def _local_details(rows: DataFrame, hosts: DataFrame, match: str) -> DataFrame:
    """Distinct details of the rows whose host is local, by home area and then by score times reviews."""
    key = _as_key(hosts, match)
    local = _keyed(rows, key).join(_places(hosts, key), _KEYS, "left_semi").drop(*_KEYS)
    details = local.distinct().withColumnRenamed(BOROUGH, "borough")
    most_loved = F.desc(F.col(RATING) * F.col("number_of_reviews"))
    return sorted_rows(details, "host_neighbourhood", most_loved).drop("host_id")


def local_host_listings(listings: DataFrame, hosts: DataFrame | None = None, match: str = "binary") -> DataFrame:
    """All rated listings of local hosts, by home area and then by score times reviews.

    ``hosts`` may give the same listings with only the host and area columns, where these are cheaper
    to read on their own.
    """
    rows = listings.filter(F.col("neighbourhood").isNotNull() & F.col(RATING).isNotNull()).select(*_DETAILS)
    return _local_details(rows, listings if hosts is None else hosts, match)


def local_host_by_borough(
    listings: DataFrame,
    hosts: DataFrame | None = None,
    borough: str | None = None,
    min_reviews: int = 10,
    match: str = "binary",
) -> DataFrame:
    """Well-reviewed priced listings of local hosts, in one borough or in all, with numeric price.

    ``hosts`` as in :func:`local_host_listings`; it is not narrowed to the borough.
    """
    rows = listings.filter(F.col("neighbourhood").isNotNull() & (F.col(RATING) > 0))
    rows = rows.filter(F.col("number_of_reviews") > min_reviews)
    if borough is not None:
        rows = rows.filter(F.col(BOROUGH) == borough)
    rows = rows.withColumn("price", parse_money(F.col("price"))).filter("price > 0").select(*_DETAILS)
    return _local_details(rows, listings if hosts is None else hosts, match)


def signup_running(listings: DataFrame, after_year: int = 2000) -> DataFrame:
    """Priced listings by their host's sign-up date, numbered within the date from the cheapest on."""
    # A comparison of dates, unlike one of years, can be left to a Parquet scan.
    first_day = F.make_date(F.lit(after_year + 1), F.lit(1), F.lit(1))
    dated = listings.withColumn("host_date", F.col("host_since").try_cast("date"))
    rows = priced(dated.filter(F.col("host_date") >= first_day)).select("pricing", "host_date")
    return numbered_within(rows, "host_date", "pricing", "counts").orderBy("host_date", "counts")


def listings_per_host(listings: DataFrame, more_than: int = 0) -> DataFrame:
    """Priced and rated listings of each host with more than ``more_than`` of them, largest first."""
    per_host = _per_host(listings).filter(F.col("listings") > more_than)
    return per_host.orderBy(F.desc("listings"), "host_id")


def _per_host(listings: DataFrame) -> DataFrame:
    return priced_and_rated(listings).groupBy("host_id").agg(F.count(F.lit(1)).alias("listings"))


def listings_of_hosts_over(listings: DataFrame, more_than: int = 0) -> DataFrame:
    """Total listings of the hosts with more than ``more_than`` of them."""
    return _per_host(listings).filter(F.col("listings") > more_than).agg(F.sum("listings").alias("listings"))


def top_host_share(listings: DataFrame, percent: float = 4) -> DataFrame:
    """Percent of the listings held by the ``percent`` percent of hosts with the most, rounded up.

    Hosts are never ranked one by one: how many hosts have each size is enough. A table of n
    listings has at most sqrt(2n) different sizes, which bounds the rows of the window.
    """
    sizes = _per_host(listings).groupBy("listings").agg(F.count(F.lit(1)).alias("hosts"))
    everyone = Window.partitionBy()
    larger = Window.orderBy(F.desc("listings")).rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.ceil(F.sum("hosts").over(everyone) * F.lit(Decimal(str(percent))) / 100)
    taken = F.least(F.col("hosts"), wanted - F.coalesce(F.sum("hosts").over(larger), F.lit(0)))
    held = sizes.select("listings", "hosts", F.greatest(taken, F.lit(0)).cast("long").alias("taken"))
    top, total = F.sum(F.col("listings") * F.col("taken")), F.sum(F.col("listings") * F.col("hosts"))
    return held.agg(F.try_divide(top.cast("double") * 100, total.cast("double")).alias("percent"))


def host_concentration(listings: DataFrame, thresholds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """For each threshold: hosts with more listings than that, what they hold, and both as shares."""
    total_row = _per_host(listings).agg(
        F.count(F.lit(1)).alias("hosts_total"),
        F.sum("listings").alias("listings_total"),
        *[F.count_if(F.col("listings") > t).alias(f"hosts_{t}") for t in thresholds],
        *[F.sum(F.when(F.col("listings") > t, F.col("listings")).otherwise(0)).alias(f"held_{t}") for t in thresholds],
    )
    lines = F.array(
        *[
            F.struct(F.lit(t).alias("more_than"), F.col(f"hosts_{t}").alias("hosts"), F.col(f"held_{t}").alias("held"))
            for t in thresholds
        ]
    )
    return total_row.select(F.inline(lines), "hosts_total", "listings_total").select(
        "more_than",
        "hosts",
        F.col("held").alias("listings"),
        F.try_divide(F.col("hosts").cast("double"), F.col("hosts_total")).alias("host_share"),
        F.try_divide(F.col("held").cast("double"), F.col("listings_total")).alias("listing_share"),
    )
