"""Listings joined with the review facts of every listing of the same title.

The join repeats a listing for each well-reviewed listing of its title, so a title held by n of them gives n
rows per listing. Here it is never carried out: both sides shrink to sums per title within one shuffle, and
the sums are multiplied by how often the join would have repeated them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import SCORE_BUCKETS, round_to, score_bucket
from ..functions.text import flag, fold, number_text, parse_money, percent_text, range_text
from ..schema import RATING
from .clean import SUB_SCORES, fact_column

# Joined rows grow with the square of a title's listings, beyond the range of a long for hot titles.
_COUNT = "decimal(38,0)"
#: Values of a dimension that a title keeps counts of as columns.
MOST_VALUES = 64


def _titled(listings: DataFrame, min_reviews: int, match: str, columns: dict[str, Column]) -> DataFrame:
    """Listings with a title: its key, whether others may join to their facts, and ``columns``.

    Only priced and rated listings with more than ``min_reviews`` reviews may be joined to.
    """
    title = fold(F.col("name")) if match == "ci" else F.col("name")
    joinable = (fact_column("price") > 0) & (F.col("number_of_reviews") > min_reviews) & F.col(RATING).isNotNull()
    return listings.filter(F.col("name").isNotNull()).select(
        title.alias("title"),
        F.coalesce(joinable, F.lit(False)).alias("joinable"),
        *[c.alias(name) for name, c in columns.items()],
    )


def _sum_over_join(count: str, repeats: str) -> Column:
    """Aggregate: the sum of a per-title count whose rows the join repeats."""
    return F.sum(F.col(count).cast(_COUNT) * F.col(repeats)).cast(_COUNT)


def _mean_over_join(measure: str, repeats: str) -> Column:
    """Aggregate: the mean of a measure whose non-NULL values the join repeats."""
    times = F.col(repeats).cast("double")
    return F.try_divide(F.sum(F.col(f"sum_{measure}") * times), F.sum(F.col(f"count_{measure}") * times))


def _by_superhost(
    listings: DataFrame,
    min_reviews: int,
    match: str,
    means: dict[str, Column] | None = None,
    tallies: dict[str, Column] | None = None,
    facts: Sequence[str] = (),
    price_range: bool = False,
    keep: Column | None = None,
) -> DataFrame:
    """The joined rows summed up by superhost flag, with their number in ``total``.

    Gives the mean of each listing measure in ``means`` and each fact column in ``facts``, the sum of each 0/1
    measure in ``tallies``, and the extremes ``low`` and ``high`` of the fact price. ``keep`` filters the listings
    and not the facts. The flag has two values, so one row per title holds both kinds of listings and the facts.
    """
    means, tallies = means or {}, tallies or {}
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    columns = {"flag": flag(F.col("host_is_superhost")), "kept": kept}
    columns |= means | tallies | {f"fact_{f}": fact_column(f) for f in facts}
    if price_range:
        columns["fact_price"] = fact_column("price")
    rows = _titled(listings, min_reviews, match, columns).filter("kept or joinable")

    per_title = [F.count_if("joinable").alias("n_facts")]
    for f in facts:
        value = F.when(F.col("joinable"), F.col(f"fact_{f}"))
        per_title += [F.sum(value).alias(f"sum_{f}"), F.count(value).alias(f"count_{f}")]
    if price_range:
        price = F.when(F.col("joinable"), F.col("fact_price"))
        per_title += [F.min(price).alias("low"), F.max(price).alias("high")]
    sides = []
    for side in (0, 1):
        mine = F.col("kept") & (F.col("flag") == side)
        per_title.append(F.count_if(mine).alias(f"n_{side}"))
        fields = [F.lit(side).alias("superhost"), F.col(f"n_{side}").alias("n")]
        for m in [*means, *tallies]:
            value = F.when(mine, F.col(m))
            per_title += [F.sum(value).alias(f"sum_{m}_{side}"), F.count(value).alias(f"count_{m}_{side}")]
            fields += [F.col(f"sum_{m}_{side}").alias(f"sum_{m}"), F.col(f"count_{m}_{side}").alias(f"count_{m}")]
        sides.append(F.struct(*fields))
    titles = rows.groupBy("title").agg(*per_title).filter("n_facts > 0")
    shared = [c for c in titles.columns if c != "title" and not c.endswith(("_0", "_1"))]
    pairs = titles.select(*shared, F.inline(F.array(*sides))).filter("n > 0")

    return pairs.groupBy("superhost").agg(
        _sum_over_join("n", "n_facts").alias("total"),
        *[_mean_over_join(m, "n_facts").alias(m) for m in means],
        *[_sum_over_join(f"sum_{t}", "n_facts").alias(t) for t in tallies],
        *[_mean_over_join(f, "n").alias(f) for f in facts],
        *[F.min("low").alias("low"), F.max("high").alias("high")][: 2 * price_range],
    )


def superhost_scorecard(listings: DataFrame, min_reviews: int = 10, match: str = "binary") -> DataFrame:
    """Mean listing price, range of joined prices and the mean of seven scores, by superhost flag.

    The mean price takes in unpriced listings of a title, as only the joined facts must be priced.
    """
    scores = ["score", *SUB_SCORES]
    prices = {"listing_price": parse_money(F.col("price"))}
    card = _by_superhost(listings, min_reviews, match, means=prices, facts=scores, price_range=True)
    return card.select(
        "superhost",
        round_to(F.col("listing_price"), 2).alias("avg_price"),
        range_text(F.col("low"), F.col("high")).alias("price_range"),
        *scores,
    )


def superhost_rates(listings: DataFrame, min_reviews: int = 10, match: str = "binary") -> DataFrame:
    """Mean response and acceptance rate by superhost flag, an unknown rate counting as 0."""
    rates = {f"avg_{r}_rate": F.coalesce(f"host_{r}_rate", F.lit(0.0)) for r in ("response", "acceptance")}
    return _by_superhost(listings, min_reviews, match, means=rates).drop("total")


def superhost_availability(listings: DataFrame, min_reviews: int = 10, match: str = "binary") -> DataFrame:
    """Mean days available in the next 30, 60, 90 and 365, over listings with any in the next 30."""
    days = {f"a{d}": F.col(f"availability_{d}") for d in (30, 60, 90, 365)}
    return _by_superhost(listings, min_reviews, match, means=days, keep=F.col("availability_30") > 0).drop("total")


def superhost_instant_bookable(listings: DataFrame, min_reviews: int = 10, match: str = "binary") -> DataFrame:
    """Instantly bookable joined rows, all joined rows and the percentage, by superhost flag."""
    bookable = {"instant_bookable": flag(F.col("instant_bookable"))}
    counts = _by_superhost(listings, min_reviews, match, tallies=bookable)
    percent = percent_text(F.col("instant_bookable"), F.col("total")).alias("percent_bookable")
    return counts.select("superhost", "instant_bookable", "total", percent)


def superhost_share(
    listings: DataFrame, dim: str, min_reviews: int = 10, match: str = "binary", values: DataFrame | None = None
) -> DataFrame:
    """Joined rows, those of superhosts and their percentage for each value of the listing's ``dim``.

    What a title keeps is a count for each value of ``dim``, which adds up before the one shuffle by title, however hot the
    title. For that the values are looked up first; ``values`` may give them, in one column, where that is cheaper to read than the
    listings, and a listing with another value then fails the query. More than :data:`MOST_VALUES` values are not kept as columns: their counts
    become rows by title and value, which are shuffled twice.
    """
    columns = {dim: F.col(dim), "flag": flag(F.col("host_is_superhost"))}
    rows = _titled(listings, min_reviews, match, columns)
    source = listings.select(dim) if values is None else values
    known = [r[0] for r in source.distinct().limit(MOST_VALUES + 1).collect()]
    if len(known) > MOST_VALUES:
        counts = _share_by_rows(rows, dim)
    else:
        if values is not None:
            # An unknown place may be one that no value was given for.
            known = [*known, *[None for _ in range(None not in known)]]
        counts = _share_by_columns(rows, dim, known)
    percent = percent_text(F.col("superhosts"), F.col("n")).alias("percent_superhosts")
    return counts.select(dim, F.col("n").alias("total_hosts"), "superhosts", percent).orderBy(dim)


def _share_by_columns(rows: DataFrame, dim: str, known: list) -> DataFrame:
    """``dim n superhosts`` over the join, with a column for each of the known values while counting."""
    kind = rows.schema[dim].dataType
    found = [F.col(dim).eqNullSafe(F.lit(v).cast(kind)) for v in known]
    number = F.lit(None).cast("int")
    for i, is_value in enumerate(found):
        number = F.when(is_value, i).otherwise(number)
    unknown = F.raise_error(F.concat(F.lit(f"{dim} has a value that was not given: "), F.col(dim).cast("string"))).cast("int")
    rows = rows.withColumn("_nth", F.coalesce(number, unknown))
    per_title = [F.count_if("joinable").alias("n_facts")]
    for i in range(len(known)):
        per_title += [F.count_if(F.col("_nth") == i).alias(f"n_{i}"), F.sum(F.when(F.col("_nth") == i, F.col("flag"))).alias(f"s_{i}")]
    titles = rows.groupBy("title").agg(*per_title).filter("n_facts > 0")
    sums = [_sum_over_join(f"{c}_{i}", "n_facts").alias(f"{c}_{i}") for i in range(len(known)) for c in "ns"]
    lines = [
        F.struct(F.lit(v).cast(kind).alias(dim), F.col(f"n_{i}").alias("n"), F.col(f"s_{i}").alias("superhosts"))
        for i, v in enumerate(known)
    ]
    if not lines:
        lines = [F.struct(F.lit(None).cast(kind).alias(dim), F.lit(0).cast(_COUNT).alias("n"), F.lit(0).cast(_COUNT).alias("superhosts"))]
        sums = [F.count(F.lit(1))]
    return titles.agg(*sums).select(F.inline(F.array(*lines))).filter("n > 0")


def _share_by_rows(rows: DataFrame, dim: str) -> DataFrame:
    """The same with a row for each title and value."""
    parts = rows.groupBy("title", dim).agg(
        F.count(F.lit(1)).alias("n"), F.sum("flag").alias("superhosts"), F.count_if("joinable").alias("n_facts")
    )
    # One row per value of dim under each title, so the window holds few rows however hot the title is.
    facts = F.sum("n_facts").over(Window.partitionBy("title"))
    pairs = parts.withColumn("n_facts", facts).filter("n_facts > 0")
    return pairs.groupBy(dim).agg(*[_sum_over_join(c, "n_facts").alias(c) for c in ("n", "superhosts")])


def score_histogram(listings: DataFrame, min_reviews: int = 10, match: str = "binary") -> DataFrame:
    """Joined rows and their percentage for each whole-point band of the joined score; no empty bands."""
    rows = _titled(listings, min_reviews, match, {"band": score_bucket(F.col(RATING))})
    bands = [*SCORE_BUCKETS, None]
    in_band = [F.col("joinable") & F.col("band").eqNullSafe(F.lit(b)) for b in bands]
    per_title = [F.count_if(c).alias(f"band_{i}") for i, c in enumerate(in_band)]
    titles = rows.groupBy("title").agg(F.count(F.lit(1)).alias("n"), *per_title)
    sums = titles.agg(*[_sum_over_join("n", f"band_{i}").alias(f"band_{i}") for i in range(len(bands))])
    lines = [
        F.struct(F.lit(b).cast("string").alias("range"), F.col(f"band_{i}").alias("count")) for i, b in enumerate(bands)
    ]
    counts = sums.select(F.inline(F.array(*lines))).filter(F.col("count") > 0)
    whole = F.sum("count").over(Window.partitionBy())
    share = F.col("count").cast("double") * 100 / whole.cast("double")
    return counts.withColumn("percent", F.concat(number_text(round_to(share, 2)), F.lit("%"))).orderBy("range")
