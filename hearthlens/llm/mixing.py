"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its share of all tokens to the power of an exponent from 0 (all sources alike) to 1 (as they
are), normalised. The exponent is bisected until the weights reach a target entropy or no source is repeated more
often than a limit. Budgets follow the weights and are as small as they can be without dropping a document: the source that is
repeated least is dealt once. A source is dealt in passes, each a permutation of all its documents, the last cut where
the budget is spent. The mixture is cut into blocks that hold each source by its weight, in an order of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import id_of, row_key, whole_row, written

#: Exponents tried in one pass over the sources; each pass narrows the interval by this factor plus one.
TRIED_AT_ONCE = 63
PASSES = 8
#: Slots of a pass are told by so many hexadecimal digits of the permutation's key.
SLOT_DIGITS = 3
MAX_REPEATS = 1.5
BLOCK_TOKENS = 100_000
SEED = "mix"

WORD = r"[^ \t\n\x0B\f\r]+"


def count_words(text: Column) -> Column:
    """Tokens of a text as the mixture counts them: runs without ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def exponent(sources: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None) -> float:
    """The exponent in [0, 1] for ``sources`` (``_source``, ``_total`` > 0), by repeated narrowing of an interval.

    With ``max_repeats``, the least exponent at which no source is dealt more often than that; with ``entropy``, the
    greatest at which the weights' entropy in nats still reaches it (0 if none does). A pass over the sources
    tries many exponents at once and sends back one number for each.
    """
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give either max_repeats or entropy")
    total = sources.agg(F.sum("_total")).first()[0]
    if not total:
        return 1.0
    share = F.col("_total") / F.lit(float(total))
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        step = (high - low) / (TRIED_AT_ONCE + 1)
        tried = [low + step * (k + 1) for k in range(TRIED_AT_ONCE)]
        if entropy is None:
            tests = [F.max(F.pow(share, F.lit(a - 1))) / F.min(F.pow(share, F.lit(a - 1))) for a in tried]
            met = [bool(x <= max_repeats) for x in sources.agg(*tests).first()]
            # Met from some exponent on.
            first = met.index(True) if True in met else len(tried)
            low, high = (tried[first - 1] if first else low), (tried[first] if first < len(tried) else high)
        else:
            power = [F.pow(share, F.lit(a)) for a in tried]
            found = sources.agg(*[F.sum(p) for p in power], *[F.sum(p * F.log(p)) for p in power]).first()
            sums, logs = found[: len(tried)], found[len(tried) :]
            met = [math.log(s) - x / s >= entropy for s, x in zip(sums, logs)]
            # Met up to some exponent.
            last = met.index(False) if False in met else len(tried)
            low, high = (tried[last - 1] if last else low), (tried[last] if last < len(tried) else high)
    return high if entropy is None else low


def _items(docs: DataFrame) -> DataFrame:
    """Distinct documents with their tokens; rows equal in all columns are one item, dealt together."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    rows = docs.select(
        F.coalesce(source, F.lit("")).alias("_source"),
        *row_key(),
        F.xxhash64(whole_row(docs)).alias("_row"),
        count_words(F.col("text").cast("string")).alias("_words"),
    )
    # A row's hash tells its document; copies of it are summed up before they move.
    items = rows.groupBy("_source", "_id", "_text", "_row", "_words").agg(F.count(F.lit(1)).alias("_copies"))
    return items.withColumn("_tokens", F.col("_words") * F.col("_copies"))


def mixture(
    docs: DataFrame,
    max_repeats: float | None = MAX_REPEATS,
    entropy: float | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: str = SEED,
) -> DataFrame:
    """The order in which documents are dealt: a row per document and pass.

    Columns: ``_source _id _text _row`` (which rows), ``_words``, ``_pass`` from 0, ``_block`` and ``_place`` in it, both
    from 0. A NULL source counts as the empty one. Sources without a token are dealt once, and a document
    without one as often as full passes go; nothing is left out. An empty table gives no rows.
    """
    items = written(_items(docs), "items")
    sources = items.groupBy("_source").agg(F.sum("_tokens").alias("_total"))
    sources = written(sources, "sources")
    real = sources.filter("_total > 0")
    power = exponent(real, max_repeats, entropy)
    # Weight over tokens, against the source for which that is least.
    most = real.agg(F.max("_total")).first()[0] or 1
    ratio = F.pow(F.lit(float(most)) / F.col("_total"), F.lit(1.0 - power))
    budget = F.when(F.col("_total") > 0, F.floor(F.col("_total") * ratio)).otherwise(0).cast("long")
    dealt = sources.withColumn("_budget", F.greatest(budget, F.col("_total")))
    dealt = dealt.withColumn("_full", F.when(F.col("_total") > 0, F.floor(F.col("_budget") / F.col("_total"))).otherwise(1).cast("long"))
    dealt = dealt.withColumn("_passes", F.col("_full") + (F.col("_budget") > F.col("_full") * F.col("_total")).cast("int"))
    dealt = written(dealt, "budgets")
    blocks = max(1, math.ceil((dealt.agg(F.sum("_budget")).first()[0] or 0) / block_tokens))

    # The budgets are joined by source: adaptive execution splits a source that holds much of the rows.
    rows = items.join(dealt, "_source")
    rows = rows.withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_passes") - 1)))
    parts = [F.lit(seed), F.col("_pass"), F.col("_source"), F.col("_id")]
    rows = rows.withColumn("_key", F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")))
    rows = rows.withColumn("_slot", F.substring("_key", 1, SLOT_DIGITS))
    slots = rows.groupBy("_source", "_pass", "_slot").agg(F.sum("_tokens").alias("_in_slot"))
    # At most 16 ** SLOT_DIGITS rows for a source and pass, however many documents it has.
    earlier = Window.partitionBy("_source", "_pass").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select("_source", "_pass", "_slot", F.coalesce(F.sum("_in_slot").over(earlier), F.lit(0)).alias("_start"))
    before = Window.partitionBy("_source", "_pass", "_slot").orderBy("_key", "_text", "_row")
    running = F.coalesce(F.sum("_tokens").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_within", running).join(starts, ["_source", "_pass", "_slot"])
    placed = placed.withColumn("_before", F.col("_pass") * F.col("_total") + F.col("_start") + F.col("_within"))
    placed = placed.filter((F.col("_pass") < F.col("_full")) | (F.col("_before") < F.col("_budget")))
    part = F.floor(F.col("_before").cast("double") / F.greatest("_budget", F.lit(1)).cast("double") * F.lit(float(blocks)))
    placed = placed.withColumn("_block", F.least(part, F.lit(blocks - 1)).cast("long"))
    inside = Window.partitionBy("_block").orderBy("_key", "_text", "_row")
    place = F.row_number().over(inside) - 1
    return placed.select("_source", "_id", "_text", "_row", "_words", "_pass", "_block", place.cast("long").alias("_place"))


def mixture_report(docs: DataFrame, **options) -> DataFrame:
    """The mixture by ``doc_id``: ``source``, ``n_tokens``, ``pass``, ``block`` and ``place`` in the block."""
    return mixture(docs, **options).select(
        id_of(F.col("_id")).alias("doc_id"),
        F.col("_source").alias("source"),
        F.col("_words").alias("n_tokens"),
        F.col("_pass").alias("pass"),
        F.col("_block").alias("block"),
        F.col("_place").alias("place"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mixture deals them: all columns, repeated by passes, block by block in each partition."""
    order = written(mixture(docs, **options).select("_id", "_text", "_row", "_block", "_place"), "mixture")
    keyed = docs.select(*row_key(), F.xxhash64(whole_row(docs)).alias("_row"), whole_row(docs).alias("_doc"))
    dealt = keyed.join(order, ["_id", "_text", "_row"])
    return dealt.repartition("_block").sortWithinPartitions("_block", "_place").select("_doc.*")


#: What :func:`mixture_report` gives for a table ``documents``, whose ids are unique. With a limit on repeats, the exponent
#: that bisection approaches has a closed form.
REPORT_SQL = rf"""
with items as (
  select doc_id, coalesce(source, '') as source,
    cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as n_tokens
  from documents
), sources as (
  select source, cast(sum(n_tokens) as bigint) as total from items group by source
), bounds as (
  select max(total) as most, min(total) as least from sources where total > 0
), power as (
  select most, case when least is null or most <= least * {MAX_REPEATS} then 0.0
    else greatest(0.0, 1 - ln({MAX_REPEATS}) / ln(cast(most as double) / least)) end as alpha from bounds
), budgets as (
  select source, total, greatest(total, case when total > 0
    then cast(floor(total * pow(cast(most as double) / total, 1.0 - alpha) + 1e-7) as bigint) else 0 end) as budget
  from sources, power
), dealt as (
  select *, case when total > 0 then budget // total else 1 end as full_passes from budgets
), blocks as (
  select greatest(1, cast(ceil(sum(budget) / {float(BLOCK_TOKENS)}) as bigint)) as n from dealt
), passes as (
  select i.*, d.total, d.budget, d.full_passes, p as pass, md5('{SEED}:' || p || ':' || i.source || ':' || i.doc_id) as k
  from items i join dealt d using (source), unnest(range(0, d.full_passes + case when d.budget > d.full_passes * d.total then 1 else 0 end)) as u(p)
), placed as (
  select *, pass * total + coalesce(sum(n_tokens) over (partition by source, pass order by k rows between unbounded preceding and 1 preceding), 0) as before
  from passes
), kept as (
  select p.*, least(cast(floor(cast(before as double) / cast(greatest(budget, 1) as double) * cast(b.n as double)) as bigint), b.n - 1) as block
  from placed p, blocks b where pass < full_passes or before < budget
)
select doc_id, source, n_tokens, cast(pass as bigint) as pass, cast(block as bigint) as block,
  cast(row_number() over (partition by block order by k) - 1 as bigint) as place
from kept
"""
