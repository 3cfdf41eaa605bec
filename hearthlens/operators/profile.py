"""Looking at a table: column statistics, first and last rows, distinct values."""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import ceil, floor, isnan

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
#: Different values of a column that one task may hold.
HELD = 10_000
#: A sketch of n values is off by n / ACCURACY ranks at most.
ACCURACY = 10_000


def describe(df: DataFrame, cols: list[str], held: int = HELD, summary: bool = False) -> DataFrame:
    """One row per column: count, mean, std, min, quartiles and max over its non-NULL values.

    Quartiles interpolate between values and are exact at any size, see :func:`exact_quantiles`, which reads ``df`` a few times at once. A
    ``summary`` of few rows is described by one lazy query instead, in which each quartile keeps all different values in memory.
    """
    statistics = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min}
    if summary:
        statistics |= {name: (lambda v, p=p: F.percentile(v, p)) for name, p in QUARTILES.items()}
    statistics["max"] = F.max
    # One wide row, which then becomes a row for each column.
    values = [f(F.col(f"`{c}`").cast("double")).alias(f"{i}_{s}") for i, c in enumerate(cols) for s, f in statistics.items()]
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *values)
    found = {s: [F.col(f"{i}_{s}") for i in range(len(cols))] for s in statistics}
    if not summary:
        known = exact_quantiles(df, cols, list(QUARTILES.values()), held)
        for name, p in QUARTILES.items():
            found[name] = [F.lit(known[c][p]).cast("double") for c in cols]
    names = ["count", "mean", "std", "min", *QUARTILES, "max"]
    rows = [F.struct(F.lit(c).alias("measure"), *[found[s][i].alias(s) for s in names]) for i, c in enumerate(cols)]
    return wide.filter("_n > 0").select(F.inline(F.array(*rows)))


@dataclass
class _Bracket:
    """Where the values of the ranks ``first`` and ``last`` are: between ``low`` and ``high``, both included."""

    column: str
    first: int
    last: int
    low: float
    high: float
    below: int  # values less than low
    inside: int
    different: int

    def holds(self, value: Column) -> Column:
        return (value >= F.lit(self.low)) & (value <= F.lit(self.high))

    @property
    def is_single(self) -> bool:
        return self.low == self.high or isnan(self.low)


def exact_quantiles(df: DataFrame, cols: list[str], probabilities: list[float], held: int = HELD) -> dict[str, dict[float, float | None]]:
    """Exact quantiles of numbers, interpolated between neighbouring ranks; NULLs are left out, and NaN is the largest value.

    Distributed selection: the values that a rank may have are narrowed from both sides. Each round sketches the values in question, takes
    two of them a little below and above the rank, and counts exactly how many values are less than the one and how many lie
    between, for all columns and ranks in one pass. A round leaves less than a thousandth of the different values. When about ``held`` of them are
    left at most, their counts tell the ranks. No task, nor the driver, holds more than that of a column and rank, at any number of rows.
    """
    held = max(held, 8)  # two neighbouring ranks and what a sketch may be off by
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    value = {c: F.col(f"v{i}") for i, c in enumerate(cols)}
    whole = rows.agg(*[f(v) for v in value.values() for f in (F.count, F.min, F.max, F.approx_count_distinct)]).first()
    found: dict[str, dict[float, float | None]] = {c: dict.fromkeys(probabilities) for c in cols}
    brackets = {}
    for i, c in enumerate(cols):
        n, low, high, different = whole[4 * i : 4 * i + 4]
        for p in probabilities if n else []:
            at = p * (n - 1)
            brackets[c, p] = at, _Bracket(c, floor(at), ceil(at), low, high, 0, n, different)
    slack = 2
    while wide := [b for _, b in brackets.values() if b.different > held and not b.is_single]:
        if slack > ACCURACY:
            raise RuntimeError("the values can't be told apart")
        _narrow(rows, value, wide, slack)
        # A rank lies outside its new bracket only if a sketch is further off than it promises; the next is taken wider.
        slack *= 2
    several = [b for _, b in brackets.values() if not b.is_single]
    told = _values_at(rows, value, several) if several else {}
    for (c, p), (at, b) in brackets.items():
        first, last = (b.low, b.low) if b.is_single else told[id(b)]
        found[c][p] = first if b.first == b.last else (b.last - at) * first + (at - b.first) * last
    return found


def _narrow(rows: DataFrame, value: dict[str, Column], wide: list[_Bracket], slack: int) -> None:
    """Takes the ends of the brackets nearer to their ranks. Two passes."""
    sketches = []
    for b in wide:
        steps = max(b.inside - 1, 1)
        near = [max(0.0, (b.first - b.below) / steps - slack / ACCURACY), min(1.0, (b.last - b.below) / steps + slack / ACCURACY)]
        sketches.append(F.percentile_approx(F.when(b.holds(value[b.column]), value[b.column]), near, ACCURACY))
    ends = rows.agg(*sketches).first()
    tried = [replace(b, low=low, high=high) for b, (low, high) in zip(wide, ends)]
    counts = []
    for t in tried:
        v = value[t.column]
        counts += [F.count_if(v < F.lit(t.low)), F.count_if(t.holds(v)), F.approx_count_distinct(F.when(t.holds(v), v))]
    counted = rows.agg(*counts).first()
    for i, (b, t) in enumerate(zip(wide, tried)):
        below, inside, different = counted[3 * i : 3 * i + 3]
        if below <= b.first and b.last < below + inside:
            b.low, b.high, b.below, b.inside, b.different = t.low, t.high, below, inside, different


def _values_at(rows: DataFrame, value: dict[str, Column], brackets: list[_Bracket]) -> dict[int, tuple[float, float]]:
    """The values at both ranks of each bracket, from the counts of the different values in it."""
    cells = [F.struct(F.when(b.holds(value[b.column]), i).alias("_key"), value[b.column].alias("_value")) for i, b in enumerate(brackets)]
    inside = rows.select(F.inline(F.array(*cells))).filter("_key is not null")
    counts = inside.groupBy("_key", "_value").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_key").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    ranks = [F.get(F.array(*[F.lit(r - b.below).cast("long") for b, r in zip(brackets, rs)]), F.col("_key"))
             for rs in ([b.first for b in brackets], [b.last for b in brackets])]
    placed = counts.withColumn("_upto", upto)
    at = [(F.col("_upto") - F.col("_n") <= r) & (r < F.col("_upto")) for r in ranks]
    chosen = placed.groupBy("_key").agg(*[F.max(F.when(a, F.col("_value"))) for a in at]).collect()
    return {id(brackets[k]): (first, last) for k, first, last in chosen}


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows by ``order``."""
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The last ``n`` rows by ``order``, given in that order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()
