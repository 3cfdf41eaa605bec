"""Pearson correlation: overall, by group, and as a matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.measures import pearson_r


def pearson(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """r between ``x`` and ``y`` for each group, or overall; groups without a defined r are left out."""
    grouped = df.groupBy(*by).agg(pearson_r(F.col(x), F.col(y)).alias("r")).filter(F.col("r").isNotNull())
    return grouped.orderBy(*by) if by else grouped


def pearson_moments(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row with n, the sums r is usually worked out from, and r; no row if r is not defined."""
    cx, cy = F.col(x), F.col(y)
    moments = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(cx).alias("sx"),
        F.sum(cy).alias("sy"),
        F.sum(cx * cy).alias("sxy"),
        F.sum(cx * cx).alias("sx2"),
        F.sum(cy * cy).alias("sy2"),
        pearson_r(cx, cy).alias("r"),
    )
    return moments.filter(F.col("r").isNotNull())


def correlation_matrix(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """Correlation of every two of ``cols`` as rows ``(by, col_x, col_y, r)``, for all groups at once.

    Each pair uses the rows that have both values. r is NULL where it is not defined, and 1 on the
    diagonal otherwise.
    """
    group = [by] if by else []
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    cells = F.array(*[_pair_state(i, j, cols) for i, j in pairs])
    states = shared_moments(df, cols, by).select(*group, F.inline(cells))
    # A pair's state is merged over the kinds of rows that have both values: first the means, then what the means differ by.
    per_pair = Window.partitionBy(*group, "col_x", "col_y")
    for side in "xy":
        mean = F.try_divide(F.sum(F.col("_n") * F.col(f"_m{side}")).over(per_pair), F.sum("_n").over(per_pair))
        states = states.withColumn(f"_d{side}", F.col(f"_m{side}") - mean)

    def moment(within: str, a: str, b: str) -> Column:
        return F.sum(F.col("_n") * (F.col(within) + F.col(a) * F.col(b)))

    varies = (F.min("_lowx") < F.max("_highx")) & (F.min("_lowy") < F.max("_highy"))
    spread = F.sqrt(moment("_vx", "_dx", "_dx")) * F.sqrt(moment("_vy", "_dy", "_dy"))
    r = F.when(F.col("col_x") == F.col("col_y"), 1.0).otherwise(F.try_divide(moment("_c", "_dx", "_dy"), spread))
    merged = states.groupBy(*group, "col_x", "col_y").agg(F.when(varies, r).alias("r"))
    mirrored = F.array(F.struct("col_x", "col_y"), F.struct(F.col("col_y").alias("col_x"), F.col("col_x").alias("col_y")))
    both = F.when(F.col("col_x") == F.col("col_y"), F.slice(mirrored, 1, 1)).otherwise(mirrored)
    return merged.select(*group, "r", F.inline(both)).select(*group, "col_x", "col_y", "r")


def shared_moments(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """One state for all of ``cols``: a row for each group and set of columns that are not NULL together.

    In such a set every column has the same rows, so counts, means and extremes are kept once a column and a
    co-moment once a pair: k(k+1)/2 + 3k + 1 aggregates. Without NULLs there is one row for each group.
    """
    numbers = [F.col(c).cast("double") for c in cols]
    known = df.select(*([by] if by else []), *[x.alias(f"_{i}") for i, x in enumerate(numbers)])
    known = known.withColumn("_has", F.concat(*[F.when(F.col(f"_{i}").isNull(), "0").otherwise("1") for i in range(len(cols))]))
    states = [F.count(F.lit(1)).alias("_n")]
    for i in range(len(cols)):
        states += [F.avg(f"_{i}").alias(f"_mean{i}"), F.min(f"_{i}").alias(f"_low{i}"), F.max(f"_{i}").alias(f"_high{i}")]
        states.append(F.var_pop(f"_{i}").alias(f"_c{i}_{i}"))
        states += [F.covar_pop(f"_{i}", f"_{j}").alias(f"_c{i}_{j}") for j in range(i + 1, len(cols))]
    return known.groupBy(*([by] if by else []), "_has").agg(*states)


def _pair_state(i: int, j: int, cols: list[str]) -> Column:
    """What a row of :func:`shared_moments` knows of two columns; it counts no rows unless it has both."""
    both = (F.substring("_has", i + 1, 1) == "1") & (F.substring("_has", j + 1, 1) == "1")
    parts = {"_mx": f"_mean{i}", "_my": f"_mean{j}", "_c": f"_c{i}_{j}", "_vx": f"_c{i}_{i}", "_vy": f"_c{j}_{j}"}
    parts |= {"_lowx": f"_low{i}", "_highx": f"_high{i}", "_lowy": f"_low{j}", "_highy": f"_high{j}"}
    return F.struct(
        F.lit(cols[i]).alias("col_x"),
        F.lit(cols[j]).alias("col_y"),
        F.when(both, F.col("_n")).otherwise(0).alias("_n"),
        *[F.when(both, F.col(c)).alias(name) for name, c in parts.items()],
    )


def rounded_for_heatmap(matrix: DataFrame) -> DataFrame:
    """The matrix with one-decimal labels, as a heatmap shows it."""
    return matrix.withColumn("r", F.round("r", 1))
