"""Global sorts that split ties and copies, and rows written out many times."""

from __future__ import annotations

import uuid
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versions import shared_folder, write_version

#: Rows that a task writes out.
ROWS_A_TASK = 1_000_000


def sorted_rows(df: DataFrame, *order: str | Column) -> DataFrame:
    """Global sort in one pass. Ties are ordered by a hash of the row, and copies by the partition they come from, so ranges can split both.

    A task that is run again has the same rows in the same partition, if not in the same order; a number within it would not do. The
    hash is a column, as a sort makes its expressions anew each time it compares two rows.
    """
    told = df.withColumns({"_tie": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), "_from": F.spark_partition_id()})
    return told.orderBy(*order, "_tie", "_from").drop("_tie", "_from")


def repeat_rows(df: DataFrame, times: str, position: str, chunk: int = 10_000) -> DataFrame:
    """Each row ``times`` times, numbered 1, 2, ... in ``position``; ``times`` is dropped.

    The rows are stored first, so that no later run of a task finds other ones, and their times are added up. So many tasks share the
    work that each writes about :data:`ROWS_A_TASK` rows, whatever the session's number of partitions; large counts are cut into
    chunks, which are spread over them.
    """
    session = df.sparkSession
    stored = write_version(df.filter(F.col(times) > 0), f"{shared_folder(session)}/repeated-{uuid.uuid4().hex}")
    total = stored.agg(F.sum(times)).first()[0] or 0
    kept = [c for c in df.columns if c != times]
    one = F.lit(1).cast("long")
    last_chunk = F.floor((F.col(times) - 1) / chunk)
    chunks = stored.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)))
    first = F.col("_chunk") * chunk + one
    last = F.least(F.col(times), (F.col("_chunk") + one) * chunk)
    # With a number given, adaptive execution does not merge these few rows, each of which stands for many.
    tasks = max(ceil(total / ROWS_A_TASK), min(session.sparkContext.defaultParallelism, max(1, ceil(total / chunk))))
    spread = chunks if tasks == 1 else chunks.repartition(tasks, *[F.col(f"`{c}`") for c in stored.columns], "_chunk")
    return spread.select(*kept, F.explode(F.sequence(first, last)).alias(position))
