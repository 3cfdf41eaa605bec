"""Vectors in blocks: a stated query set against all rows, a block of queries and a block of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import written

#: Rows and queries of a block.
ROWS = 4096
QUERIES = 1024
#: Blocks of rows that one task searches one after the other.
CHAIN = 4
#: Every so many ids is a query.
QUERY_STEP = 20

FOUND = "qblock long, place long, copies long, query_id long, vec_id long, score double"


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """``vec_id`` and ``embedding`` (doubles) of the rows that take part.

    Left out: NULL ids, NULL or empty vectors, vectors with a NULL or non-finite component, and with ``zero``
    unset, vectors of zeros. Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)))
    return rows if zero else rows.filter(F.exists("embedding", lambda x: x != 0))


def distinct_rows(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows that differ in id or vector, written, with ``copies``, how often each occurs; and the length of all vectors.

    Vectors of different lengths are refused, as they have no inner product.
    """
    rows = written(vectors.groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("copies")), "vectors")
    shortest, longest = rows.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if shortest != longest:
        raise ValueError(f"vectors have from {shortest} to {longest} components")
    return rows, shortest or 1


def _blocks(rows: DataFrame, each: int, number: int, prefix: str) -> DataFrame:
    """One row per block: ``{prefix}block``, its ids, its vectors and copies as pieces of memory, by id. Equal rows share a block."""

    def gather(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("vec_id", kind="stable")
        packed = np.stack(block["embedding"].to_numpy()).astype("<f8").tobytes()
        ids, copies = (block[c].to_numpy("<i8").tobytes() for c in ("vec_id", "copies"))
        return pd.DataFrame({f"{prefix}block": [key[0]], "ids": [ids], "vectors": [packed], "copies": [copies]})

    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(number)))
    return dealt.groupBy("_block").applyInPandas(gather, f"{prefix}block long, ids binary, vectors binary, copies binary")


Search = Callable[[np.ndarray, np.ndarray, np.ndarray], Iterable[tuple[np.ndarray, np.ndarray]]]


class _Chain:
    """The best ``k`` so far of each query of a block, while blocks of rows go by."""

    def __init__(self, block: int, ids: np.ndarray, queries: np.ndarray, copies: np.ndarray, k: int):
        self.block, self.ids, self.queries, self.copies, self.k = block, ids, queries, copies, k
        self.found = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)

    def meet(self, ids: np.ndarray, rows: np.ndarray, search: Callable[[np.ndarray, np.ndarray], Search]) -> None:
        floors = np.array([s[-1] if len(s) == self.k else -np.inf for _, s in self.found])
        for n, (places, scores) in enumerate(search(ids, rows)(self.ids, self.queries, floors)):
            more = np.flatnonzero(scores >= floors[n])
            every = np.concatenate([self.found[n][0], ids[places[more]]]), np.concatenate([self.found[n][1], scores[more]])
            best = best_of(*every, self.k)
            self.found[n] = every[0][best], every[1][best]

    def rows(self) -> pd.DataFrame:
        sizes = [len(i) for i, _ in self.found]
        return pd.DataFrame(
            {
                "qblock": np.full(sum(sizes), self.block),
                "place": np.repeat(np.arange(len(sizes)), sizes),
                "copies": np.repeat(self.copies, sizes),
                "query_id": np.repeat(self.ids, sizes),
                "vec_id": np.concatenate([i for i, _ in self.found]),
                "score": np.concatenate([s for _, s in self.found]),
            }
        )


def nearest_in_blocks(
    rows: DataFrame,
    width: int,
    search: Callable[[np.ndarray, np.ndarray], Search],
    k: int,
    query_step: int = QUERY_STEP,
    block_rows: int = ROWS,
    block_queries: int = QUERIES,
    chain: int = CHAIN,
) -> DataFrame:
    """The ``k`` best of all other rows for each row whose id is divisible by ``query_step``, as ``query_id rank vec_id score``.

    ``rows`` come from :func:`distinct_rows`. Each row is a query of its own, also where ids repeat, and never meets itself; rows that
    share its id it meets. ``search(ids, vectors)`` makes an index of a block of rows, and what that gives is called with the
    ids and vectors of a block of queries and, per query, the score below which nothing is wanted (``floors``); it returns places and
    scores for each query. A query's floor is the k-th best of the blocks before, along a chain of ``chain`` blocks that one task
    reads one after the other, so it holds two blocks and the best so far. A chain's results depend on its blocks alone.
    """
    # A row can take up to k ranks, once for each copy, and is left out once as the query itself.
    candidates = rows.select("vec_id", "embedding", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k + 1).cast("long")))).alias("copies"))
    queries = rows.filter(F.col("vec_id") % query_step == 0)
    n_rows, n_queries = candidates.count(), queries.count()
    n_row_blocks, n_query_blocks = max(1, ceil(n_rows / block_rows)), max(1, ceil(n_queries / block_queries))
    row_blocks = written(_blocks(candidates, block_rows, n_row_blocks, "r"), "row-blocks")
    query_blocks = written(_blocks(queries, block_queries, n_query_blocks, "q"), "query-blocks")
    n_chains = ceil(n_row_blocks / chain)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    parts = ["ids", "vectors", "copies"]
    first = query_blocks.select("qblock", every(n_chains).alias("chain"), F.lit(-1).cast("long").alias("rblock"), *parts)
    others = row_blocks.select(every(n_query_blocks).alias("qblock"), F.floor(F.col("rblock") / chain).alias("chain"), "rblock", *parts)
    number = (F.col("qblock") * n_chains + F.col("chain")).cast("int")
    # In each chain the block of queries comes first.
    met = first.unionAll(others).repartitionById(n_query_blocks * n_chains, number).sortWithinPartitions("qblock", "chain", "rblock")

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        now = None
        for batch in batches:
            for qblock, rblock, ids, vectors, copies in zip(*[batch[c] for c in ("qblock", "rblock", *parts)]):
                ids, vectors = np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, width)
                if rblock < 0:
                    if now:
                        yield now.rows()
                    now = _Chain(qblock, ids, vectors, np.frombuffer(copies, "<i8"), k)
                elif now and now.block == qblock:
                    now.meet(ids, vectors, search)
        if now:
            yield now.rows()

    found = met.drop("chain").mapInPandas(run, FOUND)
    best = Window.partitionBy("qblock", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    again = F.sequence(F.lit(1).cast("long"), "copies")
    return ranked.withColumn("_copy", F.explode(again)).select("query_id", "rank", "vec_id", "score")


def own_place(ids: np.ndarray, rows: np.ndarray, query_id: int, query: np.ndarray) -> int:
    """Where a block, sorted by id, holds the query itself (the first of equal rows), or -1."""
    first, end = np.searchsorted(ids, query_id), np.searchsorted(ids, query_id, side="right")
    same = np.flatnonzero((rows[first:end] == query).all(axis=1))
    return int(first + same[0]) if len(same) else -1


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores; of equal ones, those of the smallest ids."""
    if len(ids) > k:
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        kept = np.arange(len(ids))
    return kept[np.lexsort((ids[kept], -scores[kept]))][:k]
