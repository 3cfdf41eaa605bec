"""Approximate nearest neighbours by a permutation index.

Each vector is represented by the order of its nearest pivots and posted under each of them, with the pivot's rank. A
query walks the postings of its own nearest pivots, which gives the footrule distance of its order to every vector's;
the best share of a block's vectors is scored exactly.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import QUERIES, ROWS, best_of, distinct_rows, nearest_in_blocks, own_place, usable

#: Pivots, taken from at most this many rows with the least hash of their id.
PIVOTS = 256
#: Nearest pivots by which a vector is posted.
POSTED = 64
#: Part of each block's vectors that is scored exactly, at least :data:`LEAST` of them.
SHARE = 0.18
LEAST = 256


def pivots(rows: DataFrame, number: int = PIVOTS) -> np.ndarray:
    """Distinct directions of the rows with the least hash of their id: a bounded sample, fitted on the driver."""
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(number).collect()
    found = np.array([r["embedding"] for r in chosen], np.float64)
    if len(found):
        # Scaled first, so that no length overflows.
        found = found / np.abs(found).max(axis=1, keepdims=True)
        found = found / np.linalg.norm(found, axis=1, keepdims=True)
    return np.unique(found, axis=0)


def orders(vectors: np.ndarray, pivots_: np.ndarray, posted: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first. By angle, as pivots have length one."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        return np.argsort(-(scaled @ pivots_.T), axis=1, kind="stable")[:, :posted]


class Postings:
    """The inverted file of one block of rows: for each pivot, how near it is to each row, from ``posted`` down to 1, and 0 if not posted.

    A posting has a place for every row, so that many are added up without looking rows up: two bytes for each pivot and row.
    """

    def __init__(self, order: np.ndarray, n_pivots: int):
        n, posted = order.shape
        # The largest sum must fit in.
        kind = np.int16 if posted * (posted + 1) // 2 <= np.iinfo(np.int16).max else np.int32
        self.weights = np.arange(posted, 0, -1, dtype=kind)
        self.near = np.zeros((n_pivots, n), kind)
        self.near[order, np.arange(n)[:, None]] = self.weights

    def closeness(self, order: np.ndarray) -> np.ndarray:
        """How much the footrule distance falls short of that between orders without a common pivot.

        With absent pivots placed after all others, a pivot at ranks i and j takes 2 * (posted - max(i, j)) off.
        """
        return np.minimum(self.near[order], self.weights[:, None]).sum(axis=0, dtype=self.near.dtype)


def nearest(
    vectors: DataFrame,
    k: int = 20,
    n_pivots: int = PIVOTS,
    posted: int = POSTED,
    share: float = SHARE,
    block_rows: int = ROWS,
    block_queries: int = QUERIES,
) -> DataFrame:
    """``query_id rank vec_id score``: the ``k`` largest inner products found for each query, nearest first.

    Queries are the rows whose id is divisible by 20, candidates all others; ties go to the smaller id. Every vector is
    posted; a block's candidates are its ``share`` with the least footrule distance and all that tie with the last of them.
    Vectors that are NULL, zero or have a NULL or non-finite component take no part; an empty table gives no rows. Rows that share an
    id are queries of their own and find each other. Vectors of different lengths are refused.
    """
    rows, width = distinct_rows(usable(vectors, zero=False))
    chosen = pivots(rows, n_pivots)
    posted = min(posted, max(1, len(chosen)))

    def index(ids, block):
        file = Postings(orders(block, chosen, posted), len(chosen))
        wanted = max(LEAST, k, ceil(share * len(ids)))

        def search(query_ids, queries, floors):
            for query_id, query, order in zip(query_ids.tolist(), queries, orders(queries, chosen, posted)):
                gain = file.closeness(order)
                if len(ids) > wanted:
                    some = np.flatnonzero(gain >= np.partition(gain, len(gain) - wanted)[len(gain) - wanted])
                else:
                    some = np.arange(len(ids))
                some = some[some != own_place(ids, block, query_id, query)]
                scores = block.take(some, axis=0) @ query
                best = best_of(ids[some], scores, k)
                yield some[best], scores[best]

        return search

    return nearest_in_blocks(rows, width, index, k, block_rows=block_rows, block_queries=block_queries)
