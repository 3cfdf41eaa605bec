"""Exact top-k search by inner product with pivot-table elimination.

The table holds where each vector stands to many pivots. Its distances to all pivots and to the origin fix a vector's place in the
space that the pivots span, and how far from that space it lies. So the least distance two vectors can have, given all their distances to
the pivots, is known; it is never less than what the triangle inequality tells by any single pivot. It gives an upper bound on the inner
product: that of the places, plus the product of the distances from the space. Vectors are evaluated in the order of that bound until
no bound left can reach the k-th best score.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import QUERIES, ROWS, best_of, distinct_rows, nearest_in_blocks, own_place, usable

#: Pivots for each component of a vector, if their number isn't given.
PIVOT_SHARE = 0.75
SCALE = 64
#: Vectors evaluated between two looks at the bound.
STEP = 128
#: Queries whose bounds are computed at once.
AT_ONCE = 64


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Usable vectors with each component ``x`` as ``floor(scale * x)``; vectors of zeros take part."""
    rows = usable(vectors, zero=True)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")).alias("embedding"))


def pivots(rows: DataFrame, number: int) -> np.ndarray:
    """Vectors with the least hash of their id: a bounded sample. Any pivots give right results."""
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(number).collect()
    return np.unique(np.array([r["embedding"] for r in chosen], np.float64), axis=0)


class Table:
    """The pivot table of one block of rows. ``looked`` counts the vectors evaluated so far."""

    def __init__(self, pivots_: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int):
        self.ids, self.block, self.k, self.looked = ids, block, k, 0
        self.axes = spanned(pivots_)
        self.places, self.apart, self.squares = self.placed(block)

    def placed(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the pivots' space, distances from it and squared lengths. Distances are never rounded below what they are."""
        places, squares = vectors @ self.axes, (vectors**2).sum(1)
        apart = np.sqrt(np.maximum(squares - (places**2).sum(1), 0) + 1e-12 * squares)
        return places, apart, squares

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that each query's inner product with each vector can be, loosened by more than its rounding."""
        places, apart, squares = self.placed(queries)
        slack = 1e-9 * (1 + self.squares.max(initial=0) + squares.max(initial=0))
        return places @ self.places.T + apart[:, None] * self.apart[None, :] + slack

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray):
        for at in range(0, len(query_ids), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            for query_id, query, floor, bound in zip(query_ids[part].tolist(), queries[part], floors[part], self.bounds(queries[part])):
                own = own_place(self.ids, self.block, query_id, query)
                if own >= 0:
                    bound[own] = -np.inf
                yield self.evaluate(query, bound, floor)

    def evaluate(self, query: np.ndarray, bounds: np.ndarray, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best ``k`` that reach ``floor``."""
        order = np.flatnonzero((bounds >= floor) & (bounds > -np.inf))
        order = order[np.argsort(-bounds[order], kind="stable")]
        places, scores = order[:0], np.zeros(0)
        for at in range(0, len(order), STEP):
            if len(scores) == self.k and bounds[order[at]] < scores[-1]:
                break
            some = order[at : at + STEP]
            self.looked += len(some)
            places, scores = np.concatenate([places, some]), np.concatenate([scores, self.block[some] @ query])
            best = best_of(self.ids[places], scores, self.k)
            places, scores = places[best], scores[best]
        return places, scores


def spanned(pivots_: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the pivots."""
    _, sizes, across = np.linalg.svd(pivots_, full_matrices=False)
    return across[sizes > 1e-9 * sizes.max(initial=0)].T


def nearest(
    vectors: DataFrame,
    k: int = 20,
    n_pivots: int | None = None,
    scale: int = SCALE,
    block_rows: int = ROWS,
    block_queries: int = QUERIES,
) -> DataFrame:
    """``query_id rank vec_id score``: for each query the ``k`` highest integer inner products of quantised vectors.

    Queries are the rows whose id is divisible by 20, candidates all others; ties go to the smaller id. Rows that share an id are
    queries of their own and find each other. Vectors that are NULL or have a NULL or non-finite component take no part; an empty
    table gives no rows. Vectors of different lengths are refused. Sums of up to 2**53 are exact.
    """
    rows, width = distinct_rows(quantised(vectors, scale))
    chosen = pivots(rows, n_pivots or ceil(PIVOT_SHARE * width))
    best = nearest_in_blocks(
        rows, width, lambda ids, block: Table(chosen, ids, block, k).search, k, block_rows=block_rows, block_queries=block_queries
    )
    return best.withColumn("score", F.col("score").cast("long"))


#: What :func:`nearest` gives for a table ``embeddings``, whose vectors are of one length.
SEARCH_SQL = f"""
with usable as (
  select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select q.vec_id as query_id, r.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) as bigint) as score
  from usable q join usable r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as nth from scored
)
select query_id, cast(nth as int) as rank, vec_id, score from ranked where nth <= 20
"""
