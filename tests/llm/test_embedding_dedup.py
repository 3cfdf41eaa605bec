"""Near duplicates of embeddings against all pairs: recall at the threshold, hot classes, full cells, odd vectors, clashing columns."""

import numpy as np
import pytest

from hearthlens.llm import embedding_dedup

COLUMNS = "vec_id long, embedding array<float>, label int, node long, a string, n_links int, _size int, root string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], COLUMNS)


def plainly(rows, threshold):
    """Links of each row, and the smallest id of each row's component."""
    def usable(v):
        return v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)

    at = [i for i, (_, v, label) in enumerate(rows) if label is not None and usable(v)]
    links, lead = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for n, i in enumerate(at):
        for j in at[n + 1 :]:
            v, w = (np.array(np.float32(rows[k][1]), float) for k in (i, j))
            if rows[i][2] == rows[j][2] and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                links[i] += 1
                links[j] += 1
                lead[find(i)] = find(j)
    least = {}
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            least[find(i)] = min(least.get(find(i), vec_id), vec_id)
    return sorted(((r[0], links[i], least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)), key=str)


def made(n=250, width=16, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=width)
        rows.append((10 * i + 5, v.tolist(), int(rng.integers(0, 3))))
        for k in range(int(rng.integers(0, 4))):
            w = v + rng.normal(size=width) * rng.choice([0.02, 0.2, 0.35])
            rows.append((10 * i + k, (w * 3).tolist(), rows[-1][2] if k < 2 else 1))
    # A third of all rows are copies of one vector, and many more are near it.
    rows += [(100_000 + i, rows[0][1], rows[0][2]) for i in range(n)]
    rows += [(200_000 + i, (np.array(rows[0][1]) + rng.normal(size=width) * 0.05).tolist(), rows[0][2]) for i in range(n // 2)]
    some = rows[0][1]
    odd = [None, [], [None] * 16, [0.0] * 16, [-0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0], [2.0], some[:8]]
    rows += [(300_000 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(None, some, rows[0][2]), (None, some, None), (300_100, some, None), (5, some, rows[0][2]), (5, None, None), (None, None, 2)]
    rows += [(None, [9.0, 1.0], 7), (None, [9.0, 1.0], 7)]
    return rows


@pytest.mark.parametrize(("cell_rows", "block_rows"), [(64, 2048), (8, 20)])
def test_equals_all_pairs(spark, cell_rows, block_rows):
    rows = made()
    got = embedding_dedup.near_duplicates(frame(spark, rows), cell_rows=cell_rows, block_rows=block_rows).collect()
    want = plainly(rows, 0.93)

    def shown(r):
        # Whether a row without an id is kept goes by its component's id.
        return (*r[:3], r[3] if r[0] is not None else None)

    assert sorted((shown(tuple(r)) for r in got), key=str) == sorted((shown(r) for r in want), key=str)


def test_recall_at_the_threshold_itself(spark):
    rng = np.random.default_rng(9)
    v = embedding_dedup.unit(rng.normal(size=(3000, 64)))
    side = rng.normal(size=v.shape)
    side = embedding_dedup.unit(side - (side * v).sum(1, keepdims=True) * v)
    w = 0.9301 * v + np.sqrt(1 - 0.9301**2) * side
    rows = [(i, x.tolist(), 1) for i, x in enumerate(np.concatenate([v, w]))]
    links = sum(r.n_links for r in embedding_dedup.near_duplicates(frame(spark, rows), cell_rows=16).collect())
    assert 0.98 * 6000 <= links <= 6000


def test_traversal_goes_by_rising_distance():
    rng = np.random.default_rng(2)
    first, second = rng.random(7), rng.random(9)
    sums = sorted((x + y, i, j) for i, x in enumerate(first) for j, y in enumerate(second))
    found = embedding_dedup.nearest_cells(first, second, 0.8)
    assert found == [(i, j) for s, i, j in sums if s <= 0.8]


def test_empty(spark):
    nothing = embedding_dedup.near_duplicates(frame(spark, []))
    assert nothing.count() == 0 and nothing.columns == ["vec_id", "n_links", "component_id", "kept"]
    (only,) = embedding_dedup.near_duplicates(frame(spark, [(4, [0.0], 1)])).collect()
    assert tuple(only) == (4, 0, 4, True)
