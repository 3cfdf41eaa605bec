"""Near duplicates among embeddings by cosine, within labels, with an inverted multi-index.

Each half of a unit vector has a codebook of its own; pairs of codewords form a grid of cells, and every vector is posted in one. From its cell
a vector goes on to the cells whose regions lie nearest, in the order of the sum of two distances, one for each half: two sorted lists are
merged by a heap, a cell at a time. It stops where a fitted radius ends: the one within which a target share of vectors at exactly the
threshold, in random directions from a bounded sample, fell. What meets in a cell is verified in double precision.

Each pair of cells is visited from one side only, so a pair of vectors is met and counted once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import smallest_reachable
from .tables import written

THRESHOLD = 0.93
#: Share of pairs at the threshold whose cells have to be visited.
RECALL = 0.999
#: Rows that codebooks and radius are fitted on.
SAMPLE = 8192
#: Classes of a cell aimed at, and the most codewords of a half.
CELL_ROWS = 512
MOST_WORDS = 512
#: Posted rows of a task; fuller cells are cut into blocks, each of which meets the blocks before it.
BLOCK_ROWS = 2048
ROUNDS = 8


def unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled to length one; first by the largest component, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def codebook(sample: np.ndarray, words: int, seed: int = 7) -> np.ndarray:
    """Codewords of some vectors by Lloyd's rounds, from seeds drawn far apart."""
    rng = np.random.default_rng(seed)
    chosen = sample[rng.permutation(len(sample))[:1]]
    nearest = ((sample - chosen) ** 2).sum(1)
    while len(chosen) < min(words, len(sample)) and nearest.max() > 1e-12:
        more = sample[[rng.choice(len(sample), p=nearest / nearest.sum())]]
        chosen = np.concatenate([chosen, more])
        nearest = np.minimum(nearest, ((sample - more) ** 2).sum(1))
    for _ in range(ROUNDS):
        own = squares(sample, chosen).argmin(1)
        sums, sizes = np.zeros_like(chosen), np.bincount(own, minlength=len(chosen))
        np.add.at(sums, own, sample)
        chosen = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], chosen)
    return np.unique(chosen, axis=0)


def squares(vectors: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors from all codewords."""
    return np.maximum((vectors**2).sum(1)[:, None] - 2 * vectors @ words.T + (words**2).sum(1)[None, :], 0)


def region_distances(found: np.ndarray, own: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distance of each vector from the border between its own and each other codeword's region."""
    apart = np.sqrt(np.maximum(squares(words, words), 1e-300))[own]
    beyond = found - found[np.arange(len(found)), own][:, None]
    return (np.maximum(beyond, 0) / (2 * apart)) ** 2


def nearest_cells(first: np.ndarray, second: np.ndarray, radius: float) -> list[tuple[int, int]]:
    """Multi-sequence traversal: pairs of codewords by rising sum of their two distances, up to ``radius``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a], second[b]
    found, queue, met = [], [(float(x[0] + y[0]), 0, 0)], {(0, 0)}
    while queue:
        cost, i, j = heapq.heappop(queue)
        if cost > radius:
            break
        found.append((int(a[i]), int(b[j])))
        for step in ((i + 1, j), (i, j + 1)):
            if step[0] < len(x) and step[1] < len(y) and step not in met:
                met.add(step)
                heapq.heappush(queue, (float(x[step[0]] + y[step[1]]), *step))
    return found


class MultiIndex:
    """Two codebooks and the radius of the traversal."""

    def __init__(self, sample: np.ndarray, words: int, threshold: float, recall: float, seed: int = 7):
        self.cut = sample.shape[1] - sample.shape[1] // 2
        self.books = [codebook(part, words, seed) for part in self.halves(sample)]
        self.radius = self._fitted(sample, threshold, recall, seed) if len(sample) else 0.0

    def halves(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The two halves; vectors of a single component have a second one of zeros."""
        second = vectors[:, self.cut :]
        return [vectors[:, : self.cut], second if second.shape[1] else np.zeros((len(vectors), 1))]

    def measured(self, vectors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half the own codewords, and the distances of all codewords' regions."""
        own, far = [], []
        for part, book in zip(self.halves(vectors), self.books):
            found = squares(part, book)
            own.append(found.argmin(1))
            far.append(region_distances(found, own[-1], book))
        return own, far

    def _fitted(self, sample: np.ndarray, threshold: float, recall: float, seed: int) -> float:
        """The radius within which the cells of vectors at the threshold lie, for a share ``recall`` of them."""
        rng = np.random.default_rng(seed + 1)
        side = rng.normal(size=sample.shape)
        side -= (side * sample).sum(1, keepdims=True) * sample
        length = np.linalg.norm(side, axis=1, keepdims=True)
        moved = threshold * sample + np.sqrt(1 - threshold**2) * side / np.where(length > 0, length, 1)
        _, far = self.measured(sample)
        to, _ = self.measured(moved)
        each = np.arange(len(sample))
        return float(np.quantile(far[0][each, to[0]] + far[1][each, to[1]], recall)) + 1e-9

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Each vector's own cell, and the cells of higher number that it visits."""
        own, far = self.measured(vectors)
        width = len(self.books[1])
        home = own[0] * width + own[1]
        visits = []
        for cell, first, second in zip(home.tolist(), *far):
            visits.append([c for c in (a * width + b for a, b in nearest_cells(first, second, self.radius)) if c > cell])
        return home, visits


def takes_part(vector: str) -> Column:
    """Whether a vector is neither NULL, empty nor zero and has finite components alone."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(vectors: DataFrame) -> DataFrame:
    """All rows with what tells their class: ``_label _vector``, NULL where a row takes no part, and two hashes of these."""
    label = F.col("label").cast("string")
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("_label"), vector.alias("_vector"))
    some = F.col("_label").isNotNull() & takes_part("_vector")
    rows = rows.withColumn("_vector", F.when(some, F.col("_vector")))
    names = [F.when(F.col("_vector").isNotNull(), F.xxhash64(F.lit(i), "_label", "_vector")) for i in (1, 2)]
    return rows.select("*", *[n.alias(f"_name{i}") for i, n in enumerate(names)])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of ``width`` numbers; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    found = np.zeros((len(column), width))
    found[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return found


_VISITS = "_label string, _width int, _cell long, _node long, _size long, _posted boolean, _vector binary"


def _visits(classes: DataFrame, index: MultiIndex, width: int) -> DataFrame:
    """Each class once in its own cell, and once in every cell it visits."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                vectors = unit(_matrix(batch.column(4), width))
                home, visits = index.cells(vectors)
                times = np.array([1 + len(v) for v in visits])
                row = np.repeat(np.arange(len(times)), times)
                cell = np.fromiter((c for h, v in zip(home.tolist(), visits) for c in (h, *v)), np.int64, len(row))
                posted = np.zeros(len(row), bool)
                posted[np.cumsum(times) - times] = True
                packed = pa.array([v.tobytes() for v in vectors], pa.binary())
                columns = [batch.column(c).take(pa.array(row)) for c in range(4)]
                yield pa.record_batch(
                    [columns[0], columns[1], pa.array(cell), columns[2], columns[3], pa.array(posted), packed.take(pa.array(row))],
                    names=[c.split()[0] for c in _VISITS.split(", ")],
                )

    return classes.select("_label", "_width", "_node", "_size", "_vector").mapInArrow(visit, _VISITS)


def _forest(among: np.ndarray, across: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold together what the two masks link: posted with posted rows, visitors (numbered after them) with posted ones."""
    n = len(among)
    free, out = np.ones(n, bool), np.ones(len(across), bool)
    found: list[tuple[int, int]] = []
    for begin in np.flatnonzero(among.any(1) | across.any(0)).tolist():
        if not free[begin]:
            continue
        free[begin], todo = False, [begin]
        while todo:
            node = todo.pop()
            if node < n:
                near, far = np.flatnonzero(among[node] & free), np.flatnonzero(across[:, node] & out)
                out[far] = False
                met = [*near.tolist(), *(far + n).tolist()]
            else:
                near = np.flatnonzero(across[node - n] & free)
                met = near.tolist()
            free[near] = False
            found += [(node, m) for m in met]
            todo += met
    return found


def _verified(threshold: float):
    """The links of one block of a cell: for each class how many rows it links, and links that hold the linked ones together."""

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        posted = table.column("_posted").to_numpy(zero_copy_only=False)
        raw = [v.as_py() for v in table.column("_vector")]
        width = len(raw[0]) // 8
        vectors = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), width)
        node, size = table.column("_node").to_numpy(), table.column("_size").to_numpy()
        p, w = np.flatnonzero(posted), np.flatnonzero(~posted)
        across = np.zeros((len(w), len(p)), bool)
        for at in range(0, len(w), 1024):
            across[at : at + 1024] = vectors[w[at : at + 1024]] @ vectors[p].T >= threshold
        among = np.zeros((len(p), len(p)), bool)
        if key[-1].as_py() == 0:  # posted rows meet each other along with the first part of the visitors alone
            for at in range(0, len(p), 1024):
                among[at : at + 1024] = vectors[p[at : at + 1024]] @ vectors[p].T >= threshold
            np.fill_diagonal(among, False)
            among = np.triu(among) | np.triu(among).T
        linked = np.zeros(len(raw), np.int64)
        linked[p] = among @ size[p] + across.T @ size[w]
        linked[w] = across @ size[p]
        order = np.concatenate([p, w])
        forest = [(node[order[a]], node[order[b]]) for a, b in _forest(among, across)]
        some = np.flatnonzero(linked)
        a = np.concatenate([node[some], np.array([x for x, _ in forest], np.int64)])
        b = pa.array([None] * len(some) + [int(x) for _, x in forest], pa.int64())
        n = np.concatenate([linked[some], np.zeros(len(forest), np.int64)])
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "n": pa.array(n, pa.int64())})

    return verify


def _blocks(visits: DataFrame, block_rows: int) -> DataFrame:
    """The visits dealt into blocks of posted rows and parts of visitors, so that no task holds more than a bounded number of either.

    Posted rows go to every part of their block's visitors, visitors to every block; in a cell of several blocks, posted rows
    are visitors of the later blocks.
    """
    cell = ["_label", "_width", "_cell"]
    rows, own = F.count(F.lit(1)), F.count_if("_posted")
    full = visits.groupBy(*cell).agg(F.ceil(own / block_rows).alias("_blocks"), F.ceil(rows / (4 * block_rows)).alias("_parts"))
    full = full.filter("_blocks > 1 or _parts > 1")
    dealt = visits.join(full, cell, "left").fillna(1, ["_blocks", "_parts"])
    zero, number = F.lit(0).cast("long"), F.xxhash64("_node")
    dealt = dealt.withColumn("_own", F.pmod(number, F.greatest(F.col("_blocks"), F.lit(1))))
    part = F.pmod(F.xxhash64(F.lit("part"), "_node"), F.col("_parts"))
    last = F.greatest(F.col("_blocks"), F.lit(1)) - 1

    def place(block, part_, posted):
        return F.struct(block.alias("_block"), part_.alias("_part"), F.lit(posted).alias("_posted"))

    at_home = F.transform(F.sequence(zero, F.col("_parts") - 1), lambda x: place(F.col("_own"), x, True))
    later = F.filter(F.sequence(zero, last), lambda x: x > F.col("_own"))
    elsewhere = F.transform(later, lambda x: place(x, part, False))
    abroad = F.transform(F.sequence(zero, last), lambda x: place(x, part, False))
    places = F.when(F.col("_posted"), F.concat(at_home, elsewhere)).otherwise(abroad)
    return dealt.select(*cell, "_node", "_size", "_vector", F.inline(places))


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per row: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Rows link if their labels are equal and their cosine reaches ``threshold``; ``n_links`` counts the other rows that a row
    links with, copies of itself included. ``component_id`` is the smallest id reachable, and ``kept`` says whether it is the row's own. Every
    link is verified, so none is wrong; ``recall`` is the share of links at the threshold itself that the fitted radius is to meet, and closer
    ones are met more often. Rows of one label and vector are one class that is looked up once, however often it occurs.

    No part take rows without a label, and NULL, empty or zero vectors or those with a NULL or non-finite component: no links, component of
    their own, kept. Vectors link only with those of their length. A row without an id takes part, but is nobody's smallest; a component
    of such rows alone has no id. Of rows that share an id each is kept or not by that id. An empty table gives no rows.
    """
    rows = written(_rows(vectors), "rows")
    alike = rows.filter("_vector is not null").groupBy("_label", "_vector", "_name0", "_name1")
    classes = alike.agg(F.count(F.lit(1)).alias("_size"), F.min("vec_id").alias("_least"))
    node = F.monotonically_increasing_id().alias("_node")
    classes = written(classes.select("*", F.size("_vector").alias("_width"), node), "classes")
    n, width = classes.agg(F.count(F.lit(1)), F.max("_width")).first()
    if not n:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    sample = classes.orderBy("_name0", "_name1", "_node").limit(SAMPLE).select("_vector").toArrow()
    words = min(MOST_WORDS, max(1, ceil((n / cell_rows) ** 0.5)))
    index = MultiIndex(unit(_matrix(sample.column(0), width)), words, threshold, recall)
    visits = written(_visits(classes, index, width), "visits")
    blocks = _blocks(visits, block_rows).groupBy("_label", "_width", "_cell", "_block", "_part")
    links = written(blocks.applyInArrow(_verified(threshold), "a long, b long, n long"), "links")

    counted = links.filter("b is null").groupBy(F.col("a").alias("_node")).agg(F.sum("n").alias("_linked"))
    roots = smallest_reachable(links.filter("b is not null").select("a", "b"))
    found = classes.select("_node", "_name0", "_name1", "_size", "_least").join(counted, "_node", "left")
    found = found.join(roots.withColumnRenamed("node", "_node"), "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    found = written(found, "components")
    least = found.groupBy("root").agg(F.min("_least").alias("_component"))
    found = found.join(least, "root").select(
        "_name0", "_name1", (F.col("_size") - 1 + F.coalesce("_linked", F.lit(0))).alias("n_links"), "_component"
    )
    told = rows.select("vec_id", "_name0", "_name1").join(found, ["_name0", "_name1"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("_component"))
    told = told.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return told.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
