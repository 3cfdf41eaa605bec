"""How the sources of a language differ in their words: chi-square distances of smoothed shares between all pairs, and the terms that stand out.

K-squared quadtree over the group-term count matrix: groups (a language's sources) are rows, terms columns. The matrix is cut into stripes of
columns and tiles of rows. In each, the places of counts become interleaved codes; the distinct prefixes of these, level by level, are
the quadrants that hold anything. What is zero in both groups of a pair is priced at once from their totals alone, and a count against a zero
by how many of the group's counts are equal. For the rest, the trees of a pair of tiles are traversed jointly: only leaves that both hold
are visited, for all pairs of their groups at once. Everything is integers, so the result does not depend on how the matrix was cut.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered
from .tables import written

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Groups of a tile, and about as many terms of a stripe. A task holds the counts of two tiles in one stripe.
TILE = 128
STRIPE = 4096
#: Side of a quadtree's leaves.
LEAF = 32
#: Different terms of a partition that are counted before the counts are passed on.
HELD = 500_000

#: Letters and bytes of other than ASCII characters stay, capitals become small, all else parts terms.
_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TO_TERMS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang source term n docs``: how often, and in how many documents, a term occurs in each source of a language.

    Partitions add up their own counts first. NULL in any column counts as the empty text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for group, (n, docs_) in held.items():
                columns = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in group]
                columns.append(pa.array(list(n), pa.binary()).cast(pa.string()))
                columns += [pa.array(list(n.values()), pa.int64()), pa.array(list(map(docs_.__getitem__, n)), pa.int64())]
                yield pa.record_batch(columns, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n, docs_ = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                found = terms(text.as_py())
                n.update(found)
                docs_.update(set(found))
                size += len(n)
                if size > HELD:
                    yield from passed_on()
                    held, size = {}, 0
        yield from passed_on()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (n + 1) / whole)`` exactly, by long division in steps of a thousand; ``whole`` is below 9e15."""
    found, rest = np.divmod(n + 1, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        found = found * 1000 + digit
    return found + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q) ** 2 / q)``; shares are of the order of ``SCALE`` at most, so squares stay below 2**63."""
    return (p - q) ** 2 // q


class Quadtree:
    """The quadrants of a sparse matrix that hold anything: at each level, the sorted codes of these.

    A code interleaves the bits of a row and a column (numbers below 2**16), so the quadrant a level higher is the code without its last two
    bits. A quadrant that is not listed is zero throughout. The leaves are squares of ``leaf`` cells a side.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, leaf: int = LEAF):
        self.levels = [np.unique(quadrant(rows // leaf, columns // leaf))]
        while self.levels[-1].max(initial=0) > 0:
            self.levels.append(np.unique(self.levels[-1] >> 2))

    def holds(self, level: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Which quadrants hold anything; ``level`` 0 are the leaves."""
        return np.isin(quadrant(rows, columns), self.levels[min(level, len(self.levels) - 1)])


def _spread(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = (x | (x << shift)) & mask
    return x


def quadrant(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return (_spread(rows) << 1) | _spread(columns)


def joint_leaves(left: Quadtree, right: Quadtree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of left, row of right, column)`` of the leaf blocks in which both have a count.

    Both trees are descended together, a level at a time. Where either quadrant is zero nothing is visited.
    """
    level = max(len(left.levels), len(right.levels)) - 1
    a = b = column = np.zeros(1, np.int64)
    while True:
        both = left.holds(level, a, column) & right.holds(level, b, column)
        a, b, column = a[both], b[both], column[both]
        if level == 0:
            return a, b, column
        level -= 1
        a, b, column = (np.repeat(2 * x, 8) + np.tile(np.arange(8) >> bit & 1, len(x)) for x, bit in ((a, 0), (b, 1), (column, 2)))


class Side:
    """The counts of one tile of groups in one stripe, by blocks of rows and then by columns."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, n: np.ndarray, wholes: np.ndarray, width: int):
        self.width = -(-width // LEAF) * LEAF
        order = np.lexsort((columns, rows // LEAF))
        self.rows, self.columns, n = rows[order], columns[order], n[order]
        keys = self.rows // LEAF * self.width + self.columns
        self.ends = np.searchsorted(keys, np.arange(-(-len(wholes) // LEAF) * self.width + 1))
        self.tree = Quadtree(self.rows, self.columns)
        self.p, self.zero = shares(n, wholes[self.rows]), shares(np.zeros(1, np.int64), wholes)
        # A group's equal counts are priced alike.
        order = np.lexsort((n, self.rows))
        rows, n = self.rows[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (n[1:] != n[:-1])])) if len(n) else np.zeros(0, np.int64)
        self.some_rows, self.some_p = rows[first], self.p[order][first]
        self.times = np.diff(np.concatenate([first, [len(n)]]))


def met(left: Side, right: Side, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the left and right counts that share a column, by the leaves that both trees hold; about ``most`` at once."""
    a, b, column = joint_leaves(left.tree, right.tree)
    begin, end = (left.ends[a * left.width + (column + k) * LEAF] for k in (0, 1))
    block = np.repeat(np.arange(len(a)), end - begin)
    i = np.arange(len(block)) - np.repeat(np.cumsum(end - begin) - end, end - begin)
    key = b[block] * right.width + left.columns[i]
    first, times = right.ends[key], right.ends[key + 1] - right.ends[key]
    upto = np.cumsum(times)
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + most)))
        part = slice(at, to)
        j = np.arange(times[part].sum()) + np.repeat(first[part] - (upto[part] - times[part] - (upto[at] - times[at])), times[part])
        yield np.repeat(i[part], times[part]), j
        at = to


def _pair_sums(x: Side, y: Side, priced: int, joint: Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
    """Sums of the distances of all groups of ``x`` from all of ``y``.

    ``priced`` terms are added as if neither had any count. To this comes what each count changes if the other group has none, and
    last what two counts of one term change that each alone doesn't.
    """
    zero = distances(x.zero[:, None], y.zero[None, :])
    total = zero * priced
    alone = distances(x.some_p[:, None], y.zero[None, :]) - zero[x.some_rows]
    np.add.at(total, x.some_rows, x.times[:, None] * alone)
    alone = distances(x.zero[None, :], y.some_p[:, None]) - zero.T[y.some_rows]
    np.add.at(total.T, y.some_rows, y.times[:, None] * alone)
    flat = total.reshape(-1)
    for i, j in joint():
        g, h, p, q = x.rows[i], y.rows[j], x.p[i], y.p[j]
        pair = g * len(y.zero) + h
        np.add.at(flat, pair, distances(p, q) - distances(p, y.zero[h]) - distances(x.zero[g], q) + zero.reshape(-1)[pair])
    return total


def _standing_out(side: Side, sources: list[str], q: np.ndarray, names: list[str], top: int) -> Iterator[tuple]:
    """``(source, term, value)`` of the ``top`` terms of each group that are more frequent in it than in the language."""
    alphabet = np.empty(len(names), np.int64)
    alphabet[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    more = np.flatnonzero(side.p > q[side.columns])
    rows, columns = side.rows[more], side.columns[more]
    value = distances(side.p[more], q[columns])
    order = np.lexsort((alphabet[columns], -value, rows))
    rows, columns, value = rows[order], columns[order], value[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    for k in np.flatnonzero(place < top).tolist():
        yield sources[rows[k]], names[columns[k]], int(value[k])


def _priced_block(top: int):
    """Prices one stripe of columns for one pair of tiles: ``part source item value``."""

    def price(key: tuple, table: pa.Table) -> pa.Table:
        stripe, a, b = (k.as_py() for k in key[1:])
        table = table.combine_chunks()
        marks = table.column("term").is_null().to_numpy(zero_copy_only=False)
        at = table.column("_at").to_numpy()
        known = table.filter(pa.array(marks)).sort_by("_at")
        sources, places = known.column("source").to_pylist(), known.column("_at").to_numpy()
        whole = known.column("_whole").to_numpy()
        vocabulary, lang_whole = known.column("_terms")[0].as_py(), known.column("_lang_whole")[0].as_py()
        kinds = {"part": pa.string(), "source": pa.string(), "item": pa.string(), "value": pa.int64()}
        rows: list[tuple] = []
        if vocabulary:
            cells = table.filter(pa.array(~marks))
            coded = cells.column("term").combine_chunks().dictionary_encode()
            coded = coded if isinstance(coded, pa.DictionaryArray) else coded.combine_chunks()
            names, term = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            total = np.zeros(len(names), np.int64)
            total[term] = cells.column("_total").to_numpy()
            # Frequent terms first, so that what a small group lacks lies together.
            order = np.argsort(-total, kind="stable")
            column = np.empty(len(names), np.int64)
            column[order] = np.arange(len(names))
            names, total, term, group, n = [names[i] for i in order], total[order], column[term], at[~marks], cells.column("n").to_numpy()
            sides, owners = [], []
            for tile in [a, b][: 1 + (a != b)]:
                own, mine = np.flatnonzero(places // TILE == tile), group // TILE == tile
                sides.append(Side(group[mine] - tile * TILE, term[mine], n[mine], whole[own], len(names)))
                owners.append([sources[i] for i in own])
            x, y, priced = sides[0], sides[-1], vocabulary if stripe == 0 else 0
            sums = [_pair_sums(x, y, priced, lambda: met(x, y))]
            if a != b:
                sums.append(_pair_sums(y, x, priced, lambda: ((j, i) for i, j in met(x, y))))
            for total_, firsts, others in zip(sums, owners, owners[::-1]):
                for i, source in enumerate(firsts):
                    rows += [("pair", source, o, v) for o, v in zip(others, total_[i].tolist()) if o != source]
            if a == b:
                q = shares(total, np.full(len(total), lang_whole))
                rows += [("term", *r) for r in _standing_out(x, owners[0], q, names, top)]
        elif stripe == 0:
            tiles = [[s for s, p in zip(sources, places) if p // TILE == tile] for tile in (a, b)]
            for firsts, others in [tiles, tiles[::-1]][: 1 + (a != b)]:
                rows += [("pair", s, o, 0) for s in firsts for o in others if s != o]
        columns = list(zip(*rows)) if rows else [()] * 4
        made = {c: pa.array(x, kinds[c]) for c, x in zip(kinds, columns)}
        return pa.table({"lang": pa.array([key[0].as_py()] * len(rows), pa.string()), **made})

    return price


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, stripe: int = STRIPE) -> DataFrame:
    """``lang source part item value rank``: for each source of each language, all its other sources by how far they are from it (part
    ``pair``), and the ``top`` terms that are more frequent in it than in the language (part ``term``), farthest first.

    Terms are runs of letters and other than ASCII characters, in lower case as far as ASCII goes; a language keeps those that occur in
    at least ``least_documents`` of its rows. A group's share of a term is smoothed by one count, in parts of a thousand million; the
    distance of a share p from q is ``floor((p - q) ** 2 / q)``, and that of two sources its sum over all kept terms, 0 if there are none.

    NULL counts as the empty text, as a text, a language and a source. Repeated rows count as often as they occur. Ties go to the smaller
    item in byte order. A source without any kept term is a group like others. Other columns are ignored; an empty table gives no rows.
    Sums that pass 2**63 fail.
    """
    counts = written(term_counts(docs), "counts")
    of_term = Window.partitionBy("lang", "term")
    nth = F.row_number().over(of_term.orderBy("source"))
    cells = counts.select("*", F.sum("docs").over(of_term).alias("_docs"), F.sum("n").over(of_term).alias("_total"), nth.alias("_nth"))
    cells = written(cells.filter(F.col("_docs") >= least_documents).drop("docs", "_docs"), "cells")
    langs = cells.groupBy("lang").agg(F.count_if(F.col("_nth") == 1).alias("_terms"), F.sum("n").alias("_lang_n"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("_n"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["_n", "_terms", "_lang_n"])
    groups = written(numbered(groups.withColumn("_least", -F.col("_n")), "lang", ["_least", "source"], "_at", "groups"), "groups")
    tiles = groups.groupBy("lang").agg(F.max(F.floor(F.col("_at") / TILE)).alias("_last"))
    groups = groups.join(tiles, "lang").select(
        "lang", "source", "_at", "_last", "_terms",
        (F.col("_n") + F.col("_terms")).alias("_whole"), (F.col("_lang_n") + F.col("_terms")).alias("_lang_whole"),
        F.greatest(F.lit(1), F.ceil(F.col("_terms") / stripe)).alias("_stripes"),
    )
    groups = written(groups, "groups")

    # Each group is announced to every stripe; counts go to the stripe of their term.
    zero = F.lit(0).cast("long")
    marks = groups.withColumn("_stripe", F.explode(F.sequence(zero, F.col("_stripes") - 1)))
    nothing = F.lit(None)
    marks = marks.select("*", nothing.cast("string").alias("term"), nothing.cast("long").alias("n"), nothing.cast("long").alias("_total"))
    placed = cells.drop("_nth").join(groups, ["lang", "source"]).withColumn("_stripe", F.pmod(F.xxhash64("term"), F.col("_stripes")))
    rows = marks.unionByName(placed)
    tile = F.floor(F.col("_at") / TILE)
    rows = rows.withColumn("_tile", tile).withColumn("_other", F.explode(F.sequence(zero, F.col("_last"))))
    rows = rows.withColumn("_a", F.least("_tile", "_other")).withColumn("_b", F.greatest("_tile", "_other"))
    kept = ["lang", "_stripe", "_a", "_b", "source", "term", "n", "_total", "_at", "_whole", "_terms", "_lang_whole"]
    priced = rows.select(*kept).groupBy("lang", "_stripe", "_a", "_b")
    priced = written(priced.applyInArrow(_priced_block(top), "lang string, part string, source string, item string, value long"), "priced")

    pairs = priced.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    nearest = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    place = F.row_number().over(nearest).cast("int").alias("rank")
    columns = ["lang", "source", "part", "item", "value"]
    best = priced.filter("part = 'term'").select(*columns, place).filter(F.col("rank") <= top)
    return pairs.select(*columns, place).unionByName(best)


#: What :func:`audit` gives for a table ``documents``: every term of a language priced for every pair of its sources.
AUDIT_SQL = rf"""
with docs as (
  select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents
), words as (
  select i, lang, source, unnest(words) as term from docs
), kept as (
  select lang, term, count(*)::bigint as total from words group by lang, term having count(distinct i) >= {LEAST_DOCUMENTS}
), langs as (
  select lang, count(*) as v, sum(total)::bigint as n from kept group by lang
), counts as (
  select lang, source, term, count(*) as c from words semi join kept using (lang, term) group by lang, source, term
), groups as (
  select g.lang, g.source, coalesce((select sum(c) from counts x where x.lang = g.lang and x.source = g.source), 0)::bigint as n
  from (select distinct lang, source from docs) g
), shares as (
  select g.lang, g.source, k.term, coalesce(c, 0) as c, (1 + ({SCALE}::hugeint * (coalesce(c, 0) + 1)) // (g.n + l.v)) as p,
    (1 + ({SCALE}::hugeint * (k.total + 1)) // (l.n + l.v)) as q
  from groups g join kept k using (lang) join langs l using (lang) left join counts x on x.lang = g.lang and x.source = g.source and x.term = k.term
), pairs as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), valued as (
  select g.lang, g.source, 'pair' as part, h.source as item, coalesce(p.value, 0)::bigint as value
  from groups g join groups h on g.lang = h.lang and g.source <> h.source
    left join pairs p on p.lang = g.lang and p.source = g.source and p.item = h.source
  union all
  select lang, source, 'term', term, (((p - q) * (p - q)) // q)::bigint from shares where c > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from valued
)
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= {TOP_TERMS}
"""
