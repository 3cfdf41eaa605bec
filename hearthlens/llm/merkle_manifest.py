"""A Merkle manifest of a dataset: a digest of each row, of each language and of the whole, and for each row the proof that it belongs.

Time-forward processing: the nodes of a tree are labelled by level and place, so that each follows its children, and are taken in the order
of their labels. A priority queue ordered by label delivers every digest to the parent, which finds its children's at the head of the queue. A
second sweep takes the labels in reverse and delivers proof suffixes (what stands beside the path from a node to the root) from
parents to children, down to the leaves.

The queue is external: a round of a sweep raises blocks of ``ARITY ** LEVELS`` neighbouring nodes by ``LEVELS`` levels, one task each, with a
heap that never holds more than a block; what a block sends to later ones goes through Spark's sorted shuffle and a written table. A sweep over
n leaves takes log(n) / log(ARITY ** LEVELS) rounds, each over a 4096th of the rows of the one before.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered
from .tables import written

ARITY = 8
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "_tree long, _n long, _at long, digest string"
_SUFFIX = "subroot string, root string, befores array<string>, afters array<string>"


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row: of each field's UTF-8 length, a colon and its value, or ``-`` for NULL, one after the other."""
    parts = []
    for c in columns.values():
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels_above(n: int, arity: int = ARITY) -> int:
    """How often ``n`` nodes have to be gathered until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def rise(first: int, digests: list[str], levels: int, arity: int = ARITY) -> Iterator[tuple[int, int, list[str]]]:
    """``(level, place, digests of its children)`` of all nodes above neighbouring nodes, in the order of their labels.

    ``first`` is the place of the first of the digests. The queue holds messages: the receiver's label, the sender's place, its digest.
    """
    queue = [(1, at // arity, at, d) for at, d in enumerate(digests, first)] if levels else []
    heapq.heapify(queue)
    while queue:
        level, place = queue[0][:2]
        received = []
        while queue and queue[0][:2] == (level, place):
            received.append(heapq.heappop(queue)[3])
        yield level, place, received
        if level < levels:
            heapq.heappush(queue, (level + 1, place // arity, place, _hash("".join(received))))


def fall(nodes: list[tuple[int, int, list[str]]], suffix: tuple, arity: int = ARITY) -> Iterator[tuple[int, str, tuple]]:
    """``(place, digest, suffix)`` of the nodes at the bottom; ``nodes`` as :func:`rise` gives them.

    A suffix is a linked list: what stands before and after a node among its siblings, and its parent's suffix, which siblings share. Labels
    are taken in falling order: the queue delivers a node's suffix from its parent.
    """
    queue = [(-nodes[-1][0], -nodes[-1][1], suffix)]
    for level, place, children in reversed(nodes):
        _, _, own = heapq.heappop(queue)
        for i, digest in enumerate(children):
            beside = ("".join(children[:i]), "".join(children[i + 1 :]), own)
            if level > 1:
                heapq.heappush(queue, (1 - level, -(place * arity + i), beside))
            else:
                yield place * arity + i, digest, beside


def _listed(suffix: tuple | None) -> tuple[list[str], list[str]]:
    befores, afters = [], []
    while suffix:
        before, after, suffix = suffix
        befores.append(before)
        afters.append(after)
    return befores, afters


def _linked(befores: list[str], afters: list[str]) -> tuple | None:
    suffix = None
    for before, after in zip(reversed(befores), reversed(afters)):
        suffix = (before, after, suffix)
    return suffix


def fold(digest: str, befores: list[str], afters: list[str]) -> str:
    """The root that a leaf's digest and its siblings, from the bottom up, lead to."""
    for before, after in zip(befores, afters):
        digest = _hash(before + digest + after)
    return digest


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("_at")


def _height(table: pa.Table, levels: int) -> int:
    """Levels by which a block's tree can still be raised in this round."""
    return min(levels, levels_above(table.column("_n")[0].as_py()))


def _raised(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes ``levels`` levels higher, or the roots of trees that end below."""

    def raise_block(key: tuple, table: pa.Table) -> pa.Table:
        table, tree, n = _in_order(table), key[0].as_py(), table.column("_n")[0].as_py()
        height, digests = _height(table, levels), table.column("digest").to_pylist()
        if height:
            *_, (_, place, children) = rise(table.column("_at")[0].as_py(), digests, height)
            digests = [_hash("".join(children))]
        return pa.table({"_tree": [tree], "_n": [ceil(n / ARITY**height)], "_at": [key[1].as_py()], "digest": digests})

    return _blocked(nodes, levels).groupBy("_tree", "_block").applyInArrow(raise_block, _NODES)


def _blocked(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("_block", F.floor(F.col("_at") / ARITY**levels))


def _sweep_up(nodes: DataFrame, most: int, name: str, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes that each round starts from, and the root of every tree. ``most``: nodes of the largest tree."""
    rounds, ended = [nodes], []
    while True:
        up = written(_raised(rounds[-1], levels), name)
        ended.append(up.filter("_n = 1"))
        most = ceil(most / ARITY**levels)
        if most <= 1:
            break
        rounds.append(up.filter("_n > 1"))
    roots = ended[0]
    for more in ended[1:]:
        roots = roots.unionByName(more)
    return rounds, roots.select("_tree", "digest")


def _suffixes_below(nodes: pa.Table, suffixes: pa.Table, levels: int) -> Iterator[tuple[int, list[str], list[str], dict]]:
    """Row number of each node of a block, what stands beside its path, and the rest of the suffix that the block was sent."""
    if not nodes.num_rows:
        return
    sent = suffixes.to_pylist()[0]
    above = _linked(sent["befores"], sent["afters"])
    first, height = nodes.column("_at")[0].as_py(), _height(nodes, levels)
    digests = nodes.column("digest").to_pylist()
    if not height:
        yield 0, sent["befores"], sent["afters"], sent
        return
    for place, _, suffix in fall(list(rise(first, digests, height)), above):
        befores, afters = _listed(suffix)
        yield place - first, befores, afters, sent


def _lowered(nodes: DataFrame, suffixes: DataFrame, levels: int) -> DataFrame:
    """The suffix of every node, from those (``_tree _block``) of the blocks' upper ends."""

    def lower(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left, rows = _in_order(left), []
        for i, befores, afters, sent in _suffixes_below(left, right, levels):
            rows.append((key[0].as_py(), left.column("_at")[i].as_py(), left.column("digest")[i].as_py(), sent["subroot"], sent["root"], befores, afters))
        columns = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.list_(pa.string())] * 2]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["_tree", "_at", "digest", "subroot", "root", "befores", "afters"])

    by = ("_tree", "_block")
    both = _blocked(nodes, levels).groupBy(*by).cogroup(suffixes.groupBy(*by))
    return both.applyInArrow(lower, f"_tree long, _at long, digest string, {_SUFFIX}")


def _sweep_down(rounds: list[DataFrame], roots: DataFrame, name: str, levels: int) -> DataFrame:
    """The suffixes (``_tree _block``) for the blocks of the lowest round, from those of the roots (``_tree _n``, nodes of the tree)."""
    # The round in which a tree's root comes out of its only block.
    turn = sum((F.col("_n") > ARITY ** (levels * (r + 1))).cast("int") for r in range(len(rounds)))
    ending = roots.withColumn("_turn", turn).withColumn("_block", F.lit(0).cast("long")).drop("_n")
    suffixes = ending.filter(F.col("_turn") == len(rounds) - 1).drop("_turn")
    for r in range(len(rounds) - 1, 0, -1):
        lower = written(_lowered(rounds[r], suffixes, levels), name).withColumnRenamed("_at", "_block").drop("digest")
        suffixes = lower.unionByName(ending.filter(F.col("_turn") == r - 1).drop("_turn"))
    return suffixes


def proofs(
    docs: DataFrame,
    presented: dict[str, Column] | None = None,
    fields: tuple[str, ...] = FIELDS,
    with_siblings: bool = False,
    levels: int = LEVELS,
) -> DataFrame:
    """Per row: ``doc_id``, its ``leaf``, the ``subroot`` of its language and the ``root``, with the proof and its check.

    The leaves of a language ascend by id; each eight neighbours, the last run fewer, become their hash until one node is left. So do the
    languages' subroots, in byte order. ``proof_sha256`` is the hash of the siblings on the way from leaf to root; with ``with_siblings`` these
    are in ``befores`` and ``afters`` too, an entry for each level. ``folded_root`` is where the proof leads from the row as it is
    presented: ``presented`` gives, for some columns, the values to check in place of the stored ones. ``verified`` says whether it is the root.

    NULL is a value of its own in every field, so a NULL text and an empty one differ. NULL ids and languages come first. Rows of one
    language and id are ordered by leaf, and equal rows are leaves beside each other, as often as they occur. Other columns are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    stored = {c: F.col(c) for c in fields}
    shown = stored | (presented or {})
    digests = docs.select(
        F.col("lang").cast("string").alias("lang"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(stored).alias("digest"),
        *([leaf(shown).alias("_shown")] if presented else [F.lit(None).cast("string").alias("_shown")]),
    )
    digests = digests.withColumn("_shown", F.when(F.col("_shown") != F.col("digest"), F.col("_shown")))
    # Many copies of a row differ in their place in this table alone, by which ranges can split them.
    digests = written(digests, "leaves").withColumn("_copy", F.monotonically_increasing_id())
    langs = digests.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0).cast("long"))
    langs = written(numbered(langs, "_all", ["lang"], "_tree", "languages"), "trees")
    n_langs, most = langs.agg(F.count(F.lit(1)), F.max("_n")).first()
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema += ", befores array<string>, afters array<string>" if with_siblings else ""
    if not n_langs:
        return spark.createDataFrame([], schema)
    placed = numbered(digests, "lang", ["doc_id", "digest", "_copy"], "_at", "ordered").withColumnRenamed("lang", "_lang")
    same = F.col("_lang").eqNullSafe(F.col("lang"))
    leaves = written(placed.join(langs.select("lang", "_tree", "_n"), same).select("_tree", "_n", "_at", "digest", "doc_id", "_shown"), "leaves")

    rounds, subroots = _sweep_up(leaves.select("_tree", "_n", "_at", "digest"), most, "nodes", levels)
    tops = subroots.select(F.lit(0).cast("long").alias("_tree"), F.lit(n_langs).cast("long").alias("_n"), F.col("_tree").alias("_at"), "digest")
    tops = written(tops, "subroots")
    top_rounds, root = _sweep_up(tops, n_langs, "top-nodes", levels)
    whole = F.lit(root.first()["digest"])
    nothing = F.array().cast("array<string>")
    begin = spark.range(1).select(
        F.col("id").alias("_tree"), F.lit(n_langs).cast("long").alias("_n"), F.lit("").alias("subroot"), whole.alias("root"),
        nothing.alias("befores"), nothing.alias("afters"),
    )
    under = written(_lowered(tops, _sweep_down(top_rounds, begin, "top-suffixes", levels), levels), "top-suffixes")
    under = under.select(F.col("_at").alias("_tree"), F.col("digest").alias("subroot"), "root", "befores", "afters")
    suffixes = _sweep_down(rounds, under.join(langs.select("_tree", "_n"), "_tree"), "suffixes", levels)

    def settle(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left, rows, befores_, afters_ = _in_order(left), [], [], []
        ids, digests, shown = (left.column(c).to_pylist() for c in ("doc_id", "digest", "_shown"))
        for i, befores, afters, sent in _suffixes_below(left, right, levels):
            proof = _hash("".join(x for pair in zip(befores, afters) for x in pair))
            folded = fold(shown[i] or digests[i], befores, afters)
            rows.append((ids[i], digests[i], sent["subroot"], sent["root"], proof, folded, folded == sent["root"]))
            if with_siblings:
                befores_.append(befores)
                afters_.append(afters)
        columns = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        if with_siblings:
            columns, kinds, names = [*columns, befores_, afters_], [*kinds, *[pa.list_(pa.string())] * 2], [*names, "befores", "afters"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    by = ("_tree", "_block")
    return _blocked(leaves, levels).groupBy(*by).cogroup(suffixes.groupBy(*by)).applyInArrow(settle, schema)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampering_report(docs: DataFrame) -> DataFrame:
    """:func:`proofs` where every row whose id's CRC-32 is divisible by three is presented in lower case. Rows without an id are not."""
    chosen = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    text = F.when(chosen, F.translate(F.col("text").cast("string"), _UPPER, _LOWER)).otherwise(F.col("text"))
    return proofs(docs, presented={"text": text})


#: What :func:`tampering_report` gives for a table ``documents`` whose rows have ids. CRC-32 is worked out bit by bit.
REPORT_SQL = rf"""
with recursive fields as (
  select doc_id, lang, text,
    coalesce(octet_length(encode(cast(doc_id as varchar))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(cast(n_chars as varchar))) || ':' || n_chars, '-') as head,
    list_reduce(list_prepend(4294967295::bigint, list_transform(str_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))) as crc
  from documents
), leaves as (
  select doc_id, coalesce(lang, '') as lang, lang is null as no_lang,
    sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
    case when xor(crc, 4294967295) % 3 = 0
      then sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, '{_UPPER}', '{_LOWER}'), '-'))
      else sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) end as shown
  from fields
), langs as (
  select lang, no_lang, row_number() over (order by not no_lang, encode(lang)) - 1 as tree, count(*) as n from leaves group by lang, no_lang
), placed as (
  select doc_id, leaf, shown, tree, n, row_number() over (partition by tree order by doc_id, leaf) - 1 as place
  from leaves join langs using (lang, no_lang)
), nodes as (
  select tree, 0 as level, place, leaf as digest, n from placed
  union all
  select tree, level + 1, place // {ARITY}, sha256(string_agg(digest, '' order by place)), cast(ceil(max(n) / {float(ARITY)}) as bigint)
  from nodes where n > 1 group by tree, level, place // {ARITY}
), subroots as (
  select tree, level, digest from nodes where n = 1
), tops as (
  select 0 as level, tree as place, digest, count(*) over () as n from subroots
  union all
  select level + 1, place // {ARITY}, sha256(string_agg(digest, '' order by place)), cast(ceil(max(n) / {float(ARITY)}) as bigint)
  from tops where n > 1 group by level, place // {ARITY}
), besides as (
  select a.tree, a.level, a.place, coalesce(string_agg(b.digest, '' order by b.place) filter (b.place < a.place), '') as before,
    coalesce(string_agg(b.digest, '' order by b.place) filter (b.place > a.place), '') as after
  from nodes a join nodes b on a.tree = b.tree and a.level = b.level and a.place // {ARITY} = b.place // {ARITY} where a.n > 1 group by all
  union all
  select -1, a.level, a.place, coalesce(string_agg(b.digest, '' order by b.place) filter (b.place < a.place), ''),
    coalesce(string_agg(b.digest, '' order by b.place) filter (b.place > a.place), '')
  from tops a join tops b on a.level = b.level and a.place // {ARITY} = b.place // {ARITY} where a.n > 1 group by all
), paths as (
  select p.tree, p.place, b.level, b.before, b.after from placed p join besides b on b.tree = p.tree and b.place = p.place // ({ARITY} ** b.level)::bigint
  union all
  select p.tree, p.place, s.level + b.level, b.before, b.after
  from placed p join subroots s using (tree) join besides b on b.tree = -1 and b.place = p.tree // ({ARITY} ** b.level)::bigint
), folded as (
  select tree, place, 0 as level, shown as digest from placed
  union all
  select f.tree, f.place, f.level + 1, sha256(b.before || f.digest || b.after) from folded f join paths b using (tree, place, level)
), ends as (
  select tree, place, max_by(digest, level) as folded_root from folded group by tree, place
), proofs as (
  select tree, place, sha256(string_agg(before || after, '' order by level)) as proof_sha256 from paths group by tree, place
)
select p.doc_id, p.leaf, s.digest as subroot, t.digest as root, coalesce(proof_sha256, sha256('')) as proof_sha256,
  e.folded_root, e.folded_root = t.digest as verified
from placed p join subroots s using (tree) join ends e using (tree, place) left join proofs using (tree, place) cross join (select digest from tops where n = 1) t
"""
