"""Near-duplicate documents by SimHash fingerprints, found with BK-trees.

Fingerprints go to shards such that any two within the distance meet in at least one shard. Each shard gets a BK-tree:
a child hangs on its parent by their Hamming distance, and a search follows only the edges that the radius allows.
A tree goes to the task that holds its shard's fingerprints, not to the whole cluster, as trees grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import smallest_reachable
from .tables import row_key, whole_row, written

SEED = 42
BITS = 64
#: Members of a shard that one task searches. Larger shards are split again.
SHARD_ROWS = 1000
SHINGLES_AT_ONCE = 65_536
#: Members of shards that a task gets, about.
TASK_ROWS = 4000


def fingerprint(text: str | None, words_each: int = 3) -> int:
    """SimHash of the lower-cased word shingles, repeats included; zero if there is no word."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(words_each, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        some = [joined[a:b] for a, b in zip(starts[at : at + SHINGLES_AT_ONCE], ends[at : at + SHINGLES_AT_ONCE])]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(SEED)), np.uint64, len(some))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """The rows of ``docs`` with the 64 bits of their fingerprint as a long instead of their ``text``."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = np.array([fingerprint(t.as_py(), words_each) for t in texts], np.uint64).view(np.int64)
            same = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            names = [*(f.name for f in kept), "fingerprint"]
            yield pa.record_batch([*same, pa.array(found, pa.int64())], names=names)

    return docs.mapInArrow(compute, StructType([*kept, StructField("fingerprint", LongType())]))


def bk_links(prints: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect all fingerprints within ``radius`` of each other, at most one less than these.

    Each fingerprint is sought in the tree of those before it, and then hung into it.
    """
    leader: dict[int, int] = {}

    def lead(x: int) -> int:
        while leader[x] != x:
            leader[x] = leader[leader[x]]
            x = leader[x]
        return x

    children: dict[int, dict[int, int]] = {}
    links: list[tuple[int, int]] = []
    root = None
    for new in prints:
        if new in children:
            continue
        children[new], leader[new] = {}, new
        if root is None:
            root = new
            continue
        open_nodes = [root]
        while open_nodes:
            node = open_nodes.pop()
            distance = (node ^ new).bit_count()
            if distance <= radius and lead(node) != lead(new):
                leader[lead(node)] = lead(new)
                links.append((node, new))
            for edge, child in children[node].items():
                if distance - radius <= edge <= distance + radius:
                    open_nodes.append(child)
        node = root
        while (edge := (node ^ new).bit_count()) in children[node]:
            node = children[node][edge]
        children[node][edge] = new
    return links


def _masks(level: int, radius: int) -> list[int]:
    """Masks of which fingerprints within ``radius`` agree on at least one.

    The bits are dealt into ``radius + 2`` blocks; of these, at most ``radius`` can differ, so two are equal. Each level
    deals the bits differently.
    """
    order = np.arange(BITS) if level == 0 else np.random.default_rng(level).permutation(BITS)
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(order, radius + 2)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _into_shards(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """``rows`` (_shard, fingerprint) once for each mask of this level, with the shard below the one it was in."""
    keys: list[Column] = [
        F.xxhash64("_shard", F.lit(level), F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(_signed(mask)).cast("long")))
        for i, mask in enumerate(_masks(level, radius))
    ]
    return rows.select(F.explode(F.array(*keys)).alias("_shard"), "fingerprint")


def near_links(distinct: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pairs of distinct fingerprints within ``radius`` that connect all such pairs.

    A shard above ``shard_rows`` is dealt out again by other bits, as often as it takes, so none is left out and
    none outgrows a task.
    """

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        prints = np.sort(rows["fingerprint"].to_numpy(np.int64)).view(np.uint64).tolist()
        links = np.array(bk_links(prints, radius), np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    found, level = None, 0
    rows = distinct.select(F.lit(0).cast("long").alias("_shard"), "fingerprint")
    while True:
        shards = _into_shards(rows, level, radius)
        sizes = shards.groupBy("_shard").agg(F.count(F.lit(1)).alias("_members")).filter("_members > 1")
        shared = written(shards.join(sizes, "_shard"), "shards")
        small = shared.filter(F.col("_members") <= shard_rows).select("_shard", "fingerprint")
        # Few bytes may be much work, which a number of tasks by bytes would not see.
        dealt = small.repartition(max(1, ceil(small.count() / TASK_ROWS)), "_shard")
        links = dealt.groupBy("_shard").applyInPandas(search, "a long, b long").distinct()
        found = links if found is None else found.unionByName(links)
        rows = shared.filter(F.col("_members") > shard_rows).select("_shard", "fingerprint")
        if rows.isEmpty():
            return found
        level += 1


def _components(distinct: DataFrame, radius: int) -> DataFrame:
    """``fingerprint`` and ``_root``, the smallest fingerprint it is linked to, for each distinct fingerprint."""
    roots = smallest_reachable(near_links(distinct.select("fingerprint"), radius))
    found = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left")
    return found.select("fingerprint", F.coalesce("root", "fingerprint").alias("_root"))


def near_duplicates(docs: DataFrame, words_each: int = 3, radius: int = 3) -> DataFrame:
    """Each row's ``doc_id``, ``fingerprint`` (hex) and ``component_id``, the smallest doc_id reachable over links.

    NULL and empty texts have fingerprint zero and link like others. Rows of one id count each by its own text; a NULL
    id is a component's id only where it has no other. Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = written(fingerprints(texts, words_each), "fingerprints")
    distinct = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("_first")), "distinct")
    named = written(distinct.join(_components(distinct, radius), "fingerprint"), "components")
    firsts = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    ids = written(named.join(firsts, "_root").select("fingerprint", "component_id"), "ids")
    shown = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return prints.join(ids, "fingerprint").select("doc_id", shown.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words_each: int = 3, radius: int = 3) -> DataFrame:
    """The documents that stay: one of each component, with the columns they had.

    The one with the smallest id stays (NULL counts as the smallest), then the one with the smallest hash of its text
    and of the whole row; of rows equal in all columns, one. NULL texts count as empty.
    """
    keys = ["_id", "_text", "_row"]
    keyed = docs.select(*row_key(), F.xxhash64(whole_row(docs)).alias("_row"), whole_row(docs).alias("_doc"))
    texts = keyed.select(*keys, F.col("_doc.text").cast("string").alias("text"))
    prints = written(fingerprints(texts, words_each), "fingerprints")
    distinct = written(prints.select("fingerprint").distinct(), "distinct")
    roots = written(_components(distinct, radius), "components")
    best = prints.join(roots, "fingerprint").groupBy("_root").agg(F.min(F.struct(*keys)).alias("_best"))
    stay = written(best.select("_best.*"), "stay")
    kept = keyed.join(stay, keys, "left_semi")
    copies = prints.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    if not copies.isEmpty():
        kept = kept.dropDuplicates(keys)
    return kept.select("_doc.*")
