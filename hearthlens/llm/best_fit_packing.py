"""Best-fit packing of tokenised documents into sequences of a fixed length.

Hierarchical residual packing: the pieces are dealt into groups by a hash, each group is packed best-fit on
its own, and its nearly full sequences are final. What is left over, a sequence that still has room, becomes an item
of the next round, in which a few groups are merged and packed again, with less asked of a final sequence.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil
from struct import pack as packed_ints

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

END_OF_TEXT = 2
#: Pieces packed by one task in the first round. Later rounds hold a fraction of that.
GROUP_ROWS = 20_000
FAN_IN = 8
#: Words a worker remembers the ids of; beyond, it starts anew.
REMEMBERED = 1_000_000

#: Splits as the vocabulary's own pattern does, for texts without any other character than these.
_OTHER = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]")
_WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ɏ]+| ?[0-9]+| ?[^\\sA-Za-z0-9À-ɏ]+|\\s+(?!\\S)|\\s+"
)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "_bin long, _fill int, _final boolean, doc_id long, piece int, start long, length long, ids_crc32 long, offset long"


def _byte_letters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte: itself, or the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Text to token ids as little-endian unsigned 32-bit numbers. One per worker, kept between tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # its threads would not survive the worker's forks
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # Strings that are one token of their own wherever a text holds them.
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    # The words are cut out here, so the model alone is asked for those not met before.
    model, letters, known = tokenizer.model, _byte_letters(), {}

    def encode(text: str) -> bytes:
        if _OTHER.search(text) or any(a in text for a in added):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = _WORDS.findall(text)
        if len(known) > REMEMBERED:
            known.clear()
        for word in {w for w in words if w not in known}:
            found = model.tokenize(word.encode().decode("latin-1").translate(letters))
            known[word] = packed_ints(f"<{len(found)}I", *[t.id for t in found])
        return b"".join(map(known.__getitem__, words))

    return encode


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: its token ids and an end token, cut only where they exceed ``capacity``.

    The first piece of a longer document takes the remainder, so all its other pieces are full. NULL and empty texts
    are one end token. Each row gives its own pieces, also if rows or ids repeat; other columns are ignored.
    ``with_ids`` adds the ids as a binary column of little-endian unsigned 32-bit numbers.
    """
    end = np.array([END_OF_TEXT], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                total, start, piece = len(ids) // 4, 0, 0
                stop = (total - 1) % capacity + 1
                while start < total:
                    part = ids[4 * start : 4 * stop]
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(part), *([part] if with_ids else [])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each item, and the fill of each bin. Largest first, each into the fullest bin it fits."""
    order = np.argsort(-sizes, kind="stable")
    bins, places, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, len(fills)
            fills.append(0)
        bins[item], places[item] = chosen, fills[chosen]
        fills[chosen] += size
        by_room[room - size].append(chosen)
        rooms |= 1 << (room - size)
    return bins, places, np.array(fills, np.int64)


def _packer(capacity: int, turn: int, room_left: int):
    """Packs one group; rows of one ``_bin`` stay together as one item."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        items, first, item_of = np.unique(table.column("_bin").to_numpy(), return_index=True, return_inverse=True)
        bins, places, fills = best_fit(table.column("_fill").to_numpy()[first].astype(np.int64), capacity)
        bin_of = bins[item_of]
        named = (turn << 56) | (group << 24) | bin_of
        made = {
            "_bin": named,
            "_fill": fills[bin_of].astype(np.int32),
            "_final": fills[bin_of] >= capacity - room_left,
            "offset": table.column("offset").to_numpy() + places[item_of],
        }
        same = {c: table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        types = {"_bin": pa.int64(), "_fill": pa.int32(), "_final": pa.bool_(), "offset": pa.int64()}
        columns = {c: pa.array(v, types[c]) for c, v in made.items()} | same
        return pa.table({c.split()[0]: columns[c.split()[0]] for c in PACKED.split(", ")})

    return pack


def pack(pieces: DataFrame, capacity: int = 1024, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Places pieces (the columns of :func:`token_pieces`) in sequences: adds ``sequence_id`` and ``offset``.

    Every piece is placed once; sequences have no gaps. Pieces longer than ``capacity`` are refused. A group holds
    about ``group_rows`` pieces at first and, since best fit leaves at most one sequence of a group half empty and a
    final sequence may lack ever more, ever fewer later; so no task grows with the input. An empty table gives none.
    """
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    counted = pieces.agg(F.count(F.lit(1)), F.max("length")).first()
    if (counted[1] or 0) > capacity:
        raise ValueError(f"a piece of {counted[1]} tokens does not fit {capacity}")
    full = pieces.filter(F.col("length") == capacity)
    groups = max(1, ceil(counted[0] / group_rows))
    # Equal rows are dealt apart, as the numbers of the stored rows differ.
    number = F.monotonically_increasing_id()
    todo = pieces.filter(F.col("length") < capacity).select(
        F.pmod(F.xxhash64(number), F.lit(groups)).alias("_group"),
        number.alias("_bin"),
        F.col("length").cast("int").alias("_fill"),
        *pieces.columns,
        F.lit(0).cast("long").alias("offset"),
    )
    done, turn, room_left = [], 0, max(1, capacity // 128)
    while True:
        last = groups == 1
        packed = todo.groupBy("_group").applyInArrow(_packer(capacity, turn, capacity if last else room_left), PACKED)
        packed = written(packed, "packed")
        done.append(packed.filter("_final"))
        if last:
            break
        groups, turn, room_left = ceil(groups / FAN_IN), turn + 1, min(room_left * 8, capacity // 2)
        todo = packed.filter("not _final").withColumn("_group", F.pmod(F.xxhash64("_bin"), F.lit(groups)))
    placed = [
        d.select(*pieces.columns, F.col("_bin").alias("sequence_id"), "offset") for d in done
    ]
    alone = full.select(
        *pieces.columns,
        (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    for part in placed:
        alone = alone.unionByName(part)
    return alone


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024) -> DataFrame:
    """Tokenises, cuts and packs documents; one row per piece."""
    return pack(token_pieces(docs, tokenizer_path, capacity), capacity)
