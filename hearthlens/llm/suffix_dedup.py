"""Removal of repeated passages: byte strings of a given length that also start earlier in the corpus.

Prefix doubling on sampled places. In every string of the length looked for, one place is sampled: the one whose k bytes hash lowest,
which depends on the string alone, so equal strings sample the same place. The sampled places are ranked by the hash of their k bytes, in packets
that Spark deals out by rank, and those of a rank of their own dropped. Places that agree in everything that strings sampled there reach repeat as a whole, but for the first
of them. The first places that share no more than a rank go through rounds: blocks of k bytes beside the place are ranked in pairs, the
pairs in pairs at a greater offset, as long as strings of the length looked for must hold one, and Spark drops pairs that occur once. In
the last round the strings whose pairs all remain are ranked at their full length. Ranks are 64-bit hashes, and strings count as equal
if their ranks are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import id_of, in_slices, release, row_key, written

LENGTH = 100
GRAM = 24
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_OTHER = 0xC2B2AE3D27D4EB4D
_HIGH = np.uint64(0xFFFFFFFF00000000)
#: Bytes of short texts that are worked on at once: enough to make little of the cost of each call, few enough to stay in a core's cache.
JOINED = 1 << 14
#: Places that a task gathers before it deals them out, and that a part gets about; equal ones from which a task sends on the first only.
GATHERED, DEALT, MANY = 1 << 18, 1 << 19, 8
#: Of so many documents one is looked at for ranks that are heavy.
LOOK = 16
#: A place and a span as they are packed.
_PLACE = {"rank": "<u8", "reach": "<u8", "_id": "<i8", "_tie": "<i8", "first": "<i4", "last": "<i4", "at": "<i4", "known": "u1"}
_SPAN = {"_id": "<i8", "_tie": "<i8", "start": "<i4", "end": "<i4"}


def names(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit name of the ``size`` bytes from every place on, by doubling: a name of 2n bytes is made of two of n."""
    with np.errstate(over="ignore"):
        level = {1: (data.astype(np.uint64) + np.uint64(1)) * _MIX}
        power, have, n = {1: _BASE}, level[1], 1
        while 2 * n <= size:
            longer = have[: len(have) - n] * power[n]
            longer += have[n:]
            have = longer
            power[2 * n], n = power[n] * power[n], 2 * n
            if size & n:  # made use of below
                level[n] = have
        while n < size:
            part = 1 << ((size - n).bit_length() - 1)
            count = max(0, len(data) - n - part + 1)
            have = have[:count] * power[part]
            have += level[part][n : n + count]
            n += part
        return _mixed(have)


def _mixed(have: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        have = (have ^ (have >> np.uint64(33))) * _MIX
        have ^= have >> np.uint64(29)
        return have


def sampled(data: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Sampled places of texts that stand one after the other, with the names of their ``gram`` bytes, the first and last string that
    samples each, and the number of the text.

    A string samples its place with the least name (upper half), the first of equal ones. Strings across a border of texts don't count.
    """
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    name = names(data, gram)
    least = (name & _HIGH) | np.arange(len(name), dtype=np.uint64)
    width, n = length - gram + 1, 1
    while 2 * n <= width:
        least, n = np.minimum(least[: len(least) - n], least[n:]), 2 * n
    if n < width:
        least = np.minimum(least[: len(least) - (width - n)], least[width - n :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    stop = begin + np.maximum(0, sizes - length + 1)  # behind the text's last string
    turn = np.ones(len(place) + 1, bool)
    np.not_equal(place[1:], place[:-1], out=turn[1:-1])
    turn[begin[begin < len(place)]] = True
    turn[stop[stop < len(place)]] = True
    turns = np.flatnonzero(turn)
    first, last = turns[:-1], turns[1:] - 1
    text = np.searchsorted(begin, first, "right") - 1
    inside = first < stop[text]
    first, last, text = first[inside], last[inside], text[inside]
    return place[first], name[place[first]], first, last, text


def _powers(base: int, count: int) -> np.ndarray:
    """The powers of ``base`` from 0 on."""
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(count - 1, base, np.uint64)]))


def reached(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of the bytes from each ``start`` to its ``end`` with ``at``: the difference of two running sums, as if it stood at 0."""
    known = _POWERS if len(data) <= JOINED else [_powers(int(p[1]), len(data) + 1) for p in _POWERS]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * known[0][: len(data)], out=sums[1:])
        name = _mixed((sums[end] - sums[start]) * known[1][start])
        return _mixed(name + (end - start).astype(np.uint64) * _BASE + at.astype(np.uint64))


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts, and the border before each text and behind the last."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    border = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data if data is not None else b"", np.uint8)[border[0] : border[-1]], border - border[0]


def _joined(border: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring texts to work on at once: the first, and the one behind the last. Beyond ``JOINED`` bytes a text stands alone."""
    begin, count = 0, len(border) - 1
    while begin < count:
        stop = max(begin + 1, int(np.searchsorted(border, border[begin] + JOINED, "left")) - 1)
        yield begin, stop
        begin = stop


#: Powers of a base and of its inverse, so far as joined texts need them.
_POWERS = [_powers(b, JOINED + 1) for b in (_OTHER, pow(_OTHER, -1, 2**64))]


def _texts(docs: DataFrame) -> DataFrame:
    """``_id _tie text`` of the documents. ``_tie`` tells documents of one id apart and is zero if no two share one."""
    keyed = docs.select(*row_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = keyed.select("_id", "_text").groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tie = F.lit(0).cast("long") if shared.isEmpty() else F.col("_text")
    return keyed.select("_id", tie.alias("_tie"), "text")


def _packed(texts: DataFrame) -> DataFrame:
    """``_id _tie packed``: the texts' bytes, compressed better than a shuffle would, for joins that move them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in in_slices(batches):
            data, border = _raw(batch.column(2))
            packed = [compress(data[a:b]) for a, b in zip(border[:-1].tolist(), border[1:].tolist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["_id", "_tie", "packed"])

    return texts.select("_id", "_tie", "text").mapInArrow(pack, "_id long, _tie long, packed binary")


def _sampled(batch: pa.RecordBatch, length: int, gram: int) -> dict[str, np.ndarray]:
    """The places of a batch ``_id _tie text``: the number of the row, ``rank``, ``reach``, the name of all bytes that strings sampled there
    reach, the ``first`` and ``last`` of these strings, and ``at``, the place's distance from the first."""
    data, border = _raw(batch.column(2))
    parts = []
    for a, b in _joined(border):
        some, begin = data[border[a] : border[b]], border[a:b] - border[a]
        at, rank, first, last, text = sampled(some, np.diff(border[a : b + 1]), length, gram)
        reach = reached(some, first, last + length, at - first)
        parts.append((text + a, rank, reach, first - begin[text], last - begin[text], at - first))
    return dict(zip(("row", "rank", "reach", "first", "last", "at"), (np.concatenate(c) for c in zip(*parts))))


def _heavy(texts: DataFrame, length: int, gram: int) -> tuple[int, np.ndarray]:
    """For dealing out places: into how many parts, and the ranks that would fill much of one, by a sample of the documents.

    Both only say which task does what; no result depends on them.
    """

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            yield pa.record_batch([pa.array(_sampled(batch, length, gram)["rank"].view(np.int64))], names=["rank"])

    some = texts.filter(F.pmod(F.xxhash64("_id", "_tie"), F.lit(LOOK)) == 0)
    counts = some.mapInArrow(ranks, "rank long").groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "look")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), LOOK * total // DEALT)
    # At most four ranks for each part.
    heavy = [r.rank for r in counts.filter(F.col("n") > max(8, total // (4 * parts))).collect()]
    release(counts)
    return parts, np.sort(np.array(heavy, np.int64).view(np.uint64))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted ``known`` ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _firsts(places: dict[str, np.ndarray], some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of ``some`` places by rank and reach; which is the first of the documents' places of its pair; which stands later than that."""
    some = some[np.lexsort([places[c][some] for c in ("first", "_tie", "_id", "reach", "rank")])]
    own = {c: places[c][some] for c in places}
    head = np.ones(len(some), bool)
    head[1:] = (own["rank"][1:] != own["rank"][:-1]) | (own["reach"][1:] != own["reach"][:-1])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(some)), 0))
    # Copies of one document have places of one name, none of which is later than another.
    later = np.logical_or.reduce([own[c] != own[c][lead] for c in ("_id", "_tie", "first")])
    return some, head, later


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of a sorted array how often it occurs, and whether it is the first of its kind."""
    head = np.ones(len(ordered), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    count = np.diff(np.concatenate([np.flatnonzero(head), [len(ordered)]]))
    return np.repeat(count, count), head


def _dealt(gathered: dict[str, np.ndarray], parts: int, heavy: np.ndarray) -> pa.RecordBatch:
    """Places packed for the parts that they go to: by rank, or by rank and reach if that is heavy.

    Of places that are many here and agree in rank and reach, only the first goes there; the later ones are spread, ``known`` to be later.
    """
    order = np.argsort(gathered["reach"])
    many = order[_runs(gathered["reach"][order])[0] >= MANY]
    known, stays = np.zeros(len(order), np.uint8), np.ones(len(order), bool)
    if len(many):
        many, head, later = _firsts(gathered, many)
        known[many[later]] = 1
        stays[many[~head & ~later]] = False
    places = {c: v[stays] for c, v in gathered.items()} | {"known": known[stays]}
    known = places["known"] > 0
    with np.errstate(over="ignore"):
        key = places["rank"] + _among(places["rank"], heavy) * places["reach"] * _BASE
        key[known] = places["_id"][known].view(np.uint64) * _BASE + places["first"][known].astype(np.uint64)
    for c in ("rank", "reach"):
        places[c] = np.where(known, np.uint64(0), places[c])
    return _packets(places, _PLACE, key, parts)


def _packets(rows: dict[str, np.ndarray], kinds: dict[str, str], key: np.ndarray, parts: int) -> pa.RecordBatch:
    """``part packet``: the columns of the rows for each part that a ``key`` belongs to."""
    part = (_mixed(key) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [rows[c][order].astype(k) for c, k in kinds.items()]
    begin = np.flatnonzero(_runs(part)[1])
    packed = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(begin, [*begin[1:], len(part)])]
    return pa.record_batch([pa.array(part[begin].astype(np.int32)), pa.array(packed, pa.binary())], names=["part", "packet"])


def _unpacked(packets: list[bytes], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """The rows of all of :func:`_packets`."""
    width, columns = sum(np.dtype(k).itemsize for k in kinds.values()), {c: [np.zeros(0, k)] for c, k in kinds.items()}
    for p in packets:
        count, at = len(p) // width, 0
        for c, k in kinds.items():
            columns[c].append(np.frombuffer(p, k, count, at))
            at += columns[c][-1].nbytes
    return {c: np.concatenate(v) for c, v in columns.items()}


def _span_packets(rows: dict[str, np.ndarray], parts: int) -> pa.RecordBatch:
    """Packets of ``_id _tie start end`` for the parts that the documents belong to."""
    with np.errstate(over="ignore"):
        return _packets(rows, _SPAN, rows["_id"].view(np.uint64) * _BASE + rows["_tie"].view(np.uint64), parts)


def _merged(spans: dict[str, np.ndarray]) -> pa.RecordBatch:
    """``_id _tie spans``: what the spans of each document cover, in order, without overlaps."""
    order = np.lexsort([spans[c] for c in ("start", "_tie", "_id")])
    own = {c: v[order] for c, v in spans.items()}
    new = np.ones(len(order), bool)
    new[1:] = (own["_id"][1:] != own["_id"][:-1]) | (own["_tie"][1:] != own["_tie"][:-1])
    above = (np.cumsum(new) - 1) << 32  # any document stands beyond all of the one before
    start, end = own["start"] + above, np.maximum.accumulate(own["end"] + above)
    head = new.copy()
    head[1:] |= start[1:] > end[:-1]
    heads = np.flatnonzero(head)
    until = end[np.append(heads[1:], len(order)) - 1] if len(order) else end
    covered = [pa.array((x & 0xFFFFFFFF).astype(np.int32)) for x in (start[heads], until)]
    first = np.flatnonzero(new)
    offsets = pa.array(np.append(np.searchsorted(heads, first), len(heads)).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(covered, ["start", "end"]))
    return pa.record_batch([pa.array(own["_id"][first]), pa.array(own["_tie"][first]), lists], names=["_id", "_tie", "spans"])


def _settled(places: dict[str, np.ndarray], heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the places that repeat as a whole, and of first places whose rank other first places have, too (or that is heavy)."""
    known = places["known"] > 0
    order = np.flatnonzero(~known)
    order = order[np.argsort(places["rank"][order])]
    rank = places["rank"][order]
    order, head, later = _firsts(places, order[(_runs(rank)[0] > 1) | _among(rank, heavy)])
    firsts = order[head]
    rank = places["rank"][firsts]
    return np.concatenate([np.flatnonzero(known), order[later]]), firsts[(_runs(rank)[0] > 1) | _among(rank, heavy)]


def _shared(rows: DataFrame, rank: str) -> DataFrame:
    """The ranks that more than one row has."""
    return rows.groupBy(rank).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(rank)


def _hashed(unique: DataFrame) -> DataFrame:
    """For the side of a join whose keys are unique and spread evenly: hashed in memory, so that the other side need not be sorted."""
    return unique.hint("shuffle_hash")


def _ranked(texts: DataFrame, length: int, gram: int, dealing: tuple[int, np.ndarray] | None = None) -> tuple[DataFrame, DataFrame]:
    """Packets of ``_id _tie start end`` of places that repeat as a whole, and first places that share no more than their rank, both written.

    Places move once, packed, to the task that ranks them. The first place of a pair of ranks is its name. A rank that is heavy is dealt
    out by its pairs, and of a pair that is heavy each task sends on one place, so a passage of many documents gathers nowhere. First
    places have a ``place``, a number in the order of ``_id _tie first``. ``dealing``: as of :func:`_heavy`, if known.
    """
    parts, heavy = dealing or _heavy(texts, length, gram)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, count = [], 0
        for batch in in_slices(batches):
            places = _sampled(batch, length, gram)
            row = places.pop("row")
            places |= {c: batch.column(i).to_numpy()[row] for i, c in enumerate(("_id", "_tie"))}
            gathered.append(places)
            count += len(row)
            if count >= GATHERED:
                yield _dealt({c: np.concatenate([g[c] for g in gathered]) for c in places}, parts, heavy)
                gathered, count = [], 0
        if count:
            yield _dealt({c: np.concatenate([g[c] for g in gathered]) for c in gathered[0]}, parts, heavy)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _unpacked([p.as_py() for batch in batches for p in batch.column(0)], _PLACE)
        whole, sharing = _settled(places, heavy)
        rows = {c: places[c][whole] for c in ("_id", "_tie")}
        spans = _span_packets(rows | {"start": places["first"][whole], "end": places["last"][whole] + length}, parts)
        firsts = [pa.array(places[c][sharing]) for c in own]
        none = [pa.nulls(len(spans), a.type) for a in firsts]
        yield pa.record_batch([*spans.columns, *none], names=["part", "packet", *own])
        none = [pa.nulls(len(sharing), a.type) for a in spans.columns]
        yield pa.record_batch([*none, *firsts], names=["part", "packet", *own])

    own = ["_id", "_tie", "first", "last", "at"]
    packed = texts.select("_id", "_tie", "text").mapInArrow(deal, "part int, packet binary").repartitionById(parts, "part")
    schema = "part int, packet binary, _id long, _tie long, first int, last int, at int"
    settled = written(packed.select("packet").mapInArrow(settle, schema), "settled")
    # Sorted from a written table, as a sort reads its rows twice. The numbers are fixed by being written.
    sharing = settled.filter("part is null").select(*own).orderBy("_id", "_tie", "first")
    sharing = written(sharing.withColumn("place", F.monotonically_increasing_id()), "sharing")
    return settled.filter("part is not null").select("part", "packet"), sharing


def _windows(length: int, gram: int) -> tuple[int, int]:
    """Blocks in the longest window of the rounds, and the number of blocks that a window may start before the place.

    Such windows begin a whole number of blocks before the place. They are short enough for every string to hold one.
    """
    return max(1, (length - gram + 1) // gram), (length - gram) // gram


def _stretches(texts: DataFrame, firsts: DataFrame, length: int, gram: int) -> DataFrame:
    """``place at bytes blocks``: what the strings of each place reach, and the names of its blocks.

    ``blocks`` starts with the block that lies furthest before the place; blocks out of reach are NULL.
    """
    blocks, before = _windows(length, gram)
    each = firsts.groupBy("_id", "_tie").agg(F.collect_list(F.struct("place", "first", "last", "at")).alias("places"))
    some = _packed(texts).join(each, ["_id", "_tie"])
    offsets = np.arange(-before, blocks) * gram

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            places = batch.column(1)
            place, first, last, at = (c.to_numpy() for c in places.flatten().flatten())
            end = last + length
            upto = np.cumsum([0, *places.value_lengths().to_pylist()])
            parts = []
            for i, packed in enumerate(batch.column(0)):
                raw = zstandard.decompress(packed.as_py())
                own = slice(upto[i], upto[i + 1])
                parts += [raw[a:b] for a, b in zip(first[own].tolist(), end[own].tolist())]
            # So many at once that their names stay in a core's cache.
            for k in range(0, len(parts), 128):
                some = slice(k, k + 128)
                name = names(np.frombuffer(b"".join(parts[some]), np.uint8), gram)
                size = (end - first)[some].astype(np.int64)[:, None]
                start = at[some].astype(np.int64)[:, None] + offsets
                inside = (start >= 0) & (start + gram <= size)
                start = np.where(inside, start + np.cumsum(size)[:, None] - size, 0)
                block = pa.array(name[start].view(np.int64).ravel(), mask=~inside.ravel())
                ends = pa.array(np.arange(0, inside.size + 1, len(offsets)), pa.int32())
                arrays = [pa.array(place[some]), pa.array(at[some]), pa.array(parts[some], pa.binary())]
                yield pa.record_batch([*arrays, pa.ListArray.from_arrays(ends, block)], names=["place", "at", "bytes", "blocks"])

    rows = some.select("packed", "places").mapInArrow(cut, "place long, at int, bytes binary, blocks array<long>")
    return written(rows, "stretches")


def _rounds(stretches: DataFrame, length: int, gram: int) -> DataFrame:
    """``place ranks``: of each place the ranks of windows that occur more than once, by the block that they start with, NULL for others.

    Each round ranks pairs of what the round before left: windows of n blocks, and those that start as many blocks on as make
    the window twice as long, or as long as the longest. A window whose part is gone occurs once, too.
    """
    blocks, before = _windows(length, gram)
    left, size, before_this = stretches.select("place", F.col("blocks").alias("ranks")), 1, None
    while True:
        step = min(size, blocks - size)
        pairs = F.transform(
            F.sequence(F.lit(0), F.lit(before + blocks - 1 - step)),
            lambda j: F.when(
                F.get("ranks", j).isNotNull() & F.get("ranks", j + step).isNotNull(),
                F.xxhash64(F.get("ranks", j), F.get("ranks", j + step)),
            ),
        )
        size += step
        pairs = left.select("place", F.posexplode(pairs).alias("window", "rank")).filter("rank is not null")
        # Counted and written first: the join has an exchange of its own, which adaptive execution can split.
        shared = written(_shared(pairs, "rank"), "shared-pairs")
        kept = pairs.join(_hashed(shared), "rank").groupBy("place")
        ranks = [F.max(F.when(F.col("window") == j, F.col("rank"))) for j in range(before + blocks)]
        kept = written(kept.agg(F.array(*ranks).alias("ranks")), "kept")
        release(shared, *([before_this] if before_this else []))
        if size == blocks:
            return kept
        left = before_this = kept


def _full_length(texts: DataFrame, firsts: DataFrame, length: int, gram: int, parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """Packets of ``_id _tie start end`` of what strings cover that have an earlier equal one among the strings of the same rank.

    Also the written tables that it is made of. A string's number is its place's, with the string's own in the last ``bits``: numbers
    are in the order of ``_id _tie start``, so they alone are moved and compared.
    """
    blocks, before = _windows(length, gram)
    bits, words = (length - gram).bit_length(), (length - gram) // 64 + 1
    stretches = _stretches(texts, firsts, length, gram)
    windows = _rounds(stretches, length, gram)
    left = written(stretches.join(_hashed(windows), "place").select("place", "at", "bytes", "ranks"), "left")
    release(stretches, windows)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 128):
            raw = [b.as_py() for b in batch.column("bytes")]
            sizes = np.array([len(b) for b in raw], np.int64)
            count = sizes - length + 1
            row = np.repeat(np.arange(len(raw)), count)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            remains = batch.column("ranks").flatten().is_valid().to_numpy(zero_copy_only=False).reshape(len(raw), before + blocks)
            offset = batch.column("at").to_numpy().astype(np.int64)[row] - inside
            alike = np.ones(len(row), bool)
            for window in range(before + 1):
                ahead = (before - window) * gram
                holds = (offset >= ahead) & (offset <= ahead + length - blocks * gram)
                alike &= ~holds | remains[row, window]
            row, inside = row[alike], inside[alike]
            name = names(np.frombuffer(b"".join(raw), np.uint8), length)
            number = (batch.column("place").to_numpy()[row] << bits) | inside
            rank = name[(np.cumsum(sizes) - sizes)[row] + inside].view(np.int64)
            yield pa.record_batch([pa.array(number), pa.array(rank)], names=["number", "name"])

    # Made twice of what is left, which is smaller.
    strings = left.mapInArrow(spread, "number long, name long")
    first = strings.groupBy("name").agg(F.min("number").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    first = written(first.drop("_n"), "first-strings")
    later = strings.join(_hashed(first), "name").filter("number != _first")
    inside = F.col("number").bitwiseAND(F.lit((1 << bits) - 1))
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), inside.bitwiseAND(F.lit(63)).cast("int"))
    flags = [F.bit_or(F.when(F.shiftright(inside, 6) == w, flag)) for w in range(words)]
    flags = [F.coalesce(f, F.lit(0).cast("long")).alias(f"flags{w}") for w, f in enumerate(flags)]
    gone = later.groupBy(F.shiftright("number", bits).alias("place")).agg(*flags)
    gone = firsts.select("place", "_id", "_tie", "first").join(_hashed(gone), "place")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1 << 16):
            word = np.stack([batch.column(3 + w).to_numpy() for w in range(words)], axis=1)
            flagged = np.unpackbits(word.astype("<i8").view(np.uint8), axis=1, bitorder="little")
            turn = np.diff(np.pad(flagged, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, start = np.nonzero(turn == 1)
            end = np.nonzero(turn == -1)[1] - 1 + length
            first = batch.column(2).to_numpy()[row]
            spans = {c: batch.column(i).to_numpy()[row] for i, c in enumerate(("_id", "_tie"))}
            yield _span_packets(spans | {"start": first + start, "end": first + end}, parts)

    columns = ["_id", "_tie", "first", *[f"flags{w}" for w in range(words)]]
    return gone.select(*columns).mapInArrow(runs, "part int, packet binary"), [left, first]


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``_id _tie spans``: the byte ranges to remove (start, end), in order, of documents that have any."""
    parts, heavy = _heavy(texts, length, gram)
    whole, firsts = _ranked(texts, length, gram, (parts, heavy))
    rest, used = _full_length(texts, firsts, length, gram, parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _merged(_unpacked([p.as_py() for batch in batches for p in batch.column(0)], _SPAN))

    spans = whole.unionByName(rest).repartitionById(parts, "part").select("packet")
    spans = written(spans.mapInArrow(merge, "_id long, _tie long, spans array<struct<start:int,end:int>>"), "spans")
    release(whole, firsts, *used)
    return spans


def _apply(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal removed runs."""
    if not len(start):
        return raw, 0
    gone = np.zeros(len(raw) + 1, np.int32)
    np.add.at(gone, start, 1)
    np.add.at(gone, end, -1)
    removed = np.cumsum(gone)[:-1] > 0
    runs = int(removed[0]) + int((removed[1:] & ~removed[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~removed].tobytes(), runs


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the remaining bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier, in a document of smaller id (NULL is smallest; of
    equal ids, smaller hash of the text) or earlier in the same one. NULL texts count as empty; texts shorter than ``length`` stay.
    Rows that agree in id and text are one document. Bytes may be left that are no UTF-8 text, as removal doesn't mind characters.
    Other columns are ignored; an empty table gives no rows. Texts are below 2 GB.
    """
    texts = _texts(docs)
    spans = repeated_spans(texts, length, gram)
    joined = _packed(texts).join(spans, ["_id", "_tie"], "left").select("_id", "packed", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = []
            spans = batch.column(2)
            start, end = (c.to_numpy() for c in spans.flatten().flatten())
            upto = np.cumsum([0, *spans.value_lengths().fill_null(0).to_pylist()])
            for i, packed in enumerate(batch.column(1)):
                raw = zstandard.decompress(packed.as_py())
                own = slice(upto[i], upto[i + 1])
                kept, runs = _apply(raw, start[own], end[own])
                rows.append((len(raw), len(raw) - len(kept), runs, kept))
            columns = list(zip(*rows)) if rows else [()] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.record_batch([batch.column(0), *arrays], names=["_id", "n_bytes", "n_removed", "n_spans", "kept"])

    done = joined.mapInArrow(remove, "_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(id_of(F.col("_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def removal_report(docs: DataFrame, **options) -> DataFrame:
    """:func:`deduplicated` with the SHA-256 of the remaining bytes instead of these."""
    done = deduplicated(docs, **options)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
