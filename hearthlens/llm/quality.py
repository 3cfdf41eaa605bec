"""Quality of documents by supervised subword embeddings.

Words and character n-grams are hashed into buckets, each with a learned vector. A document is the average of
its vectors; a softmax layer on top tells good from bad. Training is stochastic gradient descent in numpy on a bounded sample
of labelled documents; scoring runs on all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that training uses at most, those with the least hash of their id.
SAMPLE_ROWS = 4000
BUCKETS = 1 << 15
WIDTH = 16
GRAM_SIZES = (3, 4, 5)
EPOCHS = 6
RATE = 0.4
CUTOFF = 0.3
#: Bytes of a text that are hashed at once, which bounds the memory of a long one.
BYTES_AT_ONCE = 1 << 22
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _buckets(codes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (codes + np.uint64(kind)) * _MIX
    return ((mixed ^ (mixed >> np.uint64(32))) * _MIX >> np.uint64(49)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Bucket of every word and every character n-gram (of UTF-8 bytes) of a text, repeats included."""
    whole = (text or "").encode("utf-8", "replace")
    found = []
    overlap = max(GRAM_SIZES) - 1
    # Length and sum of the part of a word that the bytes before end with.
    begun, part = 0, np.uint64(0)
    with np.errstate(over="ignore"):
        for at in range(0, max(len(whole), 1), BYTES_AT_ONCE):
            data = np.frombuffer(whole[at : at + BYTES_AT_ONCE + overlap], np.uint8)
            own = min(len(data), BYTES_AT_ONCE)
            codes = data.astype(np.uint64)
            gram = codes
            for size in range(2, max(GRAM_SIZES) + 1):
                gram = gram[:-1] * np.uint64(257) + codes[size - 1 :] if len(gram) > 1 else gram[:0]
                if size in GRAM_SIZES:
                    found.append(_buckets(gram[:own], size))
            # A word's hash is the sum of its bytes' hashes, each by its place in the word.
            space = _SPACE[data[:own]]
            place = np.arange(own)
            last = np.maximum.accumulate(np.where(space, place, -1 - begun))
            mixed = (codes[:own] + np.uint64(1)) * ((place - last).astype(np.uint64) * _MIX | np.uint64(1))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(np.where(space, np.uint64(0), mixed), dtype=np.uint64)])
            edges = np.diff(np.concatenate([[1], space.astype(np.int8), [1]]))
            starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
            word = sums[ends] - sums[starts]
            if begun and own and not space[0]:
                word[0] += part
            elif begun:
                word, starts = np.concatenate([[part], word]), np.concatenate([[-1], starts])
            if at + own < len(whole) and not space[-1]:
                begun, part, word = own - starts[-1] + (begun if starts[-1] == 0 else 0), word[-1], word[:-1]
            else:
                begun = 0
            found.append(_buckets(word, 1))
    return np.concatenate(found)


def _counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(features(text), return_counts=True)


class Model:
    """Vectors of the buckets and the softmax layer. Scores need only each bucket's product with the layer."""

    def __init__(self, vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray):
        self.vectors, self.layer, self.bias = vectors, layer, bias
        self.margin = (vectors @ (layer[1] - layer[0])).astype(np.float64)
        self.base = float(bias[1] - bias[0])

    def score(self, text: str | None) -> float:
        found = features(text)
        margin = self.base + (self.margin[found].mean() if len(found) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """Fits vectors and layer to documents given as buckets and counts, one document a step."""
    random = np.random.default_rng(seed)
    vectors = ((random.random((BUCKETS, WIDTH)) - 0.5) / WIDTH).astype(np.float32)
    layer = ((random.random((2, WIDTH)) - 0.5) / WIDTH).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, step = max(1, EPOCHS * len(docs)), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(docs)):
            rate = RATE * (1 - step / steps)
            step += 1
            buckets, counts = docs[i]
            share = (counts / max(1, counts.sum())).astype(np.float32)
            mean = share @ vectors[buckets] if len(buckets) else np.zeros(WIDTH, np.float32)
            logits = layer @ mean + bias
            chance = np.exp(logits - logits.max())
            error = chance / chance.sum()
            error[labels[i]] -= 1
            back = error @ layer
            layer -= rate * np.outer(error, mean)
            bias -= rate * error
            if len(buckets):
                # As in the usual formulation, each feature moves by its share of the document's gradient.
                vectors[buckets] -= rate * np.outer(share * len(buckets) ** 0.5, back)
    return Model(vectors, layer, bias)


def held_out(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model from labelled documents that are not held out; None if there are none.

    Documents whose labels contradict each other, and NULL ids or labels, are left out; rows of one id count with their own
    text. At most ``sample_rows`` documents come to the driver, as buckets and counts: those with the least hash of id and
    text.
    """
    agreed = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    agreed = agreed.agg(F.min("quality").cast("int").alias("label"), F.max("quality").cast("int").alias("_top")).filter("label = _top")
    agreed = agreed.filter(~F.coalesce(held_out("doc_id"), F.lit(True))).select("doc_id", "label")
    order = F.xxhash64("doc_id")
    # The bound is taken on the labels alone, before any text is read.
    chosen = agreed.orderBy(order, "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [_counted(t.as_py()) for t in batch.column(1)]
            columns = [
                batch.column(0),
                batch.column(2),
                pa.array([b.astype("<u2").tobytes() for b, _ in each], pa.binary()),
                pa.array([c.astype("<u4").tobytes() for _, c in each], pa.binary()),
            ]
            yield pa.record_batch(columns, names=["doc_id", "label", "buckets", "counts"])

    found = rows.mapInArrow(count, "doc_id long, label int, buckets binary, counts binary")
    found = found.orderBy(order, "doc_id", "label", "buckets", "counts").limit(sample_rows).collect()
    if not found:
        return None
    sample = [(np.frombuffer(r[2], "<u2").astype(np.int64), np.frombuffer(r[3], "<u4").astype(np.float32)) for r in found]
    return train(sample, np.array([r[1] for r in found]))


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of each row's whole text; 0.5 without a model. NULL texts count as empty."""
    lean = model and Model.__new__(Model)
    if lean:  # the vectors stay here; scoring needs one number per bucket
        lean.margin, lean.base = model.margin, model.base

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lean.score(t.as_py()) if lean else 0.5 for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(score, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``score`` and ``predicted``; a NULL id counts as held out.

    Learns from the text alone; other columns, also clashing ones, are not read. An empty table gives no rows.
    """
    scored = scores(docs, fit(docs, labels, sample_rows))
    return scored.select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= cutoff).cast("int").alias("predicted"),
    )
