"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a row meet: how likely its text is in each language (character n-grams), the language
declared in its markup or metadata, the suffix of its address, and what its host mostly publishes. Everything is counted in
the corpus itself: text models by declared language, declarations and suffixes against what texts look like, and hosts by
grouped sums of text evidence, smoothed towards their suffix, which is smoothed towards the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import row_key, whole_row, written

#: Part of the declaring rows that has to declare a language for it to be one. It bounds the number of languages.
LEAST_SHARE = 0.01
#: Stands for a language where none is declared; it has no text, so nothing is accepted.
UNKNOWN = "und"
BUCKETS = 1 << 15
GRAM = 4
BYTES_AT_ONCE = 1 << 22
#: n-grams of a text beyond this add no certainty: neighbouring n-grams repeat what each other says.
CERTAIN_AT = 400
#: Rows that a host's, and a suffix's, smoothing towards the level above weighs.
HOST_WEIGHT = 20.0
SUFFIX_WEIGHT = 100.0
#: Rows of a table that has the wrong declaration or suffix, at least.
DOUBT = 0.02
#: Least posterior, and least likelihood of a text's n-grams in its language against random ones, in nats each.
LEAST_POSTERIOR = 0.6
LEAST_FIT = 0.0
_MIX = np.uint64(0x9E3779B97F4A7C15)


#: ASCII that is no letter becomes a space; bytes of other characters stay.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
KEYS = ["origin", "_id", "_text", "_row"]


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the byte n-grams of a text's lower-cased words, a piece of a long text at a time."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()
    data = b" " + b" ".join(words) + b" " if words else b""
    with np.errstate(over="ignore"):
        for at in range(0, max(0, len(data) - GRAM + 1), BYTES_AT_ONCE):
            codes = np.frombuffer(data[at : at + BYTES_AT_ONCE + GRAM - 1], np.uint8).astype(np.uint64)
            n = len(codes) - GRAM + 1
            packed = codes[:n].copy()
            for i in range(1, GRAM):
                packed |= codes[i : i + n] << np.uint64(8 * i)
            yield ((packed * _MIX) >> np.uint64(49)).astype(np.int64)


def _evidence(
    rows: DataFrame, origin: str, text: Column, declared: Column, host: Column, suffix: Column, id_column: str, text_column: str
) -> DataFrame:
    return rows.select(
        F.lit(origin).alias("origin"),
        *row_key(id_column, text_column),
        F.xxhash64(whole_row(rows)).alias("_row"),
        text.cast("string").alias("text"),
        F.regexp_extract(F.lower(F.trim(F.coalesce(declared.cast("string"), F.lit("")))), "^([^_-]*)", 1).alias("declared"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(suffix.cast("string"), F.lit("")).alias("suffix"),
    )


def document_evidence(docs: DataFrame) -> DataFrame:
    """Evidence in documents: ``lang`` is what they declare, ``source`` is their host; they have no address."""
    none = F.lit(None)
    declared, host = (F.col(c) if c in docs.columns else none for c in ("lang", "source"))
    return _evidence(docs, "documents", F.col("text"), declared, host, none, "doc_id", "text")


def page_evidence(pages: DataFrame) -> DataFrame:
    """Evidence in web pages (``page_id``, ``url``, ``html``): text without markup, ``<html lang>``, host and its last label."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    host = F.lower(F.try_parse_url(F.col("url").cast("string"), F.lit("HOST")))
    hidden = r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*+>|<!--.*?-->|<[^>]*+>|&[#a-z0-9]++;"
    declared = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)
    suffix = F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)
    return _evidence(pages, "pages", F.regexp_replace(html, hidden, " "), declared, host, suffix, "page_id", "html")


def declared_languages(evidence: DataFrame, least_share: float = LEAST_SHARE) -> tuple[str, ...]:
    """The languages that at least ``least_share`` of the rows with a declaration declare, without region or script."""
    counts = evidence.filter("declared <> ''").groupBy("declared").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") >= least_share * total).select("declared").collect()
    return tuple(sorted(r["declared"] for r in found)) or (UNKNOWN,)


def text_models(evidence: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log probability of each bucket in each language, from all texts that declare it.

    Every partition adds up its own counts; the driver gets one number for a language and bucket. A language without
    text has no finite probability and is never chosen.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for found in grams(text.as_py()):
                    counts[languages.index(language)] += np.bincount(found, minlength=BUCKETS)
        at = np.nonzero(counts)
        columns = [pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(counts[at])]
        yield pa.record_batch(columns, names=["language", "bucket", "n"])

    rows = evidence.filter(F.col("declared").isin(*languages)).select("declared", "text")
    found = rows.mapInArrow(count, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), BUCKETS))
    for language, bucket, n in found.collect():
        counts[language, bucket] = n
    totals = counts.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore"):
        return np.where(totals > 0, np.log((counts + 0.5) / (totals + 0.5 * BUCKETS)), -np.inf)


def _text_scores(evidence: DataFrame, models: np.ndarray) -> DataFrame:
    """Keys and other evidence with ``_scores``, the tempered log likelihood per language, and ``_fit`` of the best."""
    shared = evidence.sparkSession.sparkContext.broadcast(models)
    kept = [*KEYS, "declared", "host", "suffix"]
    usable = np.isfinite(models[:, 0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(np.where(usable[:, None], shared.value, -1e3).T)
        for batch in batches:
            scores, fits = [], []
            for text in batch.column(len(kept)):
                total, n = np.zeros(len(usable)), 0
                for found in grams(text.as_py()):
                    total += np.bincount(found, minlength=BUCKETS) @ table if len(found) > BUCKETS else table[found].sum(axis=0)
                    n += len(found)
                mean = total / max(n, 1)
                scores.append((mean - mean.max()) * min(n, CERTAIN_AT))
                fits.append(float(mean.max() + np.log(BUCKETS)) if n else None)
            flat = np.concatenate(scores) if scores else np.zeros(0)
            offsets = np.arange(len(scores) + 1, dtype=np.int32) * len(usable)
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(fits, pa.float64())]
            yield pa.record_batch(columns, names=[*kept, "_scores", "_fit"])

    schema = "origin string, _id long, _text long, _row long, declared string, host string, suffix string, _scores array<double>, _fit double"
    return evidence.select(*kept, "text").mapInArrow(score, schema)


def identify(
    evidence: DataFrame,
    languages: tuple[str, ...] | None = None,
    least_posterior: float = LEAST_POSTERIOR,
    least_fit: float = LEAST_FIT,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """``origin _id _text _row`` with ``language``, ``posterior`` and ``accepted`` for each row of evidence.

    Accepted is a row whose text has letters, suits its language better than random n-grams would, and leaves
    no more doubt than ``least_posterior`` allows. A text without letters (NULL and empty texts too) is judged by the other
    evidence and not accepted. Missing declarations, hosts and suffixes say nothing. ``languages`` are those that enough rows declare
    (:func:`declared_languages`), unless given. An empty table gives no rows.
    """
    languages = languages or declared_languages(evidence, least_share)
    numbers = range(len(languages))
    scored = written(_text_scores(evidence, text_models(evidence, languages)), "text-scores")
    top = F.array_max("_scores")
    raw = [F.exp(F.get("_scores", F.lit(i)) - top) for i in numbers]
    soft = scored.select("*", *[r.alias(f"_r{i}") for i, r in enumerate(raw)])
    total = sum((F.col(f"_r{i}") for i in numbers), F.lit(0.0))
    known = F.col("_fit").isNotNull().cast("double")
    soft = soft.select("*", *[(F.col(f"_r{i}") / total * known).alias(f"_p{i}") for i in numbers]).drop(*[f"_r{i}" for i in numbers])

    # How often a language's texts declare what: a table of fixed size.
    declared = F.when(F.col("declared").isin(*languages), F.col("declared")).when(F.col("declared") != "", F.lit("other")).otherwise("")
    soft = soft.withColumn("_says", declared)
    sums = [F.sum(f"_p{i}").alias(f"_s{i}") for i in numbers]
    told = {r["_says"]: [r[f"_s{i}"] for i in numbers] for r in soft.groupBy("_says").agg(*sums).collect()}
    whole = [sum(v[i] for v in told.values()) for i in numbers]
    values = [*languages, "other"]
    spoken = [sum(told.get(v, [0.0] * len(languages))[i] for v in values) for i in numbers]

    def says(i: int) -> Column:
        chance = F.lit(1.0)
        for v in values:
            seen = told.get(v, [0.0] * len(languages))[i]
            smooth = (seen + 1.0) / (spoken[i] + len(values))
            chance = F.when(F.col("_says") == v, F.lit((1 - DOUBT) * smooth + DOUBT / len(values))).otherwise(chance)
        return chance

    everywhere = [(w + 1.0) / (sum(whole) + len(languages)) for w in whole]
    hosts = soft.groupBy("suffix", "host").agg(*[F.sum(f"_p{i}").alias(f"_h{i}") for i in numbers])
    hosts = written(hosts, "hosts")
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(f"_h{i}").alias(f"_x{i}") for i in numbers])
    in_suffix = sum((F.col(f"_x{i}") for i in numbers), F.lit(0.0))
    levels = hosts.join(suffixes, "suffix").select(
        "suffix", "host", *[f"_h{i}" for i in numbers],
        *[((F.col(f"_x{i}") + SUFFIX_WEIGHT * everywhere[i]) / (in_suffix + SUFFIX_WEIGHT)).alias(f"_x{i}") for i in numbers],
    )
    levels = written(levels, "host-priors")
    # Few hosts are broadcast by their size; of many, adaptive execution splits one that holds much of the rows.
    rows = soft.join(levels, ["suffix", "host"])
    # A row's own text is no evidence about what its host else publishes.
    others = sum((F.col(f"_h{i}") - F.col(f"_p{i}") for i in numbers), F.lit(0.0))
    prior = [
        (F.greatest(F.col(f"_h{i}") - F.col(f"_p{i}"), F.lit(0.0)) + HOST_WEIGHT * F.col(f"_x{i}")) / (F.greatest(others, F.lit(0.0)) + HOST_WEIGHT)
        for i in numbers
    ]
    logs = [F.log(F.when(F.col("host") == "", F.col(f"_x{i}")).otherwise(p)) + F.log(says(i)) + F.get("_scores", F.lit(i)) for i, p in enumerate(prior)]
    fused = rows.select(*KEYS, "_fit", F.array(*logs).alias("_logs"))
    best = F.array_max("_logs")
    fused = fused.select(*KEYS, "_fit", "_logs", best.alias("_best"))
    weight = F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_best")))
    language = F.get(F.array(*[F.lit(x) for x in languages]), (F.array_position("_logs", F.col("_best")) - 1).cast("int"))
    done = fused.select(*KEYS, "_fit", language.alias("language"), (1.0 / weight).alias("posterior"))
    accepted = F.coalesce((F.col("_fit") > least_fit) & (F.col("posterior") >= least_posterior), F.lit(False))
    return done.select(*KEYS, "language", "posterior", accepted.alias("accepted"))


def accepted_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that :func:`identify` doesn't accept, columns as they were."""
    rejected = written(identify(document_evidence(docs), **options).filter("not accepted").select(*KEYS[1:]), "rejected")
    keyed = docs.select(*row_key(), F.xxhash64(whole_row(docs)).alias("_row"), whole_row(docs).alias("_doc"))
    return keyed.join(rejected, KEYS[1:], "left_anti").select("_doc.*")
