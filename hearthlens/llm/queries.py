"""The registered queries of this subpackage, with the SQL that some are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    best_fit_packing,
    divergence_audit,
    embedding_dedup,
    language_id,
    line_dedup,
    merkle_manifest,
    mixing,
    permutation_index,
    pii,
    pivot_table_search,
    quality,
    simhash_dedup,
    suffix_dedup,
)
from .tables import id_of, read

TOKENIZER = "byte_bpe_50k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    return best_fit_packing.pack_documents(read(spark, sf_dir, "documents"), path, capacity=1024)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), words_each=3, radius=3)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and web pages together: each has kinds of evidence that the other lacks, and both share the text models."""
    documents = language_id.document_evidence(read(spark, sf_dir, "documents"))
    pages = language_id.page_evidence(read(spark, sf_dir, "pages"))
    found = language_id.identify(documents.unionByName(pages))
    own = id_of(F.col("_id"))
    ids = [F.when(F.col("origin") == t, own).alias(c) for t, c in (("documents", "doc_id"), ("pages", "page_id"))]
    return found.select(*ids, "language", "posterior", "accepted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_report(read(spark, sf_dir, "documents"))


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(read(spark, sf_dir, "embeddings"), k=20)


def op10_pivot_table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_table_search.nearest(read(spark, sf_dir, "embeddings"), k=20)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.tampering_report(read(spark, sf_dir, "documents"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit(read(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_simhash_dedup,
        op3_suffix_dedup,
        op4_language_id,
        op5_line_dedup,
        op6_pii,
        op7_quality,
        op8_mixing,
        op9_permutation_index,
        op10_pivot_table_search,
        op11_merkle_manifest,
        op12_divergence_audit,
        op13_embedding_dedup,
    )
}

ORACLE = {
    "op5_line_dedup": line_dedup.REPORT_SQL,
    "op8_mixing": mixing.REPORT_SQL,
    "op10_pivot_table_search": pivot_table_search.SEARCH_SQL,
    "op11_merkle_manifest": merkle_manifest.REPORT_SQL,
    "op12_divergence_audit": divergence_audit.AUDIT_SQL,
}
