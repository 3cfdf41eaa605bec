"""Removal of lines that repeat: overlapping windows of three lines, hashed and counted over the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import id_of, row_key, whole_row, written

WINDOW_LINES = 3


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """One row per window: ``_a`` and ``_b`` (a hash of its lines), its document and its first line's number.

    Rows that agree in id and text would give the same windows at the same places; they count as one document.
    """
    lines = docs.select(*row_key(), _lines("text").alias("_lines"))
    # Each line is hashed once; the windows' hashes are then made of numbers.
    hashed = lines.select(
        "_id", "_text", F.transform("_lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))).alias("_hashes")
    ).filter(F.size("_hashes") >= size)
    places = F.sequence(F.lit(0), F.size("_hashes") - size)

    def window(at: Column) -> Column:
        parts = [F.get("_hashes", at + k) for k in range(size)]
        return F.struct(
            F.xxhash64(*[p["a"] for p in parts]).alias("_a"), F.xxhash64(*[p["b"] for p in parts]).alias("_b"), at.alias("_at")
        )

    return hashed.select("_id", "_text", F.inline(F.transform(places, window)))


def covered_lines(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """``_id``, ``_text`` and ``_covered``: the sorted numbers of the lines to remove, for documents that have any.

    A window's first occurrence, by document id, text hash and place, stays. Both sides of the join are dealt by the
    window, so that adaptive execution can split a window that many documents share.
    """
    windows = _windows(docs, size)
    place = F.struct("_id", "_text", "_at")
    first = windows.groupBy("_a", "_b").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    repeated = first.filter("_first != _last").select("_a", "_b", "_first")
    later = windows.join(repeated, ["_a", "_b"]).filter(place > F.col("_first"))
    starts = later.groupBy("_id", "_text").agg(F.collect_set("_at").alias("_starts"))
    lines = F.flatten(F.transform("_starts", lambda at: F.sequence(at, at + size - 1)))
    return starts.select("_id", "_text", F.array_sort(F.array_distinct(lines)).alias("_covered"))


def _cleaned(docs: DataFrame, size: int) -> DataFrame:
    keyed = docs.select(*row_key(), whole_row(docs).alias("_doc"), _lines("text").alias("_lines"))
    covered = written(covered_lines(docs, size), "covered")
    # Dealt by document at every size, so that the plan of a small corpus is that of a large one.
    joined = keyed.join(covered.hint("merge"), ["_id", "_text"], "left")
    numbers = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_covered"))
    kept = F.array_join(F.transform(numbers, lambda i: F.get("_lines", i)), "\n")
    text = F.when(F.col("_covered").isNull(), F.col("_doc.text")).otherwise(kept)
    removed = F.when(F.col("_covered").isNull(), 0).otherwise(F.size("_covered"))
    return joined.select(
        "_id", "_doc", F.size("_lines").cast("long").alias("_n"), removed.cast("long").alias("_removed"), text.alias("_new")
    )


def dedup_lines(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """``docs`` with later occurrences of repeated windows taken out of ``text``; all other columns as they are.

    A line goes if a window of ``size`` lines that covers it has occurred before. A document of fewer lines has no
    window and stays as it is, also an empty or NULL text. A document of which nothing is left stays with an empty
    text. ``n_chars``, if there, is brought up to date.
    """
    done = _cleaned(docs, size)
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("_removed") > 0, F.length("_new").cast(kind)).otherwise(F.col("_doc.n_chars"))
    return done.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """Per document: ``doc_id``, ``n_lines``, ``n_removed`` and the text that is left."""
    done = _cleaned(docs, size)
    return done.select(
        id_of(F.col("_id")).alias("doc_id"), F.col("_n").alias("n_lines"), F.col("_removed").alias("n_removed"), F.col("_new").alias("text")
    )


#: What :func:`line_report` gives for a table ``documents``, whose ids are unique and not NULL.
REPORT_SQL = r"""
with lines as (
  select doc_id, text, string_split(coalesce(text, ''), chr(10)) as ls from documents
), windows as (
  select doc_id, i as top, ls[i + 1] as l0, ls[i + 2] as l1, ls[i + 3] as l2
  from lines, unnest(range(0, greatest(len(ls) - 2, 0))) as u(i)
), ranked as (
  select doc_id, top, row_number() over (partition by l0, l1, l2 order by doc_id, top) as nth from windows
), covered as (
  select distinct doc_id, top + k as line from ranked, unnest([0, 1, 2]) as u(k) where nth > 1
), kept as (
  select l.doc_id, string_agg(l.ls[i + 1], chr(10) order by i) as text
  from lines l, unnest(range(0, len(l.ls))) as u(i)
  where not exists (select 1 from covered c where c.doc_id = l.doc_id and c.line = i) group by l.doc_id
), removed as (
  select doc_id, count(*) as n from covered group by doc_id
)
select l.doc_id, cast(len(l.ls) as bigint) as n_lines, cast(coalesce(r.n, 0) as bigint) as n_removed,
  case when r.n is null then l.text else coalesce(k.text, '') end as text
from lines l left join removed r on r.doc_id = l.doc_id left join kept k on k.doc_id = l.doc_id
"""
