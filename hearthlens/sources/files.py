"""Tables kept as files, read with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LISTINGS, REGION_SUMMARY


def read_listings(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """The listings table from Parquet, ORC, JSON or CSV. No schema is inferred.

    CSV columns are found by their names in the header, in any order and letter case; others are ignored, and all files
    must have the same header. Percent text is a fraction (``53%`` is 0.53); empty cells and ``N/A`` in columns other
    than text are NULL. A cell of another type fails the read; with ``malformed="report"`` it becomes NULL and its column is
    listed in an added column ``_malformed``. Malformed JSON fails too.

    CSV needs ``multiLine=True`` when descriptions hold line breaks; such files cannot be split,
    so write them once as Parquet before large runs.
    """
    return _read(spark, path, format, LISTINGS, options)


def read_region_summary(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """A stored merged-area summary, the input of the correlation steps. Formats and options as for :func:`read_listings`."""
    return _read(spark, path, format, REGION_SUMMARY, options)


def _read(spark: SparkSession, path: str, format: str, schema: T.StructType, options: dict) -> DataFrame:
    if format == "csv":
        return _read_csv(spark, path, schema, **options)
    if format == "json":
        options = {"mode": "FAILFAST", **options}
    return spark.read.format(format).schema(schema).options(**options).load(path)


def _read_csv(spark: SparkSession, path: str, schema: T.StructType, malformed: str = "fail", **options) -> DataFrame:
    # Rows with too many or too few cells are told by parsing whole rows, whichever columns are wanted.
    strict = {"header": True, "quote": '"', "escape": '"', "mode": "FAILFAST", "enforceSchema": False, "columnPruning": False}
    cells = spark.read.options(**(strict | options)).csv(path)
    found = {c.strip().lower(): c for c in cells.columns}
    missing = [f.name for f in schema.fields if f.name.lower() not in found]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in the header of {path}")
    values, wrong = [], []
    for field in schema.fields:
        cell = F.col(f"`{found[field.name.lower()]}`")
        value, bad = _typed(cell, field.dataType)
        if malformed == "fail":
            text = F.concat(F.lit(f"{field.name}: not a {field.dataType.simpleString()}: "), cell)
            value = F.when(bad, F.raise_error(text).cast(field.dataType)).otherwise(value)
        values.append(value.alias(field.name))
        wrong.append(F.when(bad, F.lit(field.name)))
    if malformed == "report":
        values.append(F.array_compact(F.array(*wrong)).alias("_malformed"))
    return cells.select(*values)


def _typed(cell: Column, kind: T.DataType) -> tuple[Column, Column]:
    """The cell as ``kind``, and whether it holds something else."""
    if isinstance(kind, T.StringType):
        return cell, F.lit(False)
    text = F.trim(cell)
    text = F.when(~text.isin("", "N/A"), text)
    if isinstance(kind, T.IntegralType):
        # Files made from spreadsheets write 3 as 3.0.
        number = text.try_cast("decimal(38,9)")
        value = F.when(number == F.floor(number), number.try_cast(kind))
    elif isinstance(kind, T.FractionalType):
        percent = F.rtrim(F.regexp_extract(text, "^(.*)%$", 1)).try_cast("double") / 100
        value = F.coalesce(text.try_cast(kind), percent.cast(kind))
    else:
        value = text.try_cast(kind)
    return value, text.isNotNull() & value.isNull()


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None) -> DataFrame:
    """Replace the table at ``path`` by ``df`` and return it read back, with its lineage cut."""
    writer = df.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return _read(df.sparkSession, path, format, df.schema, {})
