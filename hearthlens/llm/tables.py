"""Reading the given tables, telling rows apart, and cutting lineage with written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a NULL id, so that it sorts first and joins like any other.
NO_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(id_column: str = "doc_id", text_column: str = "text") -> list[Column]:
    """``_id`` and ``_text``: what tells documents apart even if ids are NULL or repeat.

    Rows that agree in both are copies of one document and are treated alike.
    """
    known = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))
    return [known.alias("_id"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("_text")]


def whole_row(docs: DataFrame) -> Column:
    """All columns in one, so that no column added beside it can clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def id_of(key: Column) -> Column:
    """The id that ``_id`` stands for."""
    return F.when(key != NO_ID, key)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver see, as ``spark.checkpoint.dir`` names it.

    Only a local session, which has one machine, gets a temporary folder where the setting is missing.
    """
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder.

    Its lineage ends there: executors that are lost later cost no recomputation, and several readers share
    the work. Its size is known to the planner, which then decides on broadcasts.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Removes tables made by :func:`written`, once all that is made of them is written, too."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, for work that makes much of each row."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
