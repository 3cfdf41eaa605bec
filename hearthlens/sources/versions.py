"""Tables that are replaced as a whole or not at all, and may be laid out in buckets of a key.

A table is a folder of versions. Each write makes a new one; it counts from the moment its description, a small file, is renamed into place
as the last step. A run that fails before leaves the version that was there. Readers take the newest one described.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DESCRIPTION = "_described.json"


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors see: ``spark.checkpoint.dir``, and only in a local session without one a temporary folder."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return spark.sparkContext.getCheckpointDir()


def _path(spark: SparkSession, path: str):
    """The path and its file system, whichever Spark uses for it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[str]:
    """The complete versions, oldest first."""
    pattern, files = _path(spark, f"{folder}/v-*/{DESCRIPTION}")
    return sorted(s.getPath().getParent().toString() for s in files.globStatus(pattern) or [])


def _next(spark: SparkSession, folder: str) -> str:
    pattern, files = _path(spark, f"{folder}/v-*")
    taken = [int(s.getPath().getName().split("-")[1]) for s in files.globStatus(pattern) or []]
    return f"{folder}/v-{max(taken, default=0) + 1:09d}-{uuid.uuid4().hex[:8]}"


def _describe(spark: SparkSession, path: str, description: dict) -> None:
    draft, files = _path(spark, f"{path}/{DESCRIPTION}.draft")
    out = files.create(draft)
    out.write(bytearray(json.dumps(description).encode()))
    out.close()
    if not files.rename(draft, _path(spark, f"{path}/{DESCRIPTION}")[0]):
        raise OSError(f"{path} can't be described")


def largest_share(df: DataFrame, key: str) -> float:
    """Part of the rows with a ``key`` that the most frequent one has."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.try_divide(F.max("n").cast("double"), F.sum("n").cast("double"))).first()[0] or 0.0


def write_version(
    df: DataFrame, folder: str, bucket_by: str | None = None, buckets: int = 200, most_share: float = 0.05
) -> DataFrame:
    """Makes ``df`` the newest version of the table at ``folder``, and returns it read back.

    With ``bucket_by`` the rows are stored by a hash of that column, in so many files, sorted in each. Aggregates and joins by it then
    need no shuffle. As a bucket is read by one task, a key that holds more than ``most_share`` of the rows is refused; without
    buckets the operators handle such keys.
    """
    spark = df.sparkSession
    path = _next(spark, folder)
    if bucket_by is None:
        df.write.parquet(path)
    else:
        share = largest_share(df, bucket_by)
        if share > most_share:
            raise ValueError(f"one value of {bucket_by} holds {share:.0%} of the rows; store the table without buckets")
        name = f"version_{uuid.uuid4().hex}"
        # Dealt as the buckets are, so that each task writes one; rows without a key by what else they hold.
        instead = F.xxhash64(*df.columns).cast(df.schema[bucket_by].dataType)
        dealt = df.repartition(buckets, F.coalesce(F.col(bucket_by), instead))
        dealt.write.bucketBy(buckets, bucket_by).sortBy(bucket_by).option("path", path).format("parquet").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # its files stay, as their place was given
    _describe(spark, path, {"schema": df.schema.jsonValue(), "bucket_by": bucket_by, "buckets": buckets})
    return read_version(spark, folder)


def read_version(spark: SparkSession, folder: str, version: int = -1) -> DataFrame:
    """The newest version of the table at ``folder``, or another by its place among :func:`versions`."""
    known = versions(spark, folder)
    if not known:
        raise FileNotFoundError(f"no version at {folder}")
    path = known[version]
    files = _path(spark, path)[1]
    text = files.open(_path(spark, f"{path}/{DESCRIPTION}")[0])
    told = json.loads(bytes(text.readAllBytes()).decode())
    text.close()
    schema = StructType.fromJson(told["schema"])
    if told["bucket_by"] is None:
        return spark.read.schema(schema).parquet(path)
    # Only a catalogue table tells Spark of its buckets. The name follows from the path, so a version is declared once.
    name = f"version_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    key = f"`{told['bucket_by']}`"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {told['buckets']} BUCKETS "
        f"LOCATION '{path}'"
    )
    return spark.table(name)


def drop_old(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Removes all but the newest ``keep`` complete versions. Reads of those that are removed fail."""
    for path in versions(spark, folder)[:-keep]:
        found, files = _path(spark, path)
        # First the description, so that what is left of a version half removed isn't taken for one.
        files.delete(_path(spark, f"{path}/{DESCRIPTION}")[0], False)
        files.delete(found, True)
