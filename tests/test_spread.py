"""Hot copies in global sorts, and large counts written out."""

import re
from collections import Counter

from pyspark.sql import functions as F
from test_plans import plan_of

from hearthlens.operators import spread


def test_ten_million_copies_of_a_row_are_sorted_by_many_tasks(spark, scratch):
    one = spark.range(10_000_000, numPartitions=64).select(F.lit(7).alias("id"), F.concat(F.lit("x"), F.repeat(F.lit("y"), 40)).alias("name"))
    rows = one.unionByName(spark.range(20).select(F.col("id").cast("int"), F.lit("y").alias("name")))
    done = spread.sorted_rows(rows, "id")
    placed = done.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"))
    parts = placed.groupBy("p").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_if(F.col("name") != "y").alias("hot")
    )
    parts = parts.orderBy("p").collect()
    assert sum(p.n for p in parts) == 10_000_020 and sum(p.hot for p in parts) == 10_000_000
    assert all(a.high <= b.low for a, b in zip(parts, parts[1:]))
    assert len(parts) >= 4 and max(p.n for p in parts) < 5_000_000
    rows.limit(100).write.parquet(f"{scratch}/rows")
    assert plan_of(spread.sorted_rows(spark.read.parquet(f"{scratch}/rows"), "id")).count("FileScan") == 1


def test_a_sort_compares_hashes_made_before(spark):
    rows = spark.createDataFrame([(i % 2, str(i)) for i in range(100)], "k int, `t.x` string")
    plan = plan_of(spread.sorted_rows(rows, F.desc("k")))
    compared = [li for li in plan.splitlines() if re.search(r"[-+:] (\*\(\d+\) )?Sort |rangepartitioning", li)]
    assert len(compared) == 2 and not any("xxhash64" in li for li in compared)
    assert spread.sorted_rows(rows, "k").columns == rows.columns


def test_few_copies_of_many_rows(spark):
    rows = spark.createDataFrame([(i % 50, None if i % 3 else float(i % 7), "a.b") for i in range(3000)], "k int, v double, `t.x` string")
    got = [tuple(r) for r in spread.sorted_rows(rows, F.desc("k")).collect()]
    assert Counter(got) == Counter(tuple(r) for r in rows.collect()) and [r[0] for r in got] == sorted((r[0] for r in got), reverse=True)
    assert spread.sorted_rows(rows.limit(0), "k").count() == 0


def test_a_hundred_million_repeats_with_two_shuffle_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rows = spark.createDataFrame([("hot", 10**8), ("none", 0), ("one", 1)], "k string, n long")
        each = spread.repeat_rows(rows, "n", "nth").groupBy(F.spark_partition_id().alias("p"))
        parts = each.agg(F.count(F.lit(1)).alias("n"), F.sum("nth").alias("s")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(p.n for p in parts) == 10**8 + 1 and sum(p.s for p in parts) == 10**8 * (10**8 + 1) // 2 + 1
    assert len(parts) > 50 and max(p.n for p in parts) < 4 * spread.ROWS_A_TASK
    assert spread.repeat_rows(rows.limit(0), "n", "nth").count() == 0
