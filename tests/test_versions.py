"""Tables replaced as a whole, and their layout in buckets."""

import os

import pytest
from fixtures import listings, random_changes
from pyspark.sql import functions as F
from test_plans import plan_of

from hearthlens.operators import title_join
from hearthlens.sources import versions


def frame(spark, seed=3):
    rows = [r | {"name": f"t{i % 90}" if r["name"] else None} for i, r in enumerate(random_changes(seed))]
    return listings(spark, *rows)


@pytest.mark.parametrize("layout", [{}, {"bucket_by": "name", "buckets": 4}])
def test_a_killed_write_leaves_the_old_table(spark, scratch, layout):
    folder = f"{scratch}/t"
    old = versions.write_version(frame(spark), folder, **layout).orderBy("id").collect()
    # The write fails in some tasks after others have written their part.
    broken = frame(spark, 4).repartition(8, "id").withColumn("price", F.when(F.col("id") == 250, F.raise_error("killed")).otherwise(F.col("price")))
    with pytest.raises(Exception, match="killed"):
        versions.write_version(broken, folder, **layout)
    # So does one that ends between the data and the description.
    half = versions._next(spark, folder)
    frame(spark, 5).write.parquet(half)
    assert len(versions.versions(spark, folder)) == 1
    assert versions.read_version(spark, folder).orderBy("id").collect() == old
    new = versions.write_version(frame(spark, 6), folder, **layout)
    assert new.orderBy("id").collect() == frame(spark, 6).orderBy("id").collect() != old
    assert versions.read_version(spark, folder, -2).orderBy("id").collect() == old
    versions.drop_old(spark, folder, keep=1)
    assert len(versions.versions(spark, folder)) == 1 and versions.read_version(spark, folder).count() == len(old)


def test_no_version(spark, scratch):
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, f"{scratch}/none")


def rounded(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


OVER_TITLES = [
    title_join.superhost_scorecard,
    title_join.superhost_rates,
    title_join.superhost_availability,
    title_join.superhost_instant_bookable,
    title_join.score_histogram,
    lambda li: title_join.superhost_share(li, "room_type"),
]


def test_titles_in_buckets_need_no_shuffle(spark, scratch):
    plain = frame(spark)
    stored = versions.write_version(plain, f"{scratch}/t", bucket_by="name", buckets=4)
    for operator in OVER_TITLES:
        result = operator(stored)
        assert "hashpartitioning(title" in plan_of(operator(plain)) and "hashpartitioning(title" not in plan_of(result)
        assert rounded(result) == rounded(operator(plain))
    # One file for each bucket, and more of rows without a title alone.
    (version,) = [f"{scratch}/t/{v}" for v in os.listdir(f"{scratch}/t")]
    assert len([f for f in os.listdir(version) if f.startswith("part-")]) <= 8


def test_a_hot_key_is_not_laid_out_in_buckets(spark, scratch):
    hot = listings(spark, *random_changes(3))
    with pytest.raises(ValueError, match="without buckets"):
        versions.write_version(hot, f"{scratch}/t", bucket_by="name", buckets=4)
    assert versions.write_version(hot, f"{scratch}/t").count() == hot.count()
    assert not [f for f in os.listdir(f"{scratch}/t") if not f.startswith("v-")]
