from collections import Counter

from fixtures import listings, money, random_changes, rows_of
from pyspark.sql import functions as F

from hearthlens.operators import running


def test_area_in_two_boroughs_runs_on(spark):
    def at(borough, price, reviews):
        return {"neighbourhood_group_cleansed": borough, "price": f"${price}.00", "number_of_reviews": reviews}

    rows = listings(spark, at("Queens", 30, 1), at("Brooklyn", 10, 2), at("Brooklyn", 20, 3), at("Queens", 0, 100))
    got = Counter((r[0], r.avgp, r.rev) for r in running.area_window_metrics(rows).collect())
    assert got == {("Brooklyn", 15.0, 5): 2, ("Queens", 20.0, 6): 1}


def test_equals_the_window_row_by_row(spark):
    rows = rows_of(*random_changes(13))
    kept = [r for r in rows if (money(r["price"]) or 0) > 0 and (r["review_scores_rating"] or 0) > 0]
    area, borough = "neighbourhood_cleansed", "neighbourhood_group_cleansed"
    want = Counter()
    for r in kept:
        seen = [o for o in kept if o[area] == r[area] and o[borough] <= r[borough]]
        price = sum(money(o["price"]) for o in seen) / len(seen)
        score = sum(o["review_scores_rating"] for o in seen) / len(seen)
        want[(r[borough], r[area], round(price, 6), round(score, 6), sum(o["number_of_reviews"] or 0 for o in seen))] += 1
    got = running.area_window_metrics(listings(spark, *rows)).collect()
    assert Counter((r[0], r[1], round(r.avgp, 6), round(r.scores, 6), r.rev) for r in got) == want


def test_a_hot_area_is_written_out_by_several_tasks(spark):
    rows = listings(spark, {}).drop("id").crossJoin(spark.range(60_000, numPartitions=4))
    tasks = running.area_window_metrics(rows).groupBy(F.spark_partition_id()).count().collect()
    assert sum(t["count"] for t in tasks) == 60_000 and len(tasks) > 1
