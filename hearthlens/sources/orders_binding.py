"""Listings made of the order tables: one listing per order line.

Order stands for title and host, nation for area, region for borough; a tenth of the orders lie in the next borough. Sixteen
orders share a host name, and an order's number tells the host's home, so that about half of the hosts are local at every
scale. The first orders have property types of their own, of a few lines each, and the highest score, out of range, has a room type. Every
listings column is one expression with the dimension tables it needs, and only the tables behind the
requested columns are joined. Dimension keys are unique and the joins are left joins, so a join left out changes neither
the rows nor the other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}

_PLACE = ("orders", "customer", "area")

# listings column -> (expression, tables it needs beside lineitem)
COLUMNS: dict[str, tuple[str, tuple[str, ...]]] = {
    "id": ("l_orderkey * 8 + l_linenumber", ()),
    "listing_url": ("concat('/l/', l_orderkey)", ()),
    "name": ("if(l_orderkey % 97 = 0, null, concat('Order ', l_orderkey))", ()),
    "neighborhood_overview": ("if(l_partkey % 11 = 0, null, concat('About ', p_name))", ("part",)),
    "host_id": ("l_orderkey", ()),
    "host_name": ("if(l_orderkey % 50 = 0, null, concat('Host ', l_orderkey div 16))", ()),
    "host_since": ("if(o_custkey % 17 = 0, null, cast(o_orderdate as date))", ("orders",)),
    "host_response_rate": ("if(l_discount = 0.01, null, l_discount * 10)", ()),
    "host_acceptance_rate": ("if(l_tax = 0.01, null, l_tax * 10)", ()),
    "host_is_superhost": ("case l_returnflag when 'A' then 't' when 'N' then 'f' end", ()),
    "host_neighbourhood": ("home.n_name", ("home",)),
    "neighbourhood": ("if(l_partkey % 13 = 0, null, 'x')", ()),
    "neighbourhood_cleansed": ("area.n_name", _PLACE),
    "neighbourhood_group_cleansed": ("r_name", (*_PLACE, "region")),
    "latitude": ("40 + area.n_nationkey / 100", _PLACE),
    "longitude": ("-74 + home.n_nationkey / 100", ("home",)),
    "property_type": ("if(l_orderkey < 40, concat('Kind ', l_orderkey), p_type)", ("part",)),
    "room_type": ("case when l_orderkey % 89 = 0 then null when l_quantity = 50 then 'Top' else o_orderpriority end", ("orders",)),
    "accommodates": ("l_linenumber - 1", ()),
    "bathrooms_text": (
        "case p_size % 6 when 0 then 'Half-bath' when 1 then '1 bath' when 2 then '1.5 baths' "
        "when 3 then '2 shared baths' when 5 then 'Shared half-bath' end",
        ("part",),
    ),
    "bedrooms": ("cast(nullif(l_linenumber, 7) as double)", ()),
    "price": ("if(l_discount = 0, '$0.00', concat('$', format_number(l_extendedprice, 2)))", ()),
    "minimum_nights": ("l_linenumber", ()),
    "maximum_nights": ("p_size * 7", ("part",)),
    "availability_30": ("cast(p_size % 31 as double)", ("part",)),
    "availability_60": ("cast(p_size as double)", ("part",)),
    "availability_90": ("cast(p_size + 10 as double)", ("part",)),
    "availability_365": ("cast(p_size * 7 as double)", ("part",)),
    "number_of_reviews": ("p_size", ("part",)),
    "review_scores_rating": ("case when l_tax = 0 then null when l_quantity = 50 then 5.5D when l_quantity = 49 then 5D else (l_quantity - 1) / 10 end", ()),
    "review_scores_accuracy": ("5 - l_tax * 10", ()),
    "review_scores_cleanliness": ("5 - l_discount * 10", ()),
    "review_scores_checkin": ("5 - l_tax * 20", ()),
    "review_scores_communication": ("5 - l_discount * 20", ()),
    "review_scores_location": ("l_quantity / 10", ()),
    "review_scores_value": ("5 - l_discount * 5", ()),
    "instant_bookable": ("if(l_linestatus = 'O', 't', 'f')", ()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str, columns: list[str] | tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """The listings table with ``columns``, joining no table they do not need."""
    needed = {dim for c in columns for dim in COLUMNS[c][1]}

    def of(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    # nation and region have 25 and 5 rows at every scale; all other sizes are left to Spark to check.
    rows = of("lineitem")
    if "part" in needed:
        rows = rows.join(of("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    if "home" in needed:
        home = F.broadcast(of("nation")).alias("home")
        rows = rows.join(home, F.expr("cast(l_orderkey % 25 as int)") == F.col("home.n_nationkey"), "left")
    # Last, where Spark can drop it below a distinct over other columns.
    if "orders" in needed:
        orders = of("orders")
        if "customer" in needed:
            orders = orders.join(of("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        if "area" in needed:
            area = F.broadcast(of("nation")).alias("area")
            orders = orders.join(area, F.col("c_nationkey") == F.col("area.n_nationkey"), "left")
        if "region" in needed:
            of_area = F.expr("(area.n_regionkey + if(o_orderkey % 10 = 0, 1, 0)) % 5")
            orders = orders.join(F.broadcast(of("region")), of_area == F.col("r_regionkey"), "left")
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select(*[F.expr(COLUMNS[c][0]).alias(c) for c in columns])


def area_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area mapping for these tables: nations n and n+5 of the first ten share one merged area."""
    return (
        table(spark, sf_dir, "nation")
        .filter("n_nationkey < 10")
        .selectExpr("n_name as area", "concat('CLUSTER_', char(65 + n_nationkey % 5)) as merged_area")
    )


def boroughs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boroughs that a listing can lie in."""
    return table(spark, sf_dir, "region").select("r_name")


def room_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All room types that a listing can be of."""
    return table(spark, sf_dir, "orders").select("o_orderpriority").distinct().union(spark.sql("select 'Top'"))
