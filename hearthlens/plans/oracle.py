"""The same results in plain SQL, written the direct way: real joins, real windows, no counting tricks."""

from __future__ import annotations

from ..schema import REGION_MEASURES
from .catalogue import DASHBOARD, MANY_REVIEWS, ONE_BOROUGH, SPOT_CHECK

_LISTINGS = """
listings AS (
  SELECT l_orderkey * 8 + l_linenumber AS id,
    '/l/' || l_orderkey AS listing_url,
    CASE WHEN l_orderkey % 97 <> 0 THEN 'Order ' || l_orderkey END AS name,
    CASE WHEN l_partkey % 11 <> 0 THEN 'About ' || p_name END AS neighborhood_overview,
    l_orderkey AS host_id,
    CASE WHEN l_orderkey % 50 <> 0 THEN 'Host ' || l_orderkey // 16 END AS host_name,
    CASE WHEN o_custkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS host_since,
    CASE WHEN l_discount <> 0.01::DOUBLE THEN l_discount * 10 END AS host_response_rate,
    CASE WHEN l_tax <> 0.01::DOUBLE THEN l_tax * 10 END AS host_acceptance_rate,
    CASE l_returnflag WHEN 'A' THEN 't' WHEN 'N' THEN 'f' END AS host_is_superhost,
    home.n_name AS host_neighbourhood,
    CASE WHEN l_partkey % 13 <> 0 THEN 'x' END AS neighbourhood,
    area.n_name AS neighbourhood_cleansed,
    r_name AS neighbourhood_group_cleansed,
    40 + area.n_nationkey / 100 AS latitude,
    -74 + home.n_nationkey / 100 AS longitude,
    CASE WHEN l_orderkey < 40 THEN 'Kind ' || l_orderkey ELSE p_type END AS property_type,
    CASE WHEN l_orderkey % 89 = 0 THEN NULL WHEN l_quantity = 50 THEN 'Top' ELSE o_orderpriority END AS room_type,
    l_linenumber - 1 AS accommodates,
    CASE p_size % 6 WHEN 0 THEN 'Half-bath' WHEN 1 THEN '1 bath' WHEN 2 THEN '1.5 baths'
      WHEN 3 THEN '2 shared baths' WHEN 5 THEN 'Shared half-bath' END AS bathrooms_text,
    nullif(l_linenumber, 7)::DOUBLE AS bedrooms,
    CASE WHEN l_discount = 0 THEN '$0.00' ELSE '$' || format('{:,.2f}', l_extendedprice) END AS price,
    l_linenumber AS minimum_nights,
    p_size * 7 AS maximum_nights,
    (p_size % 31)::DOUBLE AS availability_30,
    p_size::DOUBLE AS availability_60,
    (p_size + 10)::DOUBLE AS availability_90,
    (p_size * 7)::DOUBLE AS availability_365,
    p_size AS number_of_reviews,
    CASE WHEN l_tax = 0 THEN NULL WHEN l_quantity = 50 THEN 5.5::DOUBLE
      WHEN l_quantity = 49 THEN 5::DOUBLE ELSE (l_quantity - 1) / 10 END AS review_scores_rating,
    5 - l_tax * 10 AS review_scores_accuracy,
    5 - l_discount * 10 AS review_scores_cleanliness,
    5 - l_tax * 20 AS review_scores_checkin,
    5 - l_discount * 20 AS review_scores_communication,
    l_quantity / 10 AS review_scores_location,
    5 - l_discount * 5 AS review_scores_value,
    CASE l_linestatus WHEN 'O' THEN 't' ELSE 'f' END AS instant_bookable
  FROM lineitem
  LEFT JOIN orders ON o_orderkey = l_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation area ON area.n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = (area.n_regionkey + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) % 5
  LEFT JOIN nation home ON home.n_nationkey = l_orderkey % 25
  LEFT JOIN part ON p_partkey = l_partkey
),
valued AS (
  SELECT *, TRY_CAST(replace(regexp_replace(price, '^[$€£¥]', ''), ',', '') AS DOUBLE) AS pricing,
    coalesce(TRY_CAST(trim(regexp_extract(bathrooms_text, '^([^A-Za-z]*)', 1)) AS DOUBLE), 0) AS baths,
    coalesce(bedrooms, 0) AS beds,
    CASE WHEN host_is_superhost = 'f' THEN 0 ELSE 1 END AS superhost
  FROM listings
),
priced AS (SELECT * FROM valued WHERE pricing > 0),
rated AS (SELECT * FROM priced WHERE review_scores_rating > 0),
fact AS (
  SELECT name, neighbourhood_group_cleansed AS neighbourhood_group, neighbourhood_cleansed AS neighbourhood,
    property_type, room_type, pricing AS price, number_of_reviews AS reviews, review_scores_rating AS score,
    review_scores_accuracy AS score_accuracy, review_scores_cleanliness AS cleanliness,
    review_scores_checkin AS checkin, review_scores_communication AS communication,
    review_scores_location AS location, review_scores_value AS value, beds AS bedrooms, baths AS bathrooms
  FROM valued
),
scored AS (SELECT * FROM fact WHERE score IS NOT NULL AND price > 0),
reliable AS (SELECT * FROM scored WHERE reviews > 10),
titles AS (
  SELECT v.* EXCLUDE (price), f.price AS fact_price, f.score, f.score_accuracy, f.cleanliness, f.checkin,
    f.communication, f.location, f.value
  FROM valued v JOIN reliable f ON v.name = f.name
),
per_host AS (SELECT host_id, count(*) AS listings FROM rated GROUP BY host_id),
pairs AS (
  SELECT n_name AS area, 'CLUSTER_' || chr(65 + n_nationkey % 5) AS merged_area FROM nation WHERE n_nationkey < 10
)"""


def _round(x: str, digits: int = 6) -> str:
    """Rounded through a decimal, half away from zero; the wider cast first takes away summation noise."""
    return f"round(CAST({x} AS DECIMAL(38,{8 if digits < 4 else 10})), {digits})::DOUBLE"


def _number(x: str) -> str:
    """Six significant digits, with the three-digit exponent of the report.

    ``printf`` rounds the binary value, which may stand just under a decimal half. The factor lets such
    halves go away from zero, as ``round`` lets them.
    """
    return f"coalesce(regexp_replace(printf('%g', ({x})::DOUBLE * (1 + 1e-12)), 'e([+-])(\\d\\d)$', 'e\\10\\2'), '')"


def _range(x: str) -> str:
    return f"{_number(f'min({x})')} || ' - ' || {_number(f'max({x})')}"


def _percent(part: str, whole: str) -> str:
    return f"CAST(({part})::DOUBLE * 100 / ({whole}) AS DECIMAL(10,2))::VARCHAR || '%'"


def _digits(x: str) -> str:
    return f"printf('%.9e', ({x})::DOUBLE)::DOUBLE"


def _r(x: str, y: str) -> str:
    return f"CASE WHEN NOT isnan(corr({x}, {y})) THEN corr({x}, {y}) END"


def _price_summary(dim: str, source: str = "priced") -> str:
    return f"""SELECT {dim} AS category, count({dim}) AS units, min(pricing) AS min_price, max(pricing) AS max_price,
      {_round("avg(pricing)", 2)} AS avg_price, {_range("pricing")} AS price_range FROM {source} GROUP BY {dim}"""


def _score_mean(dim: str) -> str:
    return f"SELECT {dim}, {_round('avg(score)', 2)} AS avg_score FROM scored GROUP BY {dim}"


def _score_range(dim: str, measure: str = "score") -> str:
    return f"""SELECT {dim}, {_range(measure)} AS range_of_ratings, {_round(f"avg({measure})")} AS average_rating
      FROM reliable GROUP BY {dim}"""


def _corr(x: str, by: str = "", where: str = "true") -> str:
    if by:
        return f"""SELECT {by}, {_round("r")} AS r FROM
          (SELECT {by}, {_r(x, "score")} AS r FROM scored WHERE {where} GROUP BY {by}) WHERE r IS NOT NULL"""
    return f"""SELECT n, {_digits("sx")} AS sx, {_digits("sy")} AS sy, {_digits("sxy")} AS sxy, {_digits("sx2")} AS sx2,
      {_digits("sy2")} AS sy2, {_round("r")} AS r FROM
      (SELECT count(*) AS n, sum({x}) AS sx, sum(score) AS sy, sum({x} * score) AS sxy, sum({x} * {x}) AS sx2,
        sum(score * score) AS sy2, {_r(x, "score")} AS r FROM scored WHERE {where}) WHERE r IS NOT NULL"""


_KPI = f"""count(*) AS listings, sum(accommodates)::BIGINT AS accommodations, sum(number_of_reviews)::BIGINT AS reviews,
  {_round("avg(review_scores_rating)", 2)} AS average_rating,
  '$' || {_number(_round("avg(pricing)", 2))} AS average_pricing"""

_LOCAL = """FROM valued a WHERE EXISTS
  (SELECT 1 FROM listings b WHERE b.neighbourhood_cleansed = a.host_neighbourhood AND b.host_name = a.host_name)"""

_LOCAL_DETAILS = """SELECT * EXCLUDE (host_id) FROM (
  SELECT DISTINCT host_id, host_name, host_neighbourhood, name, neighborhood_overview,
    neighbourhood_group_cleansed AS borough, property_type, room_type, accommodates, {price} AS price,
    review_scores_rating, number_of_reviews
  {local} AND neighbourhood IS NOT NULL AND {where})"""

_SUPERHOST_SHARE = """SELECT {dim}, count(*)::DOUBLE AS total_hosts, sum(superhost)::DOUBLE AS superhosts,
  {percent} AS percent_superhosts FROM titles GROUP BY {dim}"""


def _area_summary(area: str, source: str) -> str:
    return f"""SELECT neighbourhood_group_cleansed, {area}, count(*) AS listings,
      {_round("min(pricing)", 2)} AS minp, {_round("max(pricing)", 2)} AS maxp, {_round("avg(pricing)", 2)} AS avgp,
      {_round("min(review_scores_rating)", 2)} AS minscores, {_round("max(review_scores_rating)", 2)} AS maxscores,
      {_round("avg(review_scores_rating)", 2)} AS avgscores, sum(number_of_reviews)::BIGINT AS rev,
      sum(accommodates)::BIGINT AS acc
      FROM {source} WHERE accommodates <> 0 GROUP BY neighbourhood_group_cleansed, {area}"""


_MERGED = """(SELECT rated.*, coalesce(merged_area, neighbourhood_cleansed) AS neighbourhood_area
  FROM rated LEFT JOIN pairs ON area = neighbourhood_cleansed)"""
_REGION = _area_summary("neighbourhood_area", _MERGED)


def _describe(measures: list[str], source: str = "region_summary") -> str:
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    lines = [
        f"""SELECT '{m}' AS measure, count({m}) AS count, {_round(f"avg({m})")} AS mean,
          {_round(f"stddev_samp({m})")} AS std,
          {_round(f"min({m})")} AS min,
          {", ".join(f"{_round(f'quantile_cont({m}::DOUBLE, {q})')} AS {name}" for name, q in quartiles.items())},
          {_round(f"max({m})")} AS max FROM {source}"""
        for m in measures
    ]
    return " UNION ALL ".join(lines)


def _matrix(by: str = "", digits: int = 6) -> str:
    keep, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    lines = []
    for a in REGION_MEASURES:
        for b in REGION_MEASURES:
            r = _r(a, b) if a != b else f"CASE WHEN NOT isnan(corr({a}, {b})) THEN 1.0::DOUBLE END"
            r = _round(r, digits)
            lines.append(f"SELECT {keep}'{a}' AS col_x, '{b}' AS col_y, {r} AS r FROM region_summary{group}")
    return " UNION ALL ".join(lines)


def _dashboard() -> str:
    columns = list(dict.fromkeys(c for g in DASHBOARD for c in g))
    reliable = "CASE WHEN review_scores_rating IS NOT NULL AND number_of_reviews > 10 THEN {} END"
    rating, cleanliness = (reliable.format(c) for c in ("review_scores_rating", "review_scores_cleanliness"))
    rated_price = "CASE WHEN review_scores_rating IS NOT NULL THEN pricing END"
    lines = []
    for g in DASHBOARD:
        kpi = f"SELECT * FROM priced{' WHERE review_scores_rating IS NOT NULL' if g else ''}"
        group = f" GROUP BY {', '.join(g)}" if g else ""
        keys = ", ".join(f"{c if c in g else 'NULL::VARCHAR'} AS {c}" for c in columns)
        valued = " AND ".join(f"{c} IS NOT NULL" for c in g) or "true"
        same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM k.{c}" for c in g) or "true"
        lines.append(f"""SELECT a.*, coalesce(k.listings, 0) AS listings, k.accommodations, k.reviews,
          '$' || {_number("k.price")} AS average_pricing FROM (
          SELECT '{', '.join(g) or 'all'}' AS dimension, {keys},
            {_round("avg(review_scores_rating)", 2)} AS average_rating,
            count(*) FILTER ({valued}) AS units, min(pricing) AS min_price, max(pricing) AS max_price,
            {_round("avg(pricing)", 2)} AS avg_price, {_range("pricing")} AS price_range,
            {_round("avg(review_scores_rating)", 2)} AS avg_score,
            {_round("sum(review_scores_rating * number_of_reviews) / sum(number_of_reviews) FILTER (review_scores_rating IS NOT NULL)", 2)} AS avg_mod_score,
            {_range(rating)} AS range_of_ratings, {_round(f"avg({rating})")} AS average_reliable_rating,
            {_range(cleanliness)} AS range_of_cleanliness, {_round(f"avg({cleanliness})")} AS average_cleanliness,
            {_round(_r(rated_price, "review_scores_rating"))} AS price_score_r FROM priced{group}) a
          LEFT JOIN (SELECT {', '.join([*g, 'count(*) AS listings'])}, sum(accommodates)::BIGINT AS accommodations,
            sum(number_of_reviews)::BIGINT AS reviews, {_round("avg(pricing)", 2)} AS price FROM ({kpi}){group}) k ON {same}""")
    return " UNION ALL ".join(lines)


_TITLES_IN = ", ".join(f"'{t}'" for t in SPOT_CHECK)

_SELECTS: dict[str, str] = {
    "listings_scan": "SELECT * REPLACE (host_since::VARCHAR AS host_since) FROM listings",
    "clean_prices": "SELECT property_type, pricing FROM priced",
    "bathrooms": "SELECT baths AS bathrooms FROM valued",
    "bedrooms": "SELECT beds AS bedrooms FROM valued",
    "review_fact": "SELECT * EXCLUDE (bedrooms, bathrooms) FROM fact",
    "review_fact_scored": "SELECT * EXCLUDE (bedrooms, bathrooms) FROM scored",
    "review_fact_rooms": """SELECT * EXCLUDE (neighbourhood, neighbourhood_group), neighbourhood_group AS neighbourhood
      FROM fact""",
    "rooms_spot_check": f"SELECT name, bedrooms, bathrooms FROM fact WHERE name IN ({_TITLES_IN})",
    "rooms_spot_check_raw": f"SELECT name, bedrooms, bathrooms_text FROM listings WHERE name IN ({_TITLES_IN})",
    "priced_rated_listings": """SELECT * EXCLUDE (baths, beds, superhost)
      REPLACE (host_since::VARCHAR AS host_since) FROM rated""",
    "listing_details": """SELECT host_id, host_name, coalesce(name, ' - ') AS name,
      coalesce(neighborhood_overview, ' - ') AS neighborhood_overview, neighbourhood_cleansed,
      neighbourhood_group_cleansed, pricing AS price, property_type, room_type,
      CASE host_is_superhost WHEN 't' THEN 'Superhost' WHEN 'f' THEN 'Not Superhost' END AS superhost,
      review_scores_rating, latitude, longitude, accommodates, baths AS bathrooms, beds AS bedrooms, minimum_nights,
      maximum_nights, review_scores_accuracy, review_scores_checkin, review_scores_cleanliness,
      review_scores_communication, review_scores_location, review_scores_value, number_of_reviews, listing_url
      FROM rated WHERE host_name IS NOT NULL""",
    "kpi_overall": f"SELECT {_KPI} FROM priced",
    "kpi_by_borough": f"""SELECT neighbourhood_group_cleansed, {_KPI} FROM priced
      WHERE review_scores_rating IS NOT NULL GROUP BY neighbourhood_group_cleansed""",
    "dashboard": _dashboard(),
    "price_by_property_type": _price_summary("property_type"),
    "price_by_room_type": _price_summary("room_type"),
    "price_by_borough": _price_summary("neighbourhood_group_cleansed"),
    "price_by_area": _price_summary("neighbourhood_cleansed", "rated"),
    "listings_describe": _describe(
        ["review_scores_rating", "number_of_reviews", "bedrooms", "host_response_rate", "id", "pricing"], "valued"
    ),
    "score_by_area": _score_mean("neighbourhood"),
    "score_by_property_type": _score_mean("property_type"),
    "score_by_room_type": _score_mean("room_type"),
    "weighted_score_by_room_type": f"""SELECT room_type,
      {_round("sum(score * reviews) / sum(reviews)", 2)} AS avg_mod_score FROM scored GROUP BY room_type""",
    "score_range_by_property_type": _score_range("property_type"),
    "score_range_by_room_type": _score_range("room_type"),
    "score_range_by_area": _score_range("neighbourhood"),
    "score_range_by_borough": _score_range("neighbourhood_group"),
    "lowest_scored_area": """SELECT neighbourhood, min(score) AS minimum FROM reliable GROUP BY neighbourhood
      ORDER BY minimum, neighbourhood LIMIT 1""",
    "cleanliness_by_room_type": _score_range("room_type", "cleanliness"),
    "cleanliness_by_area": _score_range("neighbourhood", "cleanliness"),
    "cleanliness_by_borough": _score_range("neighbourhood_group", "cleanliness"),
    "corr_price_score": _corr("price"),
    "corr_price_score_by_area": _corr("price", "neighbourhood"),
    "corr_price_score_by_property_type": _corr("price", "property_type", "score > 0"),
    "corr_price_score_by_room_type": _corr("price", "room_type", f"score > 0 AND reviews > {MANY_REVIEWS}"),
    "corr_price_score_by_area_room": _corr("price", "neighbourhood, room_type"),
    "corr_price_score_by_borough_room": _corr("price", "neighbourhood_group, room_type"),
    "corr_bedrooms_score": _corr("bedrooms"),
    "corr_bedrooms_score_by_borough": _corr("bedrooms", "neighbourhood_group"),
    "corr_bedrooms_score_by_property_type": _corr("bedrooms", "property_type", "score > 0"),
    "corr_bedrooms_score_by_room_type": _corr("bedrooms", "room_type", "score > 0"),
    "corr_bedrooms_score_by_borough_room": _corr("bedrooms", "neighbourhood_group, room_type"),
    "corr_bathrooms_score": _corr("bathrooms"),
    "corr_bathrooms_score_by_borough": _corr("bathrooms", "neighbourhood_group"),
    "corr_bathrooms_score_by_room_type": _corr("bathrooms", "room_type", "score > 0"),
    "corr_bathrooms_score_by_borough_room": _corr("bathrooms", "neighbourhood_group, room_type"),
    "local_hosts": f"SELECT DISTINCT host_id, host_name, host_neighbourhood {_LOCAL}",
    "local_host_count": f"""SELECT host_neighbourhood, count(DISTINCT host_id) AS hosts_live_here {_LOCAL}
      GROUP BY host_neighbourhood""",
    "local_host_listings": _LOCAL_DETAILS.format(
        price="price", local=_LOCAL, where="review_scores_rating IS NOT NULL"
    ),
    "local_host_by_borough": _LOCAL_DETAILS.format(
        price="pricing", local=_LOCAL, where="pricing > 0 AND review_scores_rating > 0 AND number_of_reviews > 10"
    ),
    "local_host_in_borough": _LOCAL_DETAILS.format(
        price="pricing", local=_LOCAL, where="pricing > 0 AND review_scores_rating > 0 AND number_of_reviews > 10 AND neighbourhood_group_cleansed = \'" + ONE_BOROUGH + "\'"
    ),
    "host_signup_running": """SELECT pricing, host_since::VARCHAR AS host_date,
      row_number() OVER (PARTITION BY host_since ORDER BY pricing, id) AS counts
      FROM priced WHERE host_since IS NOT NULL AND year(host_since) > 2000""",
    "listings_per_host": "SELECT host_id, listings FROM per_host",
    "multi_listing_hosts": "SELECT host_id, listings FROM per_host WHERE listings > 3",
    "listings_of_hosts_over": "SELECT sum(listings)::BIGINT AS listings FROM per_host WHERE listings > 0",
    "top_host_share": f"""SELECT
      {_round("sum(listings) FILTER (rank <= ceil(hosts * 4 / 100)) * 100 / sum(listings)")} AS percent FROM (
      SELECT listings, row_number() OVER (ORDER BY listings DESC) AS rank, count(*) OVER () AS hosts FROM per_host)""",
    "host_concentration": f"""SELECT more_than, count(*) FILTER (listings > more_than) AS hosts,
      coalesce(sum(listings) FILTER (listings > more_than), 0)::BIGINT AS listings,
      {_round("count(*) FILTER (listings > more_than) / count(*)")} AS host_share,
      {_round("coalesce(sum(listings) FILTER (listings > more_than), 0) / sum(listings)")} AS listing_share
      FROM per_host, (VALUES (1), (2), (3)) t(more_than) GROUP BY more_than""",
    "superhost_scorecard": f"""SELECT superhost, {_round("avg(pricing)", 2)} AS avg_price,
      {_range("fact_price")} AS price_range,
      {", ".join(f"{_round(f'avg({c})')} AS {c}" for c in ("score", "score_accuracy", "cleanliness", "checkin",
                                                           "communication", "location", "value"))}
      FROM titles GROUP BY superhost""",
    "superhost_rates": f"""SELECT superhost, {_round("avg(coalesce(host_response_rate, 0))")} AS avg_response_rate,
      {_round("avg(coalesce(host_acceptance_rate, 0))")} AS avg_acceptance_rate FROM titles GROUP BY superhost""",
    "superhost_instant_bookable": f"""SELECT superhost, sum(bookable)::DOUBLE AS instant_bookable,
      count(bookable)::DOUBLE AS total,
      {_percent("sum(bookable)", "count(bookable)")} AS percent_bookable
      FROM (SELECT superhost, CASE WHEN instant_bookable = 'f' THEN 0 ELSE 1 END AS bookable FROM titles)
      GROUP BY superhost""",
    "superhost_share_by_borough": _SUPERHOST_SHARE.format(
        dim="neighbourhood_group_cleansed", percent=_percent("sum(superhost)", "count(*)")
    ),
    "superhost_share_by_room_type": _SUPERHOST_SHARE.format(
        dim="room_type", percent=_percent("sum(superhost)", "count(*)")
    ),
    "superhost_availability": f"""SELECT superhost,
      {", ".join(f"{_round(f'avg(availability_{d})')} AS a{d}" for d in (30, 60, 90, 365))}
      FROM titles WHERE availability_30 > 0 GROUP BY superhost""",
    "score_histogram": f"""SELECT range, count(*)::DOUBLE AS count,
      {_number(_round("count(*) * 100 / sum(count(*)) OVER ()", 2))} || '%' AS percent
      FROM (SELECT CASE WHEN score = 5 THEN '5' WHEN score >= 0 AND score < 5
        THEN floor(score)::INT || '-' || (floor(score)::INT + 1) END AS range FROM titles) GROUP BY range""",
    "area_window_metrics": f"""SELECT neighbourhood_group_cleansed, neighbourhood_cleansed, {_round("avgp")} AS avgp,
      {_round("scores")} AS scores, rev::BIGINT AS rev FROM (
      SELECT neighbourhood_group_cleansed, neighbourhood_cleansed, avg(pricing) OVER so_far AS avgp,
        avg(review_scores_rating) OVER so_far AS scores, sum(number_of_reviews) OVER so_far AS rev
      FROM rated WINDOW so_far AS (PARTITION BY neighbourhood_cleansed ORDER BY neighbourhood_group_cleansed))""",
    "area_summary": _area_summary("neighbourhood_cleansed", "rated"),
    "area_summary_remapped": "SELECT * FROM region_summary",
    "region_head": """SELECT * FROM region_summary
      ORDER BY neighbourhood_group_cleansed, neighbourhood_area LIMIT 5""",
    "region_describe": _describe(["listings", *REGION_MEASURES]),
    "region_describe_measures": _describe(REGION_MEASURES),
    "region_corr": _matrix(),
    "region_heatmap": _matrix(digits=1),
    "region_filter": f"SELECT * FROM region_summary WHERE neighbourhood_group_cleansed = '{ONE_BOROUGH}'",
    "region_tail": f"""SELECT * FROM region_summary WHERE neighbourhood_group_cleansed = '{ONE_BOROUGH}'
      ORDER BY neighbourhood_group_cleansed DESC, neighbourhood_area DESC LIMIT 5""",
    "region_corr_by_borough": _matrix("neighbourhood_group_cleansed"),
    "boroughs": "SELECT DISTINCT neighbourhood_group_cleansed FROM region_summary",
}

# Spelling by host, and comparison in small letters without blanks at the end.
_SPELLED = "CASE WHEN host_id % 2 = 0 THEN upper({0}) ELSE {0} END || CASE WHEN host_id % 3 = 0 THEN '  ' ELSE '' END"
_TITLED = f"""(SELECT * REPLACE ({_SPELLED.format("('Orders ' || host_id // 2)")} AS name) FROM valued)"""
_SELECTS |= {
    "local_host_count_any_case": f"""SELECT host_neighbourhood, count(DISTINCT host_id) AS hosts_live_here FROM
      (SELECT *, lower(rtrim({_SPELLED.format("host_name")})) AS told, lower(rtrim(host_neighbourhood)) AS home FROM listings) a WHERE EXISTS
      (SELECT 1 FROM listings b WHERE lower(rtrim(b.neighbourhood_cleansed)) = a.home AND lower(rtrim(b.host_name)) = a.told)
      GROUP BY host_neighbourhood""",
    "superhost_rates_any_case": f"""SELECT t.superhost, {_round("avg(coalesce(t.host_response_rate, 0))")} AS avg_response_rate,
        {_round("avg(coalesce(t.host_acceptance_rate, 0))")} AS avg_acceptance_rate
      FROM {_TITLED} t JOIN {_TITLED} f ON lower(rtrim(t.name)) = lower(rtrim(f.name))
      WHERE f.pricing > 0 AND f.number_of_reviews > 10 AND f.review_scores_rating IS NOT NULL GROUP BY t.superhost""",
    "price_by_property_type_any_case": f"""SELECT min(spelled) AS category, count(spelled) AS units, min(pricing) AS min_price,
      max(pricing) AS max_price, {_round("avg(pricing)", 2)} AS avg_price, {_range("pricing")} AS price_range
      FROM (SELECT *, {_SPELLED.format("property_type")} AS spelled FROM priced) GROUP BY lower(rtrim(spelled))""",
}
# Tables that were stored and read back give the same.
_SELECTS |= {f"{key}_stored": _SELECTS[key] for key in ("superhost_scorecard", "region_corr")}

ORACLE: dict[str, str] = {
    key: f"WITH {_LISTINGS.strip()},\nregion_summary AS ({_REGION})\n{select}" for key, select in _SELECTS.items()
}
