"""Listing, place and account tables derived from the star-schema tables the checks run on.

Each view is one query that both Spark and DuckDB read the same way.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "conversations")

LISTINGS = """
SELECT l_orderkey * 1000000000 + l_partkey AS row_key, r_name AS country, n_name AS city,
       CAST(l_linenumber AS DOUBLE) AS rooms, l_quantity * 10 AS area_sqm,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS balcony, CAST(p_size AS DOUBLE) AS building_age,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'furnished' WHEN '2-HIGH' THEN 'Semi Furnished'
            WHEN '3-MEDIUM' THEN 'semifurnished' WHEN '5-LOW' THEN 'UNFURNISHED' ELSE '' END AS furnishing_status,
       l_extendedprice * 20 AS price_usd
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
"""

# text as a CSV delivers it: currency sign and comma, unparsable and missing numbers, flags as words
RAW_LISTINGS = """
SELECT l_orderkey * 1000000000 + l_partkey AS row_key, n_name AS city_raw,
       CASE WHEN l_linenumber = 7 THEN 'n/a' WHEN l_linenumber = 6 THEN NULL
            ELSE CAST(l_linenumber AS VARCHAR(20)) END AS rooms_raw,
       CAST(CAST(FLOOR(l_quantity * 100) AS BIGINT) AS VARCHAR(20)) AS sqft_raw,
       CONCAT('৳', CAST(CAST(FLOOR(l_extendedprice / 10) AS BIGINT) AS VARCHAR(20)), ',',
              LPAD(CAST(l_partkey AS VARCHAR(20)), 3, '0')) AS price_raw,
       CAST(l_extendedprice AS VARCHAR(40)) AS plain_price_raw,
       CASE WHEN l_returnflag = 'R' THEN 'yes' WHEN l_returnflag = 'A' THEN 'no' ELSE NULL END AS parking_raw,
       CASE WHEN l_returnflag = 'R' THEN '2' WHEN l_returnflag = 'A' THEN '0' ELSE NULL END AS count_raw,
       CASE WHEN l_linestatus = 'O' THEN CAST(1950 + p_size AS VARCHAR(20)) ELSE NULL END AS year_raw,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Furnished' WHEN '2-HIGH' THEN 'Semi-Furnished'
            WHEN '5-LOW' THEN 'Unfurnished' ELSE NULL END AS furnishing_raw
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
"""

# target cities; the second half has no listings
CATALOGUE = """
SELECT r_name AS country, n_name AS city FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT r_name AS country, CONCAT('NEW_', n_name) AS city FROM nation JOIN region ON n_regionkey = r_regionkey
"""

# one region has no coordinates, so its cities drop out of the maps
COORDS = """
SELECT n_name AS city, 10.0E0 + n_nationkey * 1.5E0 AS lat, -120.0E0 + n_nationkey * 9.0E0 AS lng
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'MIDDLE EAST'
"""

POINTS = """
SELECT c_custkey AS point_id, n_name AS city, 20.0E0 + (c_custkey % 100) * 0.01E0 AS lat,
       70.0E0 + FLOOR(c_custkey / 100.0E0) * 0.01E0 AS lng
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

POIS = """
SELECT s_suppkey AS poi_id, n_name AS city,
       CASE s_suppkey % 5 WHEN 0 THEN 'metro' WHEN 1 THEN 'school' WHEN 2 THEN 'hospital' WHEN 3 THEN 'it_park'
            ELSE 'commercial' END AS poi_type,
       20.0E0 + ((s_suppkey * 37) % 100) * 0.01E0 AS lat, 70.0E0 + ((s_suppkey * 13) % 15) * 0.01E0 AS lng
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

PROJECTS = """
SELECT s_suppkey AS project_id, n_name AS city, CAST(1 + s_suppkey % 10 AS DOUBLE) AS weight,
       20.0E0 + ((s_suppkey * 17) % 100) * 0.01E0 AS lat, 70.0E0 + ((s_suppkey * 7) % 15) * 0.01E0 AS lng
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

# cities of one region have no record
SAFETY = """
SELECT n_name AS city, CAST((n_nationkey * 37) % 101 AS DOUBLE) AS crime_index,
       CAST((n_nationkey * 53) % 101 AS DOUBLE) AS traffic_index, CAST((n_nationkey * 29) % 301 AS DOUBLE) AS aqi,
       CAST((n_nationkey * 61) % 101 AS DOUBLE) AS green_space_score,
       CAST((n_nationkey * 71) % 101 AS DOUBLE) AS noise_level
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA'
"""

# cities of one region have no record, those of another lack one field
DEMAND = """
SELECT n_name AS city, n_nationkey * 40 AS search_frequency,
       CASE WHEN r_name = 'ASIA' THEN NULL ELSE n_nationkey * 7 END AS prediction_requests,
       n_nationkey * 90 AS interaction_count, n_nationkey * 11 AS active_listings, n_nationkey % 9 AS new_developments
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE'
"""

USERS = """
SELECT c_custkey AS id, c_name AS username, CONCAT(' ', UPPER(c_name), '@Example.com ') AS email,
       'secret' AS password, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'user' END AS role,
       c_acctbal >= 0 AS is_active, CASE WHEN c_nationkey = 3 THEN '' ELSE c_mktsegment END AS full_name
FROM customer
"""

# several per user; the latest wins. Some users are new, some come back or get another name after they were deleted
CHANGES = """
SELECT CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0 THEN 10000000 + o_custkey ELSE o_custkey END AS id,
       o_orderkey AS seq, CASE WHEN o_orderpriority = '1-URGENT' THEN 'create' WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'update' END AS op,
       CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE NULL END AS full_name,
       CASE WHEN o_orderpriority = '1-URGENT' THEN CONCAT('Again#', CAST(o_custkey AS VARCHAR(20))) ELSE NULL END AS username
FROM orders
"""

# sign-ups: names that supplier rows bring, some of them taken by a customer or repeated
SIGNUPS = """
SELECT o_orderkey AS id, CONCAT('Customer#', CAST(o_custkey AS VARCHAR(20))) AS username,
       CONCAT(UPPER(o_orderpriority), '.', CAST(o_custkey AS VARCHAR(20)), '@example.com') AS email
FROM orders
"""

HISTORY = """
SELECT event_id AS id, user_id, event_type AS kind, n_name AS city, value * 1000 AS predicted_price,
       value * 900 AS price_low, value * 1100 AS price_high, ts AS created_at
FROM events JOIN nation ON user_id % 25 = n_nationkey
"""

# submitted records: some fields missing, some not numbers
REQUESTS = """
SELECT event_id AS request_id, CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END AS user_id, r_name AS country,
       CASE WHEN event_type = 'error' THEN NULL ELSE n_name END AS city,
       CASE WHEN value < 10 THEN 'many' ELSE CAST(1 + user_id % 6 AS VARCHAR(20)) END AS rooms,
       value AS area_sqm, CASE WHEN event_type = 'click' THEN NULL ELSE CAST(user_id % 40 AS DOUBLE) END AS building_age
FROM events JOIN nation ON user_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

# articles: blocks are separated by blank lines
ARTICLES = """
SELECT doc_id, REPLACE(text, '
', '

') AS text FROM documents
"""

VIEWS = {
    "listings": LISTINGS, "raw_listings": RAW_LISTINGS, "catalogue": CATALOGUE, "coords": COORDS, "points": POINTS,
    "pois": POIS, "projects": PROJECTS, "safety": SAFETY, "demand": DEMAND, "users": USERS, "changes": CHANGES,
    "signups": SIGNUPS, "history": HISTORY, "requests": REQUESTS, "articles": ARTICLES,
}

_frames: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _frames:
        _frames[key] = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return _frames[key]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables."""
    key = (spark.sparkContext.applicationId, sf_dir, f"view:{name}")
    if key not in _frames:
        for t in TABLES:
            if t in VIEWS[name]:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        _frames[key] = spark.sql(VIEWS[name])
    return _frames[key]


def with_views(sql: str, *names: str) -> str:
    """An oracle query with the views it reads in front."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names) + ("," if sql.lstrip().startswith(",") else "") \
        + "\n" + sql.lstrip().lstrip(",")
