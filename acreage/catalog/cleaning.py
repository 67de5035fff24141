"""Loading, cleaning and submitted records."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreage.functions import scalars as sc
from acreage.operators import cleaning as cl
from acreage.operators.accounts import normalise_keys
from acreage.operators.combine import union_all
from acreage.operators.synthetic import add_synthetic, city_catalogue, missing_cities
from acreage.plans.unify import assemble_listings
from acreage.plans.views import view, with_views
from acreage.session import stored
from acreage.sources import specs

_COLUMNS = "country, city, rooms, area_sqm, balcony, building_age, furnishing_status, price_usd"
_LISTING = "row_key, city, rooms, area_sqm, building_age, furnishing_status, price_usd"

# each source shape as text columns of the raw view
_SHAPES = {
    "bangladesh": (specs.BANGLADESH, {"City": "city_raw", "Bedrooms": "rooms_raw", "Floor_area": "sqft_raw",
                                      "Price_in_taka": "price_raw"}),
    "india_bangalore": (specs.INDIA_BANGALORE, {"Price": "plain_price_raw", "Area": "sqft_raw", "No. of Bedrooms": "rooms_raw",
                                                "Balcony": "count_raw", "Furnishing": "furnishing_raw"}),
    "india_delhi": (specs.INDIA_DELHI, {"price": "plain_price_raw", "area": "sqft_raw", "Bedrooms": "rooms_raw",
                                        "Furnished_status": "furnishing_raw"}),
    "india_rent": (specs.INDIA_RENT, {"City": "city_raw", "BHK": "rooms_raw", "Size": "sqft_raw",
                                      "Furnishing Status": "furnishing_raw", "Rent": "plain_price_raw"}),
    "india_price": (specs.INDIA_PRICE, {"Price": "plain_price_raw", "number of bedrooms": "rooms_raw", "Built Year": "year_raw"}),
    "poland": (specs.POLAND, {"city": "city_raw", "rooms": "rooms_raw", "squareMeters": "sqft_raw",
                              "hasParkingSpace": "parking_raw", "buildYear": "year_raw", "condition": "furnishing_raw",
                              "price": "plain_price_raw"}),
    "usa": (specs.USA, {"bedrooms": "rooms_raw", "sqft_living": "sqft_raw", "view": "count_raw", "yr_built": "year_raw",
                        "price": "plain_price_raw"}),
    "japan": (specs.JAPAN, {"Municipality": "city_raw", "Area": "sqft_raw", "BuildingYear": "year_raw",
                            "TradePrice": "plain_price_raw"}),
}

_ROOMS, _SQFT = "TRY_CAST(rooms_raw AS DOUBLE)", "TRY_CAST(sqft_raw AS DOUBLE)"
_PRICE, _YEAR = "TRY_CAST(plain_price_raw AS DOUBLE)", "TRY_CAST(year_raw AS DOUBLE)"
_COUNT = "CASE WHEN TRY_CAST(count_raw AS DOUBLE) > 0 THEN 1 ELSE 0 END"
_MONEY = "TRY_CAST(replace(replace(price_raw, ',', ''), '৳', '') AS DOUBLE)"

# country, city, rooms, area, balcony, age, furnishing, price
_ORACLES = {
    "bangladesh": ("'Bangladesh'", "city_raw", _ROOMS, f"{_SQFT} * 0.0929::DOUBLE", "0", "5", "'Unknown'", f"{_MONEY} / 110"),
    "india_bangalore": ("'India'", "'Bangalore'", _ROOMS, f"{_SQFT} * 0.0929::DOUBLE", _COUNT, "10", "furnishing_raw", f"{_PRICE} / 83"),
    "india_delhi": ("'India'", "'Delhi'", _ROOMS, f"{_SQFT} * 0.0929::DOUBLE", "0", "10", "furnishing_raw", f"{_PRICE} / 83"),
    "india_rent": ("'India'", "city_raw", _ROOMS, f"{_SQFT} * 0.0929::DOUBLE", "0", "10", "furnishing_raw", f"{_PRICE} * 200 / 83"),
    "india_price": ("'India'", "'India'", _ROOMS, "1000::DOUBLE * 0.0929::DOUBLE", "0", f"2024 - {_YEAR}", "'Unknown'", f"{_PRICE} / 83"),
    "poland": ("'Poland'", "city_raw", _ROOMS, _SQFT, "1", f"2024 - {_YEAR}", "furnishing_raw", f"{_PRICE} / 4"),
    "usa": ("'USA'", "'Seattle'", _ROOMS, f"{_SQFT} * 0.0929::DOUBLE", _COUNT, f"2024 - {_YEAR}", "'Unknown'", _PRICE),
    "japan": ("'Japan'", "city_raw", "3", _SQFT, "1", f"coalesce(2024 - {_YEAR}, 10)", "'Unfurnished'", f"{_PRICE} / 150"),
}


def source_frame(raw, name):
    """The raw view in the column names of one source."""
    return raw.select(*[F.col(c).alias(n) for n, c in _SHAPES[name][1].items()])


def standardised(raw, name):
    return specs.standardise(source_frame(raw, name), _SHAPES[name][0])


def _all_shapes(spark, sf):
    """The rows of all sources; the raw view is joined once and written for them."""
    raw = stored(view(spark, sf, "raw_listings"), "raw")
    return union_all([standardised(raw, n) for n in _SHAPES])


def _rounded(df):
    return sc.round_out(df, {"area_sqm": 4, "price_usd": 4})


def _source_sql(name: str) -> str:
    country, city, rooms, area, balcony, age, furnishing, price = _ORACLES[name]
    needed = f"{_PRICE if name != 'bangladesh' else _MONEY} IS NOT NULL" + (
        "" if name == "japan" else f" AND {_ROOMS} IS NOT NULL") + f" AND {_SQFT} IS NOT NULL"
    return (f"SELECT {country} AS country, {city} AS city, CAST({rooms} AS DOUBLE) AS rooms, round({area}, 4) AS area_sqm, "
            f"{balcony} AS balcony, CAST({age} AS DOUBLE) AS building_age, {furnishing} AS furnishing_status, "
            f"round({price}, 4) AS price_usd FROM raw_listings WHERE {needed}")


def _source_entry(name: str):
    return (lambda s, d: _rounded(standardised(view(s, d, "raw_listings"), name)), with_views(_source_sql(name), "raw_listings"))


def _listing(operator):
    """The operator's surviving rows."""
    return lambda s, d: operator(view(s, d, "listings")).select(*[c.strip() for c in _LISTING.split(",")])


_FURNISHING_SQL = """CASE lower(furnishing_status) WHEN 'furnished' THEN 'Furnished' WHEN 'semi-furnished' THEN 'Semi-Furnished'
    WHEN 'semi furnished' THEN 'Semi-Furnished' WHEN 'semifurnished' THEN 'Semi-Furnished' WHEN 'unfurnished' THEN 'Unfurnished'
    ELSE 'Unknown' END"""
_BAND = "price_usd BETWEEN (SELECT quantile_cont(price_usd, 0.01) FROM listings) AND (SELECT quantile_cont(price_usd, 0.99) FROM listings)"
_HARD = "price_usd > 1000 AND price_usd < 2000000 AND area_sqm > 10 AND area_sqm < 1000"
_FENCE = """, h AS (SELECT * FROM listings WHERE {where}),
q AS (SELECT quantile_cont(price_usd, 0.05) AS a, quantile_cont(price_usd, 0.95) AS b FROM h)
SELECT {columns} FROM h, q WHERE price_usd BETWEEN a - 1.5::DOUBLE * (b - a) AND b + 1.5::DOUBLE * (b - a)"""
_CLEAN = f"{_BAND} AND rooms BETWEEN 1 AND 20 AND area_sqm BETWEEN 10 AND 2000"


def _keep(where: str, columns: str = _LISTING) -> str:
    return with_views(f"SELECT {columns} FROM listings WHERE {where}", "listings")


def _unit(*parts: str, seed: int = 42) -> str:
    """The hash draw in [0, 1) as DuckDB writes it."""
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(parts)})), 1, 13)) AS BIGINT) / 4503599627370496::DOUBLE)"


def _draw(name: str, column: str) -> str:
    key = ("country", "city", "CAST(i AS VARCHAR)")
    u1, u2 = _unit(*key, f"'{name}.1'"), _unit(*key, f"'{name}.2'")
    return f"(avg_{column} + std_{column} * sqrt(-2 * ln(1 - {u1})) * cos(2 * pi() * {u2}))"


_SYNTHETIC = f"""
, present AS (SELECT DISTINCT country, city FROM listings),
moments AS (SELECT country, {', '.join(f'avg({c}) AS avg_{c}, stddev_samp({c}) AS std_{c}' for c in (
    'rooms', 'area_sqm', 'building_age', 'price_usd'))} FROM listings GROUP BY country),
lacking AS (SELECT country, city FROM catalogue WHERE country IN (SELECT country FROM present)
            AND (country, city) NOT IN (SELECT (country, city) FROM present)),
made AS (SELECT * FROM lacking JOIN moments USING (country), range(1, 101) r(i))
SELECT country, city, CAST(greatest(1, trunc({_draw('rooms', 'rooms')})) AS DOUBLE) AS rooms,
       round(greatest(20, {_draw('area', 'area_sqm')}), 3) AS area_sqm,
       CASE WHEN {_unit('country', 'city', 'CAST(i AS VARCHAR)', "'balcony'")} < 0.7::DOUBLE THEN 1 ELSE 0 END AS balcony,
       CAST(greatest(0, trunc({_draw('age', 'building_age')})) AS DOUBLE) AS building_age,
       ['Furnished', 'Semi-Furnished', 'Unfurnished'][1 + CAST(least(2, floor(3 *
           {_unit('country', 'city', 'CAST(i AS VARCHAR)', "'furnishing'")})) AS INTEGER)] AS furnishing_status,
       round(greatest(1000, {_draw('price', 'price_usd')}), 3) AS price_usd
FROM made
"""


def _synthetic_rows(spark, sf):
    from acreage.operators.synthetic import country_moments, synthesise

    listings, catalogue = view(spark, sf, "listings"), view(spark, sf, "catalogue")
    made = synthesise(country_moments(listings), missing_cities(listings, catalogue))
    return sc.round_out(made, {"area_sqm": 3, "price_usd": 3})


def _with_synthetic(spark, sf):
    both = add_synthetic(view(spark, sf, "listings"), view(spark, sf, "catalogue"))
    return both.groupBy("country").agg(F.count("*").alias("n"), F.count_distinct("city").alias("cities"))


def _unified(spark, sf):
    """All sources, made-up rows for the catalogue cities they lack, then every cleaning rule."""
    return assemble_listings(_all_shapes(spark, sf), city_catalogue(spark))


def _validated(spark, sf):
    return cl.validate(view(spark, sf, "requests"), cl.PREDICTION_RULES)


ENTRIES = {f"standardise_{name}": _source_entry(name) for name in _SHAPES} | {
    "union_sources": (
        lambda s, d: _rounded(_all_shapes(s, d)),
        with_views(" UNION ALL ".join(_source_sql(n) for n in _SHAPES), "raw_listings")),
    "unified_listings": (_unified, None),
    "lenient_numbers": (
        lambda s, d: view(s, d, "raw_listings").select(
            "row_key", sc.num(F.col("rooms_raw")).alias("rooms"), sc.money(F.col("price_raw")).alias("amount"),
            sc.flag_gt0(F.col("count_raw")).alias("flag"), sc.flag_truthy(F.col("parking_raw")).alias("truthy")),
        with_views(f"""SELECT row_key, {_ROOMS} AS rooms, {_MONEY} AS amount, {_COUNT} AS flag, 1 AS truthy
                       FROM raw_listings""", "raw_listings")),
    "require_numbers": (
        lambda s, d: cl.require(view(s, d, "raw_listings").select("row_key", "city_raw", sc.num(F.col("rooms_raw")).alias("rooms"),
                                                                  sc.num(F.col("year_raw")).alias("year")), ["rooms", "year"]),
        with_views(f"SELECT row_key, city_raw, {_ROOMS} AS rooms, {_YEAR} AS year FROM raw_listings "
                   f"WHERE {_ROOMS} IS NOT NULL AND {_YEAR} IS NOT NULL", "raw_listings")),
    "percentile_band": (_listing(cl.percentile_band), _keep(_BAND)),
    "rooms_between": (_listing(lambda df: cl.between_filter(df, "rooms", *cl.ROOMS)), _keep("rooms BETWEEN 1 AND 20")),
    "area_between": (_listing(lambda df: cl.between_filter(df, "area_sqm", *cl.AREA_SQM)), _keep("area_sqm BETWEEN 10 AND 2000")),
    "clip_age": (
        lambda s, d: cl.clip_column(view(s, d, "listings"), "building_age", 5, 40).select("row_key", "building_age"),
        with_views("SELECT row_key, least(40, greatest(5, building_age)) AS building_age FROM listings", "listings")),
    "normalise_furnishing": (
        lambda s, d: cl.normalise_furnishing(view(s, d, "listings")).select("row_key", "furnishing_status"),
        with_views(f"SELECT row_key, {_FURNISHING_SQL} AS furnishing_status FROM listings", "listings")),
    "hard_bounds": (_listing(cl.hard_bounds), _keep(_HARD)),
    "iqr_fence": (_listing(lambda df: cl.iqr_fence(df, k=0.01)), with_views(
        _FENCE.replace("1.5::DOUBLE", "0.01::DOUBLE").format(where="true", columns=_LISTING), "listings")),
    "remove_outliers": (_listing(cl.remove_outliers), with_views(_FENCE.format(where=_HARD, columns=_LISTING), "listings")),
    "clean": (_listing(cl.clean), _keep(_CLEAN, _LISTING.replace(
        "building_age", "least(150, greatest(0, building_age)) AS building_age").replace(
        "furnishing_status", f"{_FURNISHING_SQL} AS furnishing_status"))),
    "removal_report": (
        lambda s, d: sc.round_out(cl.removal_report(view(s, d, "listings"), cl.clean(view(s, d, "listings"))), {"removed_pct": 4}),
        with_views(f"""SELECT count(*) AS initial_rows, count(*) FILTER (WHERE {_CLEAN}) AS final_rows,
                       count(*) - count(*) FILTER (WHERE {_CLEAN}) AS removed_rows,
                       round((count(*) - count(*) FILTER (WHERE {_CLEAN})) * 100::DOUBLE / count(*), 4) AS removed_pct
                       FROM listings""", "listings")),
    "finite_rows": (
        lambda s, d: cl.finite_rows(view(s, d, "raw_listings").select("row_key", sc.num(F.col("rooms_raw")).alias("rooms"),
                                                                      sc.num(F.col("year_raw")).alias("year")), ["rooms", "year"]),
        with_views(f"SELECT row_key, {_ROOMS} AS rooms, {_YEAR} AS year FROM raw_listings "
                   f"WHERE {_ROOMS} IS NOT NULL AND {_YEAR} IS NOT NULL", "raw_listings")),
    "filter_place": (
        _listing(lambda df: cl.filter_place(df, country="ASIA")),
        _keep("country = 'ASIA'")),
    "accepted_requests": (
        lambda s, d: cl.accepted(_validated(s, d)),
        with_views("""SELECT request_id, user_id, country, city, rooms, area_sqm, coalesce(building_age, 10) AS building_age,
                      false AS balcony, 'Unknown' AS furnishing_status, 10::DOUBLE AS range_pct
                      FROM requests WHERE city IS NOT NULL AND TRY_CAST(rooms AS DOUBLE) IS NOT NULL""", "requests")),
    "rejected_requests": (
        lambda s, d: cl.rejected(_validated(s, d)).select("request_id", "reason", F.size("reasons").alias("n_reasons")),
        with_views("""SELECT request_id, CASE WHEN city IS NULL THEN 'city is required' ELSE 'rooms is not a number' END AS reason,
                      CAST(city IS NULL AS INTEGER) + CAST(TRY_CAST(rooms AS DOUBLE) IS NULL AS INTEGER) AS n_reasons
                      FROM requests WHERE city IS NULL OR TRY_CAST(rooms AS DOUBLE) IS NULL""", "requests")),
    "normalise_keys": (
        lambda s, d: normalise_keys(view(s, d, "users")).select("id", "username", "email", "full_name"),
        with_views("SELECT id, trim(username) AS username, lower(trim(email)) AS email, nullif(trim(full_name), '') AS full_name "
                   "FROM users", "users")),
    "missing_cities": (
        lambda s, d: missing_cities(view(s, d, "listings"), view(s, d, "catalogue")),
        with_views("SELECT country, city FROM catalogue WHERE country IN (SELECT country FROM listings) AND "
                   "(country, city) NOT IN (SELECT (country, city) FROM listings)", "listings", "catalogue")),
    "synthetic_rows": (_synthetic_rows, with_views(_SYNTHETIC, "listings", "catalogue")),
    "with_synthetic": (_with_synthetic, with_views(
        """, lacking AS (SELECT country, city FROM catalogue WHERE (country, city) NOT IN (SELECT (country, city) FROM listings)),
        whole AS (SELECT country, city FROM listings UNION ALL SELECT country, city FROM lacking, range(1, 101))
        SELECT country, count(*) AS n, count(DISTINCT city) AS cities FROM whole
        WHERE country IN (SELECT country FROM listings) GROUP BY country""", "listings", "catalogue")),
}
