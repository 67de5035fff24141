"""Profiles of the listings and of the raw text table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from acreage.functions.scalars import num, round_out, with_price_per_sqm
from acreage.operators import profiling as pf
from acreage.operators.growing_profile import GrowingProfile
from acreage.operators.features import area_features
from acreage.plans.profile import treat_missing
from acreage.plans.views import view, with_views
from acreage.session import scratch_path, stored

NUMERIC = ("rooms", "area_sqm", "balcony", "building_age", "price_usd")
TEXT = ("country", "city", "furnishing_status")
RAW = ("city_raw", "rooms_raw", "sqft_raw", "price_raw", "plain_price_raw", "parking_raw", "count_raw", "year_raw",
       "furnishing_raw")
# the numbers of the raw table, gaps included
_GAPS = """, gaps AS (SELECT row_key, city_raw AS city, TRY_CAST(rooms_raw AS DOUBLE) AS rooms,
    TRY_CAST(sqft_raw AS DOUBLE) AS sqft, TRY_CAST(year_raw AS DOUBLE) AS built, parking_raw AS parking,
    furnishing_raw AS furnishing FROM raw_listings)
"""


def listings(spark, sf):
    return view(spark, sf, "listings").drop("row_key")


def gaps(spark, sf):
    return view(spark, sf, "raw_listings").select(
        "row_key", F.col("city_raw").alias("city"), num(F.col("rooms_raw")).alias("rooms"), num(F.col("sqft_raw")).alias("sqft"),
        num(F.col("year_raw")).alias("built"), F.col("parking_raw").alias("parking"), F.col("furnishing_raw").alias("furnishing"))


def _each(columns, template: str) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


def _sql(text: str, name: str = "listings") -> str:
    return with_views(text, name)


_MISSING = _each(RAW, "SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) AS n FROM raw_listings")
_TOP = """, v AS ({values}), c AS (SELECT "column", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS k, count(*) OVER (PARTITION BY "column") AS d FROM c)
SELECT "column", value, n, round(n * 100::DOUBLE / (SELECT count(*) FROM listings), 4) AS pct, d AS n_distinct FROM r WHERE k <= {n}"""
_VALUES = _each(TEXT, "SELECT '{c}' AS \"column\", {c} AS value FROM listings")
_FENCES = """SELECT '{c}' AS "column", {c} AS x, quantile_cont({c}, 0.25) OVER () AS q1, quantile_cont({c}, 0.5) OVER () AS q2,
    quantile_cont({c}, 0.75) OVER () AS q3 FROM listings"""
_FENCED = f""", f AS ({_each(NUMERIC, _FENCES)}), g AS (SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi FROM f)
"""
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM listings"
                           for a, b in combinations(NUMERIC, 2))
_SKEW = _each(NUMERIC, "SELECT '{c}' AS \"column\", round(skewness({c}), 4) AS skewness, abs(skewness({c})) > 1 AS flagged FROM listings")
_HISTOGRAM = """, e AS ({ends}), x AS ({values}),
b AS (SELECT "column", least(29, CAST(floor((v - lo) / (hi - lo) * 30) AS INTEGER)) AS bin, count(*) AS n FROM x JOIN e USING ("column") GROUP BY ALL)
SELECT e."column", CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / 30), 4) AS "from", round(lo + (i + 1) * ((hi - lo) / 30), 4) AS "to",
       coalesce(n, 0) AS n
FROM e CROSS JOIN range(0, 30) r(i) LEFT JOIN b ON b."column" = e."column" AND b.bin = i"""

def _grown(spark, sf):
    """The profile of three parts that came one after the other, the second one twice."""
    grown = GrowingProfile(spark, scratch_path(spark, "grown"))
    rows = view(spark, sf, "raw_listings").withColumn("rooms", num(F.col("rooms_raw")))
    for part in (0, 1, 2, 1):
        grown.add(str(part), rows.filter(F.col("row_key") % 3 == part).select("rooms", num(F.col("sqft_raw")).alias("sqft"), num(F.col("year_raw")).alias("built"), "city_raw", "furnishing_raw"))
    # distinct values of small sets are exact, and so is the middle of the rooms, far from any step
    return grown.profile().select("column", "rows", "missing", "n_distinct", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max",
                                  F.when(F.col("column") == "rooms", F.col("q50")).alias("q50"))


_GROWN = """, g AS (SELECT TRY_CAST(rooms_raw AS DOUBLE) AS rooms, TRY_CAST(sqft_raw AS DOUBLE) AS sqft, TRY_CAST(year_raw AS DOUBLE) AS built, city_raw, furnishing_raw FROM raw_listings)
""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_distinct, {f'round(avg({c}), 6)' if n else 'NULL'} AS mean,
    {f'round(stddev_samp({c}), 6)' if n else 'NULL'} AS std, {f'min({c})' if n else 'NULL'} AS min, {f'max({c})' if n else 'NULL'} AS max, {'quantile_disc(rooms, 0.5)' if c == 'rooms' else 'NULL'} AS q50 FROM g"""
    for c, n in (("rooms", True), ("sqft", True), ("built", True), ("city_raw", False), ("furnishing_raw", False)))

ENTRIES = {
    "growing_profile": (_grown, _sql(_GROWN, "raw_listings")),
    "missing_values": (
        lambda s, d: round_out(pf.missing(view(s, d, "raw_listings").select(*RAW)), {"missing_pct": 4}),
        _sql(f", m AS ({_MISSING}) SELECT \"column\", missing, round(missing * 100::DOUBLE / n, 4) AS missing_pct FROM m WHERE missing > 0",
             "raw_listings")),
    "missing_overall": (
        lambda s, d: round_out(pf.missing_overall(view(s, d, "raw_listings").select(*RAW)), {"missing_pct": 4}),
        _sql(f", m AS ({_MISSING}) SELECT count(*) FILTER (WHERE missing > 0) AS columns_with_missing, "
             "CAST(sum(missing) AS BIGINT) AS missing_cells, round(sum(missing) * 100::DOUBLE / sum(n), 4) AS missing_pct FROM m",
             "raw_listings")),
    "cardinality": (
        lambda s, d: pf.cardinality(listings(s, d)),
        _sql(" UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, "
            f"{'count(DISTINCT ' + c + ') < 10' if c in NUMERIC else 'false'} AS maybe_categorical FROM listings"
            for c in NUMERIC + TEXT))),
    "describe": (
        lambda s, d: round_out(pf.describe(listings(s, d)), {c: 4 for c in ("mean", "std", "min", "q25", "q50", "q75", "max")}),
        _sql(_each(NUMERIC, """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
            round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25,
            round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max
            FROM listings"""))),
    "top_values": (
        lambda s, d: round_out(pf.top_values(listings(s, d), 5), {"pct": 4}), _sql(_TOP.format(values=_VALUES, n=5))),
    "top_value_bars": (
        lambda s, d: round_out(pf.top_values(listings(s, d), 10, first=6), {"pct": 4}), _sql(_TOP.format(values=_VALUES, n=10))),
    "histogram": (
        lambda s, d: round_out(pf.histogram(listings(s, d)), {"from": 4, "to": 4}),
        _sql(_HISTOGRAM.format(
            ends=_each(NUMERIC, "SELECT '{c}' AS \"column\", min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM listings"),
            values=_each(NUMERIC, "SELECT '{c}' AS \"column\", {c}::DOUBLE AS v FROM listings")))),
    "box_stats": (
        lambda s, d: round_out(pf.box_stats(listings(s, d)), {c: 4 for c in ("q1", "median", "q3", "whisker_low", "whisker_high")}),
        _sql(_FENCED + """SELECT "column", round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median,
            round(any_value(q3), 4) AS q3, round(min(x) FILTER (WHERE x >= lo), 4) AS whisker_low,
            round(max(x) FILTER (WHERE x <= hi), 4) AS whisker_high, count(*) FILTER (WHERE x < lo OR x > hi) AS outliers
            FROM g GROUP BY "column\"""")),
    "box_outliers": (
        lambda s, d: pf.box_outliers(with_price_per_sqm(view(s, d, "listings")).select("row_key", "price_per_sqm"), "price_per_sqm"),
        _sql(""", r AS (SELECT row_key, price_usd / area_sqm AS price_per_sqm FROM listings),
            q AS (SELECT quantile_cont(price_per_sqm, 0.25) AS a, quantile_cont(price_per_sqm, 0.75) AS b FROM r)
            SELECT row_key, price_per_sqm FROM r, q
            WHERE price_per_sqm < a - 1.5::DOUBLE * (b - a) OR price_per_sqm > b + 1.5::DOUBLE * (b - a)""")),
    "iqr_outliers": (
        lambda s, d: round_out(pf.iqr_outliers(listings(s, d)), {"outlier_pct": 4}),
        _sql(_FENCED + """SELECT "column", count(*) FILTER (WHERE x < lo OR x > hi) AS outliers,
            round(count(*) FILTER (WHERE x < lo OR x > hi) * 100::DOUBLE / count(*), 4) AS outlier_pct,
            count(*) FILTER (WHERE x < lo OR x > hi) > count(*) * 0.05::DOUBLE AS flagged FROM g GROUP BY "column\"""")),
    "correlation": (lambda s, d: round_out(pf.correlation(listings(s, d)), {"r": 6}), _sql(_CORR)),
    "high_correlation": (
        lambda s, d: round_out(pf.high_correlation(area_features(listings(s, d)), ("area_sqm", "area_squared", "price_usd")), {"r": 6}),
        _sql(""", w AS (SELECT area_sqm, area_sqm * area_sqm AS area_squared, price_usd FROM listings),
            c AS (SELECT 'area_sqm' AS column_a, 'area_squared' AS column_b, corr(area_sqm, area_squared) AS r FROM w
            UNION ALL SELECT 'area_sqm', 'price_usd', corr(area_sqm, price_usd) FROM w
            UNION ALL SELECT 'area_squared', 'price_usd', corr(area_squared, price_usd) FROM w)
            SELECT column_a, column_b, round(r, 6) AS r FROM c WHERE abs(r) > 0.7""")),
    "duplicate_rows": (
        lambda s, d: round_out(pf.duplicate_count(view(s, d, "listings").select("country", "city", "rooms", "area_sqm", "building_age")),
                               {"duplicate_pct": 4}),
        _sql(""", g AS (SELECT country, city, rooms, area_sqm, building_age, count(*) AS n FROM listings GROUP BY ALL)
            SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates,
                   round(sum(n - 1) * 100::DOUBLE / sum(n), 4) AS duplicate_pct FROM g""")),
    "skew_flags": (lambda s, d: round_out(pf.skew_flags(listings(s, d)), {"skewness": 4}), _sql(_SKEW)),
    "category_flags": (
        lambda s, d: pf.category_flags(listings(s, d)),
        _sql(_each(TEXT, """SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct,
            CASE WHEN count(DISTINCT {c}) > count(*) * 0.5::DOUBLE THEN 'high_cardinality' WHEN count(DISTINCT {c}) = 2 THEN 'binary'
                 ELSE 'none' END AS flag FROM listings"""))),
    "column_modes": (
        lambda s, d: pf.column_modes(listings(s, d), TEXT),
        _sql(f""", v AS ({_VALUES}), c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY ALL)
            SELECT "column", value AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) = 1""")),
    "drop_sparse": (
        lambda s, d: pf.drop_sparse(gaps(s, d), 0.32),
        _sql(_GAPS + "SELECT row_key, city, rooms, sqft FROM gaps", "raw_listings")),
    "impute_median": (
        lambda s, d: pf.impute_median(gaps(s, d).drop("row_key")).select("rooms", "sqft", "built"),
        _sql(_GAPS + """SELECT coalesce(rooms, (SELECT quantile_cont(rooms, 0.5) FROM gaps)) AS rooms, sqft,
            coalesce(built, (SELECT quantile_cont(built, 0.5) FROM gaps)) AS built FROM gaps""", "raw_listings")),
    "impute_mode": (
        lambda s, d: pf.impute_mode(gaps(s, d)).select("row_key", "city", "parking", "furnishing"),
        _sql(_GAPS + """SELECT row_key, city, coalesce(parking, (SELECT parking FROM gaps WHERE parking IS NOT NULL GROUP BY 1
                ORDER BY count(*) DESC, 1 LIMIT 1)) AS parking,
            coalesce(furnishing, (SELECT furnishing FROM gaps WHERE furnishing IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1
                LIMIT 1)) AS furnishing FROM gaps""", "raw_listings")),
    "table_shape": (
        lambda s, d: pf.shape(listings(s, d))[0].select("column", "rows"),
        _sql(_each(NUMERIC + TEXT, "SELECT '{c}' AS \"column\", count(*) AS rows FROM listings"))),
    "profile_report": (lambda s, d: pf.profile_report(treat_missing(stored(gaps(s, d).drop("row_key"), "gaps"))), None),
}
