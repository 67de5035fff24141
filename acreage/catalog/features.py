"""Splits, encodings and features of all listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreage.catalog.cleaning import _unit
from acreage.catalog.profiling import _GAPS, gaps
from acreage.functions.scalars import round_out
from acreage.operators import features as ft
from acreage.plans.views import view, with_views
from acreage.session import stored

KEY = ("row_key",)
_U = _unit("CAST(row_key AS VARCHAR)")
_SPLIT = (f"CASE WHEN {_U} < 0.7::DOUBLE THEN 'train' WHEN {_U} < 0.7::DOUBLE + 0.3::DOUBLE * (1 - 0.333::DOUBLE) THEN 'val' "
          "ELSE 'test' END")
_THREE = (f"CASE WHEN {_U} < 0.9::DOUBLE * (1 - 0.222::DOUBLE) THEN 'train' WHEN {_U} < 0.9::DOUBLE * (1 - 0.222::DOUBLE) + "
          "0.9::DOUBLE * 0.222::DOUBLE THEN 'val' ELSE 'test' END")
_TRAIN = f", s AS (SELECT *, {_SPLIT} AS split FROM listings), t AS (SELECT * FROM s WHERE split = 'train')\n"
#: Prices have two decimal places, so their sums are exact and the means equal to the last bit; they are not rounded, as a mean may lie on a tie.
_MEAN = "CAST(sum(CAST(price_usd AS DECIMAL(38, 2))) AS DOUBLE) / count(*)"
_LABELS = """SELECT DISTINCT {c} AS label FROM t"""


def listings(spark, sf):
    return view(spark, sf, "listings")


def parts(spark, sf):
    return ft.split(listings(spark, sf), KEY)


def train_rows(spark, sf):
    return parts(spark, sf).filter(F.col("split") == "train")


def _sql(text: str, name: str = "listings") -> str:
    return with_views(text, name)


def _label_entry(column: str):
    return (
        lambda s, d: ft.label_encode_fit(listings(s, d), column),
        _sql(f"SELECT {column} AS label, CAST(row_number() OVER (ORDER BY {column}) - 1 AS DOUBLE) AS label_index "
             f"FROM (SELECT DISTINCT {column} FROM listings)"))


def _few_labels(spark, sf):
    """City labels of one country, so that every other city is unseen."""
    return ft.label_encode_fit(listings(spark, sf).filter(F.col("country") == "ASIA"), "city")


def _engineered(spark, sf):
    """Features of every row from values fitted on the training rows."""
    _, made = ft.fit_and_engineer(stored(parts(spark, sf), "rows", spread=True), F.col("split") == "train")
    return round_out(made.select("row_key", "split", *[F.col(c).cast("double").alias(c) for c in ft.FEATURES]),
                     {c: 3 for c in ft.FEATURES if not c.endswith("_avg_price")})


def _scaled(spark, sf):
    rows = listings(spark, sf).select("row_key", "area_sqm", "building_age", F.col("price_usd"))
    columns = ("area_sqm", "building_age", "price_usd")
    return round_out(ft.robust_scale_apply(rows, ft.robust_scale_fit(rows, columns)), {c: 6 for c in columns})


def _filled(spark, sf):
    df = gaps(spark, sf)
    return ft.clip_low(ft.fill_median(df, ft.fill_values(df, ("rooms", "built"))), "rooms", 2).select("row_key", "rooms", "built")


_DERIVED = """ln(1 + area_sqm) AS log_area, area_sqm * area_sqm AS area_squared, sqrt(area_sqm) AS sqrt_area,
    area_sqm / rooms AS area_per_room, rooms * rooms AS rooms_squared, CASE WHEN area_sqm > 150 THEN 1 ELSE 0 END AS is_large,
    CASE WHEN area_sqm < 50 THEN 1 ELSE 0 END AS is_small, CASE WHEN building_age <= 5 THEN 1 ELSE 0 END AS is_new,
    CASE WHEN building_age > 30 THEN 1 ELSE 0 END AS is_old, ln(1 + building_age) AS log_age,
    area_sqm * rooms AS area_x_rooms, area_sqm * building_age AS area_x_age"""
_DERIVED_NAMES = ("log_area", "area_squared", "sqrt_area", "area_per_room", "rooms_squared", "is_large", "is_small", "is_new",
                  "is_old", "log_age", "area_x_rooms", "area_x_age")
_SCALE = "(({c} - (SELECT quantile_cont({c}, 0.5) FROM listings)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM listings))"
_INDEX = "(SELECT {c} AS label, CAST(row_number() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS i{extra} FROM t GROUP BY {c})"
_ENGINEERED = _TRAIN.rstrip() + f""",
ci AS {_INDEX.format(c='city', extra=f', {_MEAN} AS a')}, co AS {_INDEX.format(c='country', extra=f', {_MEAN} AS a')},
fu AS {_INDEX.format(c='furnishing_status', extra='')},
e AS (SELECT row_key, split, co.i AS country_encoded, ci.i AS city_encoded, rooms, area_sqm, CAST(balcony AS DOUBLE) AS balcony, building_age,
    fu.i AS furnishing_status_encoded, ci.a AS city_avg_price, co.a AS country_avg_price, {_DERIVED}
    FROM s JOIN ci ON city = ci.label JOIN co ON country = co.label JOIN fu ON furnishing_status = fu.label)
SELECT row_key, split, {', '.join(c if c.endswith('_avg_price') else f'round(CAST({c} AS DOUBLE), 3) AS {c}' for c in ft.FEATURES)} FROM e"""

ENTRIES = {
    "split_rows": (
        lambda s, d: parts(s, d).select("row_key", "split"), _sql(f"SELECT row_key, {_SPLIT} AS split FROM listings")),
    "split_three_way": (
        lambda s, d: ft.split(listings(s, d), KEY, fractions=ft.ARRAY_SPLIT).select("row_key", "split"),
        _sql(f"SELECT row_key, {_THREE} AS split FROM listings")),
    "fold_sizes": (
        lambda s, d: ft.assign_fold(listings(s, d), KEY, 5).groupBy("fold").agg(F.count("*").alias("n")),
        _sql(f"SELECT least(4, CAST(floor({_U} * 5) AS INTEGER)) AS fold, count(*) AS n FROM listings GROUP BY 1")),
    "fill_median": (_filled, _sql(_GAPS + """SELECT row_key,
        greatest(2, coalesce(rooms, (SELECT quantile_cont(rooms, 0.5) FROM gaps))) AS rooms,
        coalesce(built, (SELECT quantile_cont(built, 0.5) FROM gaps)) AS built FROM gaps""", "raw_listings")),
    "city_mean_price": (
        lambda s, d: ft.target_encode_fit(train_rows(s, d), "city"),
        _sql(_TRAIN + f"SELECT city, {_MEAN} AS city_avg_price, count(*) AS n FROM t GROUP BY city")),
    "country_mean_price": (
        lambda s, d: ft.target_encode_fit(train_rows(s, d), "country"),
        _sql(_TRAIN + f"SELECT country, {_MEAN} AS country_avg_price, count(*) AS n FROM t GROUP BY country")),
    "city_mean_lookup": (
        lambda s, d: ft.target_encode_apply(
            listings(s, d), ft.target_encode_fit(listings(s, d).filter(F.col("country") == "ASIA"), "city"), "city", 7.0).select(
                "row_key", "city", "city_avg_price"),
        _sql(f""", m AS (SELECT city, {_MEAN} AS a FROM listings WHERE country = 'ASIA' GROUP BY city)
            SELECT row_key, city, coalesce(a, 7) AS city_avg_price FROM listings LEFT JOIN m USING (city)""")),
    "out_of_fold_mean": (
        lambda s, d: ft.target_encode_out_of_fold(ft.assign_fold(listings(s, d), KEY, 3), "city", "fold").select(
            "city", "fold", "city_avg_price").distinct(),
        _sql(f""", f AS (SELECT *, least(2, CAST(floor({_U} * 3) AS INTEGER)) AS fold FROM listings),
            k AS (SELECT DISTINCT city, fold FROM f)
            SELECT k.city, k.fold, {_MEAN} AS city_avg_price FROM k JOIN f ON f.city = k.city AND f.fold <> k.fold
            GROUP BY k.city, k.fold""")),
    "derived_features": (
        lambda s, d: round_out(ft.derived(listings(s, d)).select("row_key", *[F.col(c).cast("double").alias(c) for c in _DERIVED_NAMES]),
                               {c: 3 for c in _DERIVED_NAMES}),
        _sql(f", e AS (SELECT row_key, {_DERIVED} FROM listings) SELECT row_key, "
             + ", ".join(f"round(CAST({c} AS DOUBLE), 3) AS {c}" for c in _DERIVED_NAMES) + " FROM e")),
    "city_labels": _label_entry("city"),
    "country_labels": _label_entry("country"),
    "furnishing_labels": _label_entry("furnishing_status"),
    "label_encode_unseen": (
        lambda s, d: ft.label_encode_apply(listings(s, d), _few_labels(s, d), "city").select("row_key", "city", "city_encoded"),
        _sql(""", l AS (SELECT city, CAST(row_number() OVER (ORDER BY city) - 1 AS DOUBLE) AS i FROM
                (SELECT DISTINCT city FROM listings WHERE country = 'ASIA'))
            SELECT row_key, city, coalesce(i, 0) AS city_encoded FROM listings LEFT JOIN l USING (city)""")),
    "unseen_labels": (
        lambda s, d: ft.unseen_counts(listings(s, d), {c: ft.label_encode_fit(
            listings(s, d).filter(F.col("country") == "ASIA"), c) for c in ft.LABELLED}),
        _sql(", a AS (SELECT * FROM listings WHERE country = 'ASIA') " + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} NOT IN (SELECT {c} FROM a)) AS unseen FROM listings"
            for c in ft.LABELLED))),
    "robust_scale": (_scaled, _sql("SELECT row_key, " + ", ".join(
        f"round({_SCALE.format(c=c)}, 6) AS {c}" for c in ("area_sqm", "building_age", "price_usd")) + " FROM listings")),
    "log_price": (
        lambda s, d: listings(s, d).select("row_key", F.round(ft.to_log(F.col("price_usd")), 6).alias("log_price"),
                                           F.round(ft.from_log(ft.to_log(F.col("price_usd"))), 2).alias("price")),
        _sql("SELECT row_key, round(ln(1 + price_usd), 6) AS log_price, round(exp(ln(1 + price_usd)) - 1, 2) AS price FROM listings")),
    "engineered_features": (_engineered, _sql(_ENGINEERED)),
}
