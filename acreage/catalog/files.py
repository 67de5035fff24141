"""Files: the given tables written as the CSV that sources deliver, read back, unified, profiled and saved."""

from __future__ import annotations

import os
import warnings

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from acreage.catalog import features as cf
from acreage.catalog.cleaning import _PRICE, _ROOMS, _SHAPES, _SQFT, _YEAR, _rounded, _source_sql, source_frame
from acreage.catalog.profiling import _MISSING
from acreage.functions.scalars import round_out
from acreage.operators import features as ft
from acreage.operators import profiling as pf
from acreage.operators.stages import PriceFeatures
from acreage.plans.profile import profile
from acreage.plans.unify import SOURCES, load_all, unify
from acreage.plans.views import view, with_views
from acreage.session import drop_path, scratch_path, stored
from acreage.sources import files as fs

_COLUMNS = "country, city, rooms, area_sqm, balcony, building_age, furnishing_status, price_usd"
#: Where the files of each shape lie below the data folder. Poland and Japan have two files with different headers.
_PLACES = {"bangladesh": "Bangladesh/house_price_bd.csv", "india_bangalore": "INDIA/Bangalore.csv", "india_delhi": "INDIA/Delhi_v2.csv", "india_rent": "INDIA/House_Rent_Dataset.csv",
           "india_price": "INDIA/House Price India.csv", "poland": "POLAND/apartments_pl_1.csv", "usa": "USA/kc_house_data.csv", "japan": "JAPAN/01.csv"}


def _as_csv(df, path, **options):
    df.write.options(header=True, escape='"', **options).csv(path)


def _data_folder(spark, sf, names=tuple(_PLACES)):
    """The files, packed: as plain text they are several times the rest of the job's disk. The joined rows go once the files are written."""
    root, joined = scratch_path(spark, "sources"), scratch_path(spark, "joined")
    raw = stored(view(spark, sf, "raw_listings"), f"{os.path.basename(joined)}/raw")  # joined once for all files
    odd = raw.filter("row_key % 2 = 1")
    packed = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    for name in names:
        _as_csv(source_frame(raw, name), f"{root}/{_PLACES[name]}", **packed)
    if "poland" in names:
        _as_csv(odd.select(F.col("plain_price_raw").alias("price"), F.col("city_raw").alias("city"), F.col("rooms_raw").alias("rooms"), F.col("sqft_raw").alias("squareMeters")), f"{root}/POLAND/apartments_pl_2.csv", **packed)
    if "japan" in names:
        _as_csv(odd.select(F.col("plain_price_raw").alias("TradePrice"), F.col("sqft_raw").alias("Area")), f"{root}/JAPAN/02.csv", **packed)
    drop_path(spark, joined)
    return root


_ODD_SQL = f"""SELECT 'Poland' AS country, city_raw AS city, {_ROOMS} AS rooms, round({_SQFT}, 4) AS area_sqm, 0 AS balcony, CAST(24 AS DOUBLE) AS building_age, 'Unknown' AS furnishing_status,
        round({_PRICE} / 4, 4) AS price_usd FROM raw_listings WHERE row_key % 2 = 1 AND {_PRICE} IS NOT NULL AND {_ROOMS} IS NOT NULL AND {_SQFT} IS NOT NULL
    UNION ALL SELECT 'Japan', 'Aomori', 3, round({_SQFT}, 4), 1, 10, 'Unfurnished', round({_PRICE} / 150, 4) FROM raw_listings
        WHERE row_key % 2 = 1 AND {_PRICE} IS NOT NULL AND {_SQFT} IS NOT NULL"""
#: The shape without an area gives every row the default, whether or not the raw table has one.
_ALL_SQL = " UNION ALL ".join(_source_sql(n).removesuffix(f" AND {_SQFT} IS NOT NULL") if n == "india_price" else _source_sql(n) for n in _SHAPES) + f" UNION ALL {_ODD_SQL}"


def _unified_files(spark, sf):
    return _rounded(load_all(spark, _data_folder(spark, sf)))


def _some_missing(spark, sf):
    """Two sources are there, the files of all others are missing; rows by country."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        loaded = load_all(spark, _data_folder(spark, sf, ("usa", "india_rent")))
    return loaded.groupBy("country", "city").agg(F.count("*").alias("n"))


def _unified_run(spark, sf):
    """Read, clean, save and read again: the whole run without made-up rows."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        out = unify(spark, _data_folder(spark, sf, ("usa", "japan")), scratch_path(spark, "unified"), include_synthetic=False)
    return _rounded(out["listings"])


_RUN_SQL = ", u AS (" + " UNION ALL ".join([_source_sql("usa"), _source_sql("japan"), _ODD_SQL.split("UNION ALL ", 1)[1]]) + """),
    b AS (SELECT quantile_cont(price_usd, 0.01) AS lo, quantile_cont(price_usd, 0.99) AS hi FROM u)
    SELECT country, city, rooms, area_sqm, balcony, CASE WHEN building_age IS NOT NULL THEN least(100, greatest(0, building_age)) END AS building_age,
           CASE lower(furnishing_status) WHEN 'unfurnished' THEN 'Unfurnished' ELSE 'Unknown' END AS furnishing_status, price_usd
    FROM u, b WHERE price_usd BETWEEN lo AND hi AND rooms BETWEEN 1 AND 20 AND area_sqm BETWEEN 10 AND 2000"""


def _capped(spark, sf):
    """The first 20 rows of each of several files."""
    root = scratch_path(spark, "files")
    raw = stored(view(spark, sf, "raw_listings").select("row_key", "city_raw", "rooms_raw"), "raw")
    for part in range(3):
        _as_csv(raw.filter(F.col("row_key") % 3 == part), f"{root}/f{part}.csv")
    (frame,) = fs.read_file_set(spark, f"{root}/*.csv")
    typed = frame.withColumn("row_key", F.col("row_key").cast("long"))
    placed = fs.file_attr(typed, fs.list_files(spark, f"{root}/*.csv"), ["first", "second"], "place", "number_{}")
    return fs.cap_rows(placed, "place", 20, ["row_key"]).select("place", "row_key", "city_raw", "rooms_raw")


def _written(fmt):
    def build(spark, sf):
        path = fs.write_listings(view(spark, sf, "listings").select(*_COLUMNS.split(", ")), scratch_path(spark, "written"), fmt)
        back = fs.read_listings(spark, path, fs.LISTING_SCHEMA if fmt == "csv" else None, fmt)
        return back.select(*_COLUMNS.split(", "))
    return build


def _written_stats(spark, sf):
    stats = pf.missing(view(spark, sf, "raw_listings").drop("row_key"))
    back = fs.read_listings(spark, fs.write_stats(stats, scratch_path(spark, "stats")))
    return back.select("column", F.col("missing").cast("long").alias("missing"), F.round(F.col("missing_pct").cast("double"), 4).alias("missing_pct"))


def _profiled(spark, sf):
    """The whole profile run on a CSV: the gaps of the file as read, and each column's type and kind after they are filled."""
    path = scratch_path(spark, "profiled")
    _as_csv(view(spark, sf, "raw_listings").select("city_raw", "rooms_raw", "sqft_raw", "parking_raw", "year_raw", "furnishing_raw"), f"{path}/in")
    out = profile(spark, f"{path}/in", f"{path}/out")
    left = pf.missing_counts(out["processed"]).select("column", F.col("missing").alias("left_missing"))
    numeric, text = pf.column_kinds(out["processed"])
    kind = F.when(F.col("column").isin(numeric), "numeric").when(F.col("column").isin(text), "text")
    kept = out["columns"].select("column", "rows").join(out["missing"].select("column", "missing"), "column", "left").join(left, "column")
    return kept.select("column", "rows", F.coalesce("missing", F.lit(0)).alias("missing"), "left_missing", kind.alias("kind"))


def _vectors(spark, sf):
    """The scaled feature vector of each row, one column for each place, from values fitted on the training rows."""
    fitted, made = ft.fit_and_engineer(stored(cf.parts(spark, sf), "rows", spread=True), F.col("split") == "train")
    rows = ft.vectorise(made, fitted).select("row_key", "split", F.col("label"), vector_to_array("features").alias("x"))
    return rows.select("row_key", "split", F.round("label", 6).alias("label"), *[F.round(F.col("x")[i], 4).alias(f"x{i}") for i in range(len(ft.FEATURES))])


def _saved_vectors(spark, sf):
    """The same vectors from a feature stage fitted on the training rows, saved in a pipeline and read back."""
    rows = stored(cf.parts(spark, sf), "rows", spread=True)
    path = scratch_path(spark, "pipeline")
    PipelineModel([PriceFeatures().fit(rows.filter("split = 'train'"))]).write().save(path)
    out = PipelineModel.load(path).transform(rows).select("row_key", "split", "label", vector_to_array("features").alias("x"))
    return out.select("row_key", "split", F.round("label", 6).alias("label"), *[F.round(F.col("x")[i], 4).alias(f"x{i}") for i in range(len(ft.FEATURES))])


_RAW_FEATURES = cf._ENGINEERED[:cf._ENGINEERED.rindex("SELECT row_key, split")]
_VECTOR_SQL = _RAW_FEATURES.rstrip().replace("SELECT row_key, split, co.i", "SELECT row_key, split, price_usd, co.i") + ",\nq AS (SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m{i}, coalesce(nullif(quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25), 0), 1) AS s{i}"
    for i, c in enumerate(ft.FEATURES)) + " FROM e WHERE split = 'train')\nSELECT row_key, split, round(ln(1 + price_usd), 6) AS label, " + ", ".join(
    f"round((CAST({c} AS DOUBLE) - m{i}) / s{i}, 4) AS x{i}" for i, c in enumerate(ft.FEATURES)) + " FROM e, q"


def _kinds(spark, sf):
    frame = view(spark, sf, "listings")
    columns, head = pf.shape(frame)
    numeric, _ = pf.column_kinds(frame)
    kinds = columns.select("position", "column", F.when(F.col("column").isin(numeric), "numeric").otherwise("text").alias("kind"), "rows")
    return kinds.crossJoin(head.agg(F.count("*").alias("head_rows")))


ENTRIES = {
    "unified_files": (_unified_files, with_views(_ALL_SQL, "raw_listings")),
    "unified_files_some_missing": (_some_missing, with_views(f", u AS ({_source_sql('usa')} UNION ALL {_source_sql('india_rent')}) SELECT country, city, count(*) AS n FROM u GROUP BY ALL", "raw_listings")),
    "unified_run": (_unified_run, with_views(_RUN_SQL, "raw_listings")),
    "first_rows_of_files": (_capped, with_views("""SELECT ['first', 'second', 'number_2'][1 + row_key % 3] AS place, row_key, city_raw, rooms_raw FROM raw_listings
        QUALIFY row_number() OVER (PARTITION BY row_key % 3 ORDER BY row_key) <= 20""", "raw_listings")),
    "written_listings": (_written("parquet"), with_views(f"SELECT {_COLUMNS} FROM listings", "listings")),
    "written_listings_csv": (_written("csv"), with_views(f"SELECT * REPLACE (nullif(furnishing_status, '') AS furnishing_status) FROM (SELECT {_COLUMNS} FROM listings)", "listings")),
    "written_statistics": (_written_stats, with_views(f", m AS ({_MISSING}) SELECT \"column\", missing, round(missing * 100::DOUBLE / n, 4) AS missing_pct FROM m WHERE missing > 0", "raw_listings")),
    "profile_run": (_profiled, with_views(", k AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) FILTER (WHERE {c} IS NULL) AS missing, CAST(0 AS BIGINT) AS left_missing, '{kind}' AS kind FROM raw_listings"
        for c, kind in (("city_raw", "text"), ("rooms_raw", "text"), ("sqft_raw", "numeric"), ("parking_raw", "text"), ("year_raw", "numeric"), ("furnishing_raw", "text"))) + ") SELECT * FROM k WHERE missing * 2 <= \"rows\"", "raw_listings")),  # sparse columns are dropped
    "column_kinds": (_kinds, with_views("""SELECT CAST(column_index + 1 AS INT) AS position, column_name AS "column", CASE WHEN column_name IN ('country', 'city', 'furnishing_status') THEN 'text' ELSE 'numeric' END AS kind,
        (SELECT count(*) FROM listings) AS "rows", CAST(5 AS BIGINT) AS head_rows
        FROM (SELECT unnest(['row_key', 'country', 'city', 'rooms', 'area_sqm', 'balcony', 'building_age', 'furnishing_status', 'price_usd']) AS column_name, unnest(range(0, 9)) AS column_index)""", "listings")),
    "feature_vectors": (_vectors, with_views(_VECTOR_SQL, "listings")),
    "saved_feature_vectors": (_saved_vectors, with_views(_VECTOR_SQL, "listings")),
}
