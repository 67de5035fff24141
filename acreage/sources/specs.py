"""Listing sources: how each file shape maps to the unified table.

A spec is data: one expression maker for each unified column. ``standardise`` is the only
code that applies it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acreage.functions import scalars as sc

LISTING_SCHEMA = T.StructType([
    T.StructField("country", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("rooms", T.DoubleType()),
    T.StructField("area_sqm", T.DoubleType()),
    T.StructField("balcony", T.IntegerType()),
    T.StructField("building_age", T.DoubleType()),
    T.StructField("furnishing_status", T.StringType()),
    T.StructField("price_usd", T.DoubleType()),
])

Maker = Callable[[DataFrame], Column]


def constant(value) -> Maker:
    return lambda df: F.lit(value)


def text(name: str, default: str | None = None, fallback: str | None = None) -> Maker:
    """A text column; when absent, another column, else a constant."""
    def make(df: DataFrame) -> Column:
        if name not in df.columns and fallback is not None:
            return sc.col_or(df, fallback, default)
        return sc.col_or(df, name, default)
    return make


def number(name: str, default: float | None = None, then: Callable[[Column], Column] = lambda c: c) -> Maker:
    """A lenient number, or the default when the column is absent, put through ``then``."""
    return lambda df: then(sc.num(sc.col_or(df, name, default)))


def flag(name: str, rule: Callable[[Column], Column]) -> Maker:
    """A 0/1 flag; 0 when the column is absent."""
    return lambda df: rule(sc.quoted(name)) if name in df.columns else F.lit(0)


def usd(currency: str) -> Callable[[Column], Column]:
    return lambda c: sc.to_usd(c, currency)


@dataclass(frozen=True)
class ListingSpec:
    country: str
    columns: Mapping[str, Maker]
    required: tuple[str, ...] = ("price_usd", "rooms", "area_sqm")


BANGLADESH = ListingSpec("Bangladesh", {
    "city": text("City"),
    "rooms": number("Bedrooms"),
    "area_sqm": number("Floor_area", then=sc.sqft_to_sqm),
    "balcony": constant(0),
    "building_age": constant(5),
    "furnishing_status": constant("Unknown"),
    "price_usd": lambda df: sc.to_usd(sc.money(sc.quoted("Price_in_taka")), "BDT"),
})

INDIA_BANGALORE = ListingSpec("India", {
    "city": constant("Bangalore"),
    "rooms": number("No. of Bedrooms"),
    "area_sqm": number("Area", then=sc.sqft_to_sqm),
    "balcony": flag("Balcony", sc.flag_gt0),
    "building_age": constant(10),
    "furnishing_status": text("Furnishing", "Unknown"),
    "price_usd": number("Price", then=usd("INR")),
})

INDIA_DELHI = ListingSpec("India", {
    "city": constant("Delhi"),
    "rooms": number("Bedrooms"),
    "area_sqm": number("area", then=sc.sqft_to_sqm),
    "balcony": flag("Balcony", sc.flag_gt0),
    "building_age": constant(10),
    "furnishing_status": text("Furnished_status", "Unknown"),
    "price_usd": number("price", then=usd("INR")),
})

INDIA_RENT = ListingSpec("India", {
    "city": text("City"),
    "rooms": number("BHK"),
    "area_sqm": number("Size", then=sc.sqft_to_sqm),
    "balcony": constant(0),
    "building_age": constant(10),
    "furnishing_status": text("Furnishing Status"),
    "price_usd": number("Rent", then=lambda c: sc.to_usd(sc.rent_to_price(c), "INR")),
})

INDIA_PRICE = ListingSpec("India", {
    "city": constant("India"),
    "rooms": number("number of bedrooms", 2),
    "area_sqm": number("living area", 1000, then=sc.sqft_to_sqm),
    "balcony": constant(0),
    "building_age": number("Built Year", 2015, then=sc.age),
    "furnishing_status": constant("Unknown"),
    "price_usd": number("Price", then=usd("INR")),
})

POLAND = ListingSpec("Poland", {
    "city": text("city"),
    "rooms": number("rooms"),
    "area_sqm": number("squareMeters"),
    "balcony": flag("hasParkingSpace", sc.flag_truthy),
    "building_age": number("buildYear", 2000, then=sc.age),
    "furnishing_status": text("condition", "Unknown"),
    "price_usd": number("price", then=usd("PLN")),
})

USA = ListingSpec("USA", {
    "city": constant("Seattle"),
    "rooms": number("bedrooms"),
    "area_sqm": number("sqft_living", then=sc.sqft_to_sqm),
    "balcony": flag("view", sc.flag_gt0),
    "building_age": number("yr_built", 1990, then=sc.age),
    "furnishing_status": constant("Unknown"),
    "price_usd": number("price", then=usd("USD")),
})

JAPAN = ListingSpec("Japan", {
    "city": text("Municipality", fallback="prefecture"),
    "rooms": constant(3),
    "area_sqm": number("Area", 70),
    "balcony": constant(1),
    "building_age": lambda df: F.coalesce(sc.age(sc.num(sc.col_or(df, "BuildingYear"))), F.lit(10.0)),
    "furnishing_status": constant("Unfurnished"),
    "price_usd": number("TradePrice", then=usd("JPY")),
}, required=("price_usd", "area_sqm"))

# The first prefectures in the order of their file numbers.
PREFECTURES = ["Hokkaido", "Aomori", "Iwate", "Miyagi", "Akita",
               "Yamagata", "Fukushima", "Ibaraki", "Tochigi", "Gunma"]


def standardise(df: DataFrame, spec: ListingSpec) -> DataFrame:
    """One source frame in the unified schema, rows without the required numbers dropped."""
    made = {"country": F.lit(spec.country), **{c: make(df) for c, make in spec.columns.items()}}
    unified = df.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in LISTING_SCHEMA.fields])
    return unified.dropna(subset=list(spec.required))
