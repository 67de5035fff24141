"""Made-up listings for catalogue cities a country has no data for."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.functions.scalars import unit_hash
from acreage.operators.combine import union_all
from acreage.session import local_frame
from acreage.sources.specs import LISTING_SCHEMA

# Cities each country should cover.
TOP_CITIES = {
    "Bangladesh": ["Dhaka", "Chittagong", "Khulna", "Rajshahi", "Sylhet",
                   "Rangpur", "Comilla", "Gazipur", "Narayanganj", "Mymensingh",
                   "Barisal", "Bogra", "Cox's Bazar", "Jessore", "Dinajpur",
                   "Brahmanbaria", "Savar", "Tongi", "Narsingdi", "Tangail"],
    "India": ["Mumbai", "Delhi", "Bangalore", "Hyderabad", "Chennai",
              "Kolkata", "Pune", "Ahmedabad", "Jaipur", "Lucknow",
              "Surat", "Kanpur", "Nagpur", "Indore", "Thane",
              "Bhopal", "Visakhapatnam", "Patna", "Vadodara", "Ghaziabad"],
    "Japan": ["Tokyo", "Osaka", "Yokohama", "Nagoya", "Sapporo",
              "Kobe", "Kyoto", "Fukuoka", "Kawasaki", "Saitama",
              "Hiroshima", "Sendai", "Chiba", "Kitakyushu", "Sakai",
              "Niigata", "Hamamatsu", "Kumamoto", "Sagamihara", "Okayama"],
    "Poland": ["Warsaw", "Krakow", "Lodz", "Wroclaw", "Poznan",
               "Gdansk", "Szczecin", "Bydgoszcz", "Lublin", "Katowice",
               "Bialystok", "Gdynia", "Czestochowa", "Radom", "Sosnowiec",
               "Torun", "Kielce", "Rzeszow", "Gliwice", "Zabrze"],
    "USA": ["New York", "Los Angeles", "Chicago", "Houston", "Phoenix",
            "Philadelphia", "San Antonio", "San Diego", "Dallas", "San Jose",
            "Austin", "Jacksonville", "Fort Worth", "Columbus", "Charlotte",
            "Seattle", "Denver", "Washington", "Boston", "Nashville"],
}

# Rows for each city, floors, balcony share and furnishing states of made-up listings.
ROWS_PER_CITY = 100
MIN_ROOMS, MIN_AREA, MIN_AGE, MIN_PRICE = 1, 20, 0, 1000
BALCONY_SHARE = 0.7
FURNISHING_STATES = ("Furnished", "Semi-Furnished", "Unfurnished")


def city_catalogue(spark) -> DataFrame:
    """The built-in target cities as a dimension."""
    return local_frame(spark, [(c, city) for c, cities in TOP_CITIES.items() for city in cities],
                       "country string, city string")


def country_moments(df: DataFrame) -> DataFrame:
    """Mean and sample deviation of rooms, area, age and price for each country."""
    aggs = []
    for column, name in (("rooms", "rooms"), ("area_sqm", "area"), ("building_age", "age"), ("price_usd", "price")):
        aggs += [F.avg(column).alias(f"{name}_mean"), F.stddev_samp(column).alias(f"{name}_std")]
    return df.filter(F.col("country").isNotNull()).groupBy("country").agg(*aggs)


def missing_cities(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue cities, of countries that have data, without a listing; names match exactly."""
    present = df.select("country", "city").distinct()
    return (catalogue.join(present.select("country").distinct(), "country", "left_semi")
            .join(present, ["country", "city"], "left_anti"))


def _normal(mean: Column, std: Column, name: str, seed: int) -> Column:
    """A normal draw fixed by the row's city, number and field. A missing deviation counts as 0."""
    u1, u2 = (unit_hash(["country", "city", "_i", F.lit(f"{name}.{k}")], seed) for k in (1, 2))
    z = F.sqrt(-2 * F.log(1 - u1)) * F.cos(2 * math.pi * u2)
    return mean + F.coalesce(std, F.lit(0.0)) * z


def synthesise(moments: DataFrame, cities: DataFrame, n: int = ROWS_PER_CITY, seed: int = 42) -> DataFrame:
    """``n`` rows for each missing city, drawn from the moments of its country.

    Every draw is a hash of its place in the table, so a retried task makes the same rows.
    """
    rows = cities.join(moments, "country").withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(n))))

    def normal(name: str) -> Column:
        return _normal(F.col(f"{name}_mean"), F.col(f"{name}_std"), name, seed)

    def uniform(name: str) -> Column:
        return unit_hash(["country", "city", "_i", F.lit(name)], seed)

    states = F.array(*[F.lit(s) for s in FURNISHING_STATES])
    pick = F.least(F.floor(uniform("furnishing") * len(FURNISHING_STATES)), F.lit(len(FURNISHING_STATES) - 1))
    made = {
        "country": F.col("country"),
        "city": F.col("city"),
        "rooms": F.greatest(F.lit(MIN_ROOMS), normal("rooms").cast("long")),
        "area_sqm": F.greatest(F.lit(float(MIN_AREA)), normal("area")),
        "balcony": F.when(uniform("balcony") < BALCONY_SHARE, 1).otherwise(0),
        "building_age": F.greatest(F.lit(MIN_AGE), normal("age").cast("long")),
        "furnishing_status": F.get(states, pick.cast("int")),
        "price_usd": F.greatest(F.lit(float(MIN_PRICE)), normal("price")),
    }
    return rows.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in LISTING_SCHEMA.fields])


def add_synthetic(df: DataFrame, catalogue: DataFrame, n: int = ROWS_PER_CITY, seed: int = 42) -> DataFrame:
    """The listings and the made-up rows of every country with data, in one job."""
    return union_all([df, synthesise(country_moments(df), missing_cities(df, catalogue), n, seed)])
