"""Market rollups over the unified listing table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acreage.functions.scalars import with_price_per_sqm
from acreage.operators.quantiles import quantiles
from acreage.session import local_frame

# Edges and names of the price and area ranges.
PRICE_EDGES = (100_000, 500_000, 1_000_000, 5_000_000)
PRICE_LABELS = ("under_100k", "100k_500k", "500k_1m", "1m_5m", "over_5m")
AREA_EDGES = (50, 100, 200, 500)
AREA_LABELS = ("under_50", "50_100", "100_200", "200_500", "over_500")

# Latitude and longitude of major cities.
CITY_COORDS = {
    "Mumbai": (19.0760, 72.8777), "Delhi": (28.6139, 77.2090), "Bangalore": (12.9716, 77.5946),
    "Hyderabad": (17.3850, 78.4867), "Chennai": (13.0827, 80.2707), "Kolkata": (22.5726, 88.3639),
    "Pune": (18.5204, 73.8567), "Ahmedabad": (23.0225, 72.5714), "Jaipur": (26.9124, 75.7873),
    "Lucknow": (26.8467, 80.9462), "Surat": (21.1702, 72.8311), "Indore": (22.7196, 75.8577),
    "New York": (40.7128, -74.0060), "Los Angeles": (34.0522, -118.2437), "Chicago": (41.8781, -87.6298),
    "Houston": (29.7604, -95.3698), "Phoenix": (33.4484, -112.0740), "Philadelphia": (39.9526, -75.1652),
    "San Antonio": (29.4241, -98.4936), "San Diego": (32.7157, -117.1611), "Dallas": (32.7767, -96.7970),
    "San Jose": (37.3382, -121.8863), "Austin": (30.2672, -97.7431), "Seattle": (47.6062, -122.3321),
    "Boston": (42.3601, -71.0589), "Denver": (39.7392, -104.9903), "Miami": (25.7617, -80.1918),
    "Tokyo": (35.6762, 139.6503), "Osaka": (34.6937, 135.5023), "Yokohama": (35.4437, 139.6380),
    "Nagoya": (35.1815, 136.9066), "Sapporo": (43.0618, 141.3545), "Kobe": (34.6901, 135.1956),
    "Warsaw": (52.2297, 21.0122), "Krakow": (50.0647, 19.9450), "Wroclaw": (51.1079, 17.0385),
    "Gdansk": (54.3520, 18.6466), "Poznan": (52.4064, 16.9252), "Lodz": (51.7592, 19.4560),
    "Dhaka": (23.8103, 90.4125), "Chittagong": (22.3569, 91.7832), "Khulna": (22.8456, 89.5403),
}


def city_coords(spark) -> DataFrame:
    """The built-in city coordinates as a dimension."""
    return local_frame(spark, [(c, lat, lng) for c, (lat, lng) in CITY_COORDS.items()],
                       "city string, lat double, lng double")


def _place_rollup(df: DataFrame) -> DataFrame:
    """Sums, counts and bounds for each (country, city), from which global figures follow.

    Distinct countries and cities are then counted over this small frame, so the listings are
    neither expanded nor shuffled for the distinct counts.
    """
    aggs = [F.count("*").alias("n")]
    for column in ("price_usd", "area_sqm", "rooms"):
        aggs += [F.sum(column).alias(f"{column}_sum"), F.count(column).alias(f"{column}_n"),
                 F.min(column).alias(f"{column}_min"), F.max(column).alias(f"{column}_max")]
    return df.groupBy("country", "city").agg(*aggs)


def _mean(column: str) -> Column:
    return F.try_divide(F.sum(f"{column}_sum"), F.sum(f"{column}_n"))


def kpis(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """One row of headline numbers."""
    median = quantiles(df, {"median": ("price_usd", 0.5)}, accuracy=accuracy)["median"]
    return _place_rollup(df).agg(
        F.sum("n").alias("total_properties"),
        F.round(_mean("price_usd"), 2).alias("avg_price"),
        F.round(F.lit(median).cast("double"), 2).alias("median_price"),
        F.round(F.min("price_usd_min"), 2).alias("min_price"),
        F.round(F.max("price_usd_max"), 2).alias("max_price"),
        F.count_distinct("country").alias("total_countries"),
        F.count_distinct("city").alias("total_cities"),
        F.round(_mean("area_sqm"), 2).alias("avg_area"),
        F.round(_mean("rooms"), 2).alias("avg_rooms"),
    )


def mean_by(df: DataFrame, key: str, value: str, alias: str | None = None, places: int | None = 2) -> DataFrame:
    """Mean of a column for each key; rows without a key are left out."""
    mean = F.avg(value)
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg((mean if places is None else F.round(mean, places)).alias(alias or f"avg_{value}")))


def value_counts(df: DataFrame, column: str, by: str = "count") -> DataFrame:
    """Rows for each value, the most frequent first or in value order; null is left out."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(column) if by == "value" else counts.orderBy(F.desc("n"), column)


def price_per_sqm_by_country(df: DataFrame) -> DataFrame:
    """Mean of the ratios, not the ratio of the sums."""
    return mean_by(with_price_per_sqm(df), "country", "price_per_sqm")


def _placed(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["city", "country"])


def city_stats(df: DataFrame) -> DataFrame:
    return _placed(df).groupBy("city", "country").agg(
        F.avg("price_usd").alias("avg_price"), F.count("price_usd").alias("n"),
        F.avg("area_sqm").alias("avg_area"), F.avg("rooms").alias("avg_rooms"))


def top_cities(df: DataFrame, n: int = 20) -> DataFrame:
    """The cities with most listings; ties keep the order of city and country."""
    return city_stats(df).orderBy(F.desc("n"), "city", "country").limit(n)


def range_counts(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Rows in each half-open range, empty ranges shown as 0. One scan, one aggregate row."""
    lows, highs = [None, *edges], [*edges, None]
    tests = []
    for lo, hi in zip(lows, highs):
        test = F.col(column).isNotNull()
        test = test & (F.col(column) >= lo) if lo is not None else test
        tests.append(test & (F.col(column) < hi) if hi is not None else test)
    wide = df.agg(*[F.count_if(t).alias(label) for t, label in zip(tests, labels)])
    return wide.unpivot([], list(labels), "range", "n")


def price_ranges(df: DataFrame) -> DataFrame:
    return range_counts(df, "price_usd", PRICE_EDGES, PRICE_LABELS)


def area_ranges(df: DataFrame) -> DataFrame:
    return range_counts(df, "area_sqm", AREA_EDGES, AREA_LABELS)


def city_heatmap(df: DataFrame, coords: DataFrame, by_country: bool = False) -> DataFrame:
    """City averages with coordinates; cities without coordinates are dropped.

    The listing count is by city name alone, so a name in two countries shows the combined count
    in both rows; ``by_country`` counts them apart. One aggregation of the listings feeds both.
    """
    stats = df.filter(F.col("city").isNotNull()).groupBy("city", "country").agg(
        F.avg("price_usd").alias("avg_price"), F.avg("area_sqm").alias("avg_area"),
        F.avg("rooms").alias("avg_rooms"), F.count("*").alias("property_count"))
    if not by_country:
        same_name = Window.partitionBy("city")  # the countries that share a city name
        stats = stats.withColumn("property_count", F.sum("property_count").over(same_name))
    return (stats.filter(F.col("country").isNotNull()).join(coords, "city")
            .select("city", "country", "lat", "lng", F.round("avg_price", 0).alias("avg_price"),
                    F.round("avg_area", 1).alias("avg_area"), F.round("avg_rooms", 1).alias("avg_rooms"),
                    "property_count"))


def cities_with_coords(df: DataFrame, coords: DataFrame) -> DataFrame:
    """Every listed city that has coordinates, once."""
    return df.select("city", "country").dropna().distinct().join(coords, "city").select("city", "country", "lat", "lng")


def cities_by_country(df: DataFrame) -> DataFrame:
    """Sorted distinct (country, city) rows behind the drop-downs."""
    return _placed(df).select("country", "city").distinct().orderBy("country", "city")


def city_lists(df: DataFrame) -> DataFrame:
    """The drop-down as one array for each country; the distinct cities of a country are a short list."""
    return _placed(df).select("country", "city").distinct().groupBy("country").agg(
        F.sort_array(F.collect_list("city")).alias("cities"))


def _country_rollup(df: DataFrame) -> DataFrame:
    return df.filter(F.col("country").isNotNull()).groupBy("country").agg(
        F.round(F.avg("price_usd"), 2).alias("avg_price"), F.count("*").alias("n"))


def extremes(df: DataFrame) -> DataFrame:
    """Dearest and cheapest country by mean price, and the country with most listings.

    Ties go to the alphabetically first country.
    """
    rollup = _country_rollup(df).filter(F.col("avg_price").isNotNull())
    first_dear = F.min(F.struct((-F.col("avg_price")).alias("k"), "country", "avg_price"))
    first_cheap = F.min(F.struct(F.col("avg_price").alias("k"), "country", "avg_price"))
    first_most = F.min(F.struct((-F.col("n")).alias("k"), "country", "n"))
    picked = rollup.agg(first_dear.alias("d"), first_cheap.alias("c"), first_most.alias("m"))
    return picked.select(
        F.col("d.country").alias("most_expensive_country"), F.col("d.avg_price").alias("most_expensive_avg"),
        F.col("c.country").alias("cheapest_country"), F.col("c.avg_price").alias("cheapest_avg"),
        F.col("m.country").alias("most_listings_country"), F.col("m.n").alias("most_listings"))


def market_insights(df: DataFrame) -> DataFrame:
    """Six sentences about the market, numbered, built from one rollup by country."""
    by_country = df.groupBy("country").agg(
        F.count("*").alias("n"), F.sum("price_usd").alias("price_sum"), F.count("price_usd").alias("price_n"),
        F.sum("area_sqm").alias("area_sum"), F.count("area_sqm").alias("area_n"),
        F.sum("rooms").alias("rooms_sum"), F.count("rooms").alias("rooms_n"))
    named = by_country.withColumn("avg_price", F.when(F.col("country").isNotNull(),
                                                      F.round(F.try_divide("price_sum", "price_n"), 2)))
    known = F.col("country").isNotNull()
    priced = F.col("avg_price").isNotNull()
    one = named.agg(
        F.sum("n").alias("total"), F.count_if(known).alias("countries"),
        (F.sum("price_sum") / F.sum("price_n")).alias("avg_price"),
        (F.sum("area_sum") / F.sum("area_n")).alias("avg_area"),
        (F.sum("rooms_sum") / F.sum("rooms_n")).alias("avg_rooms"),
        F.min(F.when(priced, F.struct((-F.col("avg_price")).alias("k"), "country", "avg_price"))).alias("dear"),
        F.min(F.when(priced, F.struct(F.col("avg_price").alias("k"), "country", "avg_price"))).alias("cheap"),
        F.min(F.when(known, F.struct((-F.col("n")).alias("k"), "country", "n"))).alias("most"))
    lines = F.array(
        F.concat(F.lit("Dataset contains "), F.format_number("total", 0), F.lit(" properties across "),
                 F.col("countries").cast("string"), F.lit(" countries")),
        F.concat(F.lit("Average property price is $"), F.format_number("avg_price", 0), F.lit(" USD")),
        F.concat(F.lit("Most expensive market: "), F.col("dear.country"), F.lit(" ($"),
                 F.format_number("dear.avg_price", 0), F.lit(" avg)")),
        F.concat(F.lit("Most affordable market: "), F.col("cheap.country"), F.lit(" ($"),
                 F.format_number("cheap.avg_price", 0), F.lit(" avg)")),
        F.concat(F.col("most.country"), F.lit(" has the most listings ("), F.format_number("most.n", 0),
                 F.lit(" properties)")),
        F.concat(F.lit("Average property size is "), F.format_number("avg_area", 0), F.lit(" sqm with "),
                 F.format_number("avg_rooms", 1), F.lit(" rooms")))
    return one.select(F.posexplode(lines).alias("line", "insight"))


def summary(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """One row describing the unified table."""
    median = quantiles(df, {"median": ("price_usd", 0.5)}, accuracy=accuracy)["median"]
    aggs = [F.sum("n").alias("total_records"), F.count_distinct("country").alias("countries"),
            F.count_distinct("city").alias("cities"), F.lit(median).cast("double").alias("price_median")]
    for column, name in (("price_usd", "price"), ("rooms", "rooms"), ("area_sqm", "area")):
        aggs += [_mean(column).alias(f"{name}_mean"), F.min(f"{column}_min").alias(f"{name}_min"),
                 F.max(f"{column}_max").alias(f"{name}_max")]
    return _place_rollup(df).agg(*aggs)


def place_intensity(df: DataFrame, full_at: float = 50_000.0) -> DataFrame:
    """Price for one area unit of each place and its share of the full heat."""
    places = _placed(df).groupBy("city", "country").agg(
        F.avg("price_usd").alias("price_usd"), F.avg("area_sqm").alias("area_sqm"), F.count("*").alias("property_count"))
    price = F.col("price_usd") / F.greatest(F.col("area_sqm"), F.lit(1.0))
    return places.select("city", "country", price.alias("price_per_area"),
                         F.least(F.lit(1.0), price / full_at).alias("intensity"), "property_count")


def coverage(city_table: DataFrame, country_table: DataFrame) -> DataFrame:
    """How many countries and cities a fitted model knows."""
    countries = country_table.agg(F.count_distinct("country").alias("countries"))
    return countries.withColumn("cities", city_table.agg(F.count_distinct("city")).scalar())
