"""Market queries over all listings, each with the same question in SQL."""

from __future__ import annotations

from acreage.operators import market as mk
from acreage.operators.combine import distinct_values
from acreage.operators.synthetic import country_moments
from acreage.plans.views import view, with_views
from acreage.functions.scalars import round_out, with_price_per_sqm


def _on(operator, **options):
    return lambda spark, sf: operator(view(spark, sf, "listings"), **options)


def _on_map(operator, **options):
    return lambda spark, sf: operator(view(spark, sf, "listings"), view(spark, sf, "coords"), **options)


def _sql(text: str, *views: str) -> str:
    return with_views(text, *(views or ("listings",)))


def _ranges(column: str, edges, labels) -> str:
    lows, highs = [None, *edges], [*edges, None]
    parts = []
    for lo, hi, label in zip(lows, highs, labels):
        tests = [f"{column} >= {lo}"] if lo is not None else []
        tests += [f"{column} < {hi}"] if hi is not None else []
        parts.append(f"SELECT '{label}' AS range, COUNT(*) FILTER (WHERE {' AND '.join(tests)}) AS n FROM listings")
    return _sql(" UNION ALL ".join(parts))


_HEATMAP = """
, s AS (SELECT city, country, avg(price_usd) p, avg(area_sqm) a, avg(rooms) r, count(*) n FROM listings GROUP BY ALL),
c AS (SELECT city, count(*) n FROM listings GROUP BY city)
SELECT city, country, lat, lng, round(p, 0) AS avg_price, round(a, 1) AS avg_area, round(r, 1) AS avg_rooms,
       {count} AS property_count
FROM s JOIN c USING (city) JOIN coords USING (city)
"""

ENTRIES = {
    "mean_price_by_country": (
        _on(mk.mean_by, key="country", value="price_usd", alias="avg_price"),
        _sql("SELECT country, round(avg(price_usd), 2) AS avg_price FROM listings GROUP BY country")),
    "kpis": (_on(mk.kpis), _sql("""
        SELECT count(*) AS total_properties, round(avg(price_usd), 2) AS avg_price,
               round(quantile_cont(price_usd, 0.5), 2) AS median_price, round(min(price_usd), 2) AS min_price,
               round(max(price_usd), 2) AS max_price, count(DISTINCT country) AS total_countries,
               count(DISTINCT city) AS total_cities, round(avg(area_sqm), 2) AS avg_area, round(avg(rooms), 2) AS avg_rooms
        FROM listings""")),
    "listing_count_by_country": (
        _on(mk.value_counts, column="country"),
        _sql("SELECT country, count(*) AS n FROM listings GROUP BY country")),
    "city_stats": (
        lambda s, d: round_out(mk.city_stats(view(s, d, "listings")), {"avg_price": 3, "avg_area": 3, "avg_rooms": 3}),
        _sql("""SELECT city, country, round(avg(price_usd), 3) AS avg_price, count(price_usd) AS n,
                round(avg(area_sqm), 3) AS avg_area, round(avg(rooms), 3) AS avg_rooms FROM listings GROUP BY city, country""")),
    "top_cities": (
        lambda s, d: round_out(mk.top_cities(view(s, d, "listings")), {"avg_price": 3, "avg_area": 3, "avg_rooms": 3}),
        _sql("""SELECT city, country, round(avg(price_usd), 3) AS avg_price, count(price_usd) AS n,
                round(avg(area_sqm), 3) AS avg_area, round(avg(rooms), 3) AS avg_rooms FROM listings GROUP BY city, country
                ORDER BY n DESC, city, country LIMIT 20""")),
    "price_per_sqm_by_country": (
        _on(mk.price_per_sqm_by_country),
        _sql("SELECT country, round(avg(price_usd / area_sqm), 2) AS avg_price_per_sqm FROM listings GROUP BY country")),
    "price_per_sqm": (
        lambda s, d: with_price_per_sqm(view(s, d, "listings")).select("row_key", "price_per_sqm"),
        _sql("SELECT row_key, price_usd / area_sqm AS price_per_sqm FROM listings")),
    "room_distribution": (
        _on(mk.value_counts, column="rooms", by="value"),
        _sql("SELECT rooms, count(*) AS n FROM listings GROUP BY rooms")),
    "furnishing_distribution": (
        _on(mk.value_counts, column="furnishing_status"),
        _sql("SELECT furnishing_status, count(*) AS n FROM listings GROUP BY furnishing_status")),
    "price_ranges": (_on(mk.price_ranges), _ranges("price_usd", mk.PRICE_EDGES, mk.PRICE_LABELS)),
    "area_ranges": (_on(mk.area_ranges), _ranges("area_sqm", mk.AREA_EDGES, mk.AREA_LABELS)),
    "city_heatmap": (_on_map(mk.city_heatmap), _sql(_HEATMAP.format(count="c.n"), "listings", "coords")),
    "city_heatmap_by_country": (_on_map(mk.city_heatmap, by_country=True),
                                _sql(_HEATMAP.format(count="s.n"), "listings", "coords")),
    "cities_with_coords": (
        _on_map(mk.cities_with_coords),
        _sql("SELECT DISTINCT city, country, lat, lng FROM listings JOIN coords USING (city)", "listings", "coords")),
    "cities_by_country": (_on(mk.cities_by_country), _sql("SELECT DISTINCT country, city FROM listings")),
    "city_lists": (
        lambda s, d: mk.city_lists(view(s, d, "listings")).selectExpr("country", "array_join(cities, ',') AS cities"),
        _sql("SELECT country, string_agg(DISTINCT city, ',' ORDER BY city) AS cities FROM listings GROUP BY country")),
    "distinct_countries": (
        lambda s, d: distinct_values(view(s, d, "listings"), "country"),
        _sql("SELECT DISTINCT country FROM listings")),
    "extremes": (_on(mk.extremes), _sql("""
        , g AS (SELECT country, round(avg(price_usd), 2) AS a, count(*) AS n FROM listings GROUP BY country)
        SELECT (SELECT country FROM g ORDER BY a DESC, country LIMIT 1) AS most_expensive_country,
               (SELECT max(a) FROM g) AS most_expensive_avg,
               (SELECT country FROM g ORDER BY a, country LIMIT 1) AS cheapest_country,
               (SELECT min(a) FROM g) AS cheapest_avg,
               (SELECT country FROM g ORDER BY n DESC, country LIMIT 1) AS most_listings_country,
               (SELECT max(n) FROM g) AS most_listings""")),
    "market_insights": (_on(mk.market_insights), _sql("""
        , g AS (SELECT country, round(avg(price_usd), 2) AS a, count(*) AS n FROM listings GROUP BY country),
        t AS (SELECT count(*) AS n, count(DISTINCT country) AS c, avg(price_usd) AS p, avg(area_sqm) AS a, avg(rooms) AS r FROM listings)
        SELECT 0 AS line, format('Dataset contains {:,} properties across {} countries', n, c) AS insight FROM t
        UNION ALL SELECT 1, format('Average property price is ${:,} USD', CAST(round_even(p, 0) AS BIGINT)) FROM t
        UNION ALL (SELECT 2, format('Most expensive market: {} (${:,} avg)', country, CAST(round_even(a, 0) AS BIGINT)) FROM g ORDER BY a DESC, country LIMIT 1)
        UNION ALL (SELECT 3, format('Most affordable market: {} (${:,} avg)', country, CAST(round_even(a, 0) AS BIGINT)) FROM g ORDER BY a, country LIMIT 1)
        UNION ALL (SELECT 4, format('{} has the most listings ({:,} properties)', country, n) FROM g ORDER BY n DESC, country LIMIT 1)
        UNION ALL SELECT 5, format('Average property size is {:,} sqm with {:.1f} rooms', CAST(round_even(a, 0) AS BIGINT), r) FROM t""")),
    "summary": (
        lambda s, d: round_out(mk.summary(view(s, d, "listings")), {c: 4 for c in (
            "price_mean", "price_median", "price_min", "price_max", "rooms_mean", "rooms_min", "rooms_max", "area_mean",
            "area_min", "area_max")}),
        _sql("""SELECT count(*) AS total_records, count(DISTINCT country) AS countries, count(DISTINCT city) AS cities,
                round(quantile_cont(price_usd, 0.5), 4) AS price_median, round(avg(price_usd), 4) AS price_mean,
                round(min(price_usd), 4) AS price_min, round(max(price_usd), 4) AS price_max, round(avg(rooms), 4) AS rooms_mean,
                round(min(rooms), 4) AS rooms_min, round(max(rooms), 4) AS rooms_max, round(avg(area_sqm), 4) AS area_mean,
                round(min(area_sqm), 4) AS area_min, round(max(area_sqm), 4) AS area_max FROM listings""")),
    "country_moments": (
        lambda s, d: round_out(country_moments(view(s, d, "listings")), {f"{n}_{k}": 3 for n in (
            "rooms", "area", "age", "price") for k in ("mean", "std")}),
        _sql("""SELECT country, round(avg(rooms), 3) AS rooms_mean, round(stddev_samp(rooms), 3) AS rooms_std,
                round(avg(area_sqm), 3) AS area_mean, round(stddev_samp(area_sqm), 3) AS area_std,
                round(avg(building_age), 3) AS age_mean, round(stddev_samp(building_age), 3) AS age_std,
                round(avg(price_usd), 3) AS price_mean, round(stddev_samp(price_usd), 3) AS price_std
                FROM listings GROUP BY country""")),
    "place_intensity": (
        lambda s, d: round_out(mk.place_intensity(view(s, d, "listings")), {"price_per_area": 3, "intensity": 6}),
        _sql(""", p AS (SELECT city, country, avg(price_usd) / greatest(avg(area_sqm), 1) AS x, count(*) AS n
                FROM listings GROUP BY city, country)
                SELECT city, country, round(x, 3) AS price_per_area, round(least(1, x / 50000), 6) AS intensity,
                       n AS property_count FROM p""")),
}
