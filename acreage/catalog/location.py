"""Places scored from nearby points of interest, projects and city records."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreage.functions.scalars import round_out
from acreage.operators import location as lo
from acreage.operators.market import city_coords, place_intensity
from acreage.plans.views import view, with_views
from acreage.session import scratch_path, stored


def _views(spark, sf, *names):
    return [view(spark, sf, n) for n in names]


def _km(a: str, b: str) -> str:
    return (f"(2 * 6371.0::DOUBLE * asin(sqrt(least(1, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * "
            f"cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2)))))")


_PAIRS = f""", pairs AS (SELECT p.point_id, p.city, q.poi_id, q.poi_type, {_km('p', 'q')} AS km FROM points p, pois q),
near AS (SELECT point_id, poi_type, poi_id, km FROM pairs WHERE km <= 10)
"""
_CONSIDERED = _PAIRS.rstrip() + f""",
far AS (SELECT p.point_id, q.poi_type, q.poi_id, {_km('p', 'q')} AS km FROM points p JOIN pois q ON p.city = q.city
        WHERE p.point_id NOT IN (SELECT point_id FROM near)),
seen AS (SELECT * FROM near UNION ALL SELECT * FROM far),
wide AS (SELECT point_id, {', '.join(f"min(km) FILTER (WHERE poi_type = '{t}') AS {t}_km" for t in lo.POI_TYPES)}, count(*) AS poi_count
         FROM seen GROUP BY point_id)
"""
_TYPES = ", ".join(f"round({t}_km, 6) AS {t}_km" for t in lo.POI_TYPES)
_PROXIMITY = "(" + " + ".join(f"{w}::DOUBLE * greatest(0, least(100, coalesce((1 - {t}_km / 10) * 100, 0)))"
                              for t, w in lo.PROXIMITY_WEIGHTS.items()) + ")"
_RATING = "CASE WHEN {x} >= 80 THEN 'Excellent' WHEN {x} >= 60 THEN 'Good' WHEN {x} >= 40 THEN 'Average' ELSE 'Poor' END"
_DEMAND_FIELDS = ", ".join(f"CASE WHEN m.city IS NULL THEN {v} ELSE coalesce(m.{c}, 0) END AS {c}" for c, v in lo.DEMAND_DEFAULTS.items())
_DEMAND = f""", f AS (SELECT p.point_id, p.city, {_DEMAND_FIELDS} FROM points p LEFT JOIN demand m ON p.city = m.city)"""


def _score(weights) -> str:
    return "(" + " + ".join(f"{w}::DOUBLE * greatest(0, least(100, {c} * 100::DOUBLE / {full}))" for c, (w, full) in weights.items()) + ")"


_SUPPLY = _DEMAND + f""", g AS (SELECT *, {_score(lo.DEMAND_WEIGHTS)} AS a, {_score(lo.SUPPLY_WEIGHTS)} AS b FROM f),
ds AS (SELECT point_id, a AS demand_score, b AS supply_score, CASE WHEN b = 0 THEN NULL ELSE a / b END AS demand_supply_ratio FROM g)"""
_SAFE = """, sf AS (SELECT p.point_id, p.city, coalesce(crime_index, 50) AS crime_index, coalesce(traffic_index, 50) AS traffic_index,
    coalesce(aqi, 100) AS aqi, coalesce(green_space_score, 50) AS green_space_score, coalesce(noise_level, 50) AS noise_level
    FROM points p LEFT JOIN safety s ON p.city = s.city)"""
_C = "greatest(0, least(100, {}))"
_INDICES = f"""0.7::DOUBLE * {_C.format('100 - crime_index')} + 0.3::DOUBLE * {_C.format('100 - traffic_index')} AS safety_index,
    0.25::DOUBLE * {_C.format('100 - crime_index')} + 0.2::DOUBLE * {_C.format('100 - traffic_index')}
    + 0.25::DOUBLE * {_C.format('100 - aqi / 3')} + 0.15::DOUBLE * {_C.format('green_space_score')}
    + 0.15::DOUBLE * {_C.format('100 - noise_level')} AS livability_index"""
_BUILT = f""", pr AS (SELECT p.point_id, j.project_id, j.weight, {_km('p', 'j')} AS km FROM points p JOIN projects j ON p.city = j.city),
nb AS (SELECT point_id, sum(weight * exp(-km / 5)) AS felt, count(*) AS n FROM pr WHERE km <= 10 GROUP BY point_id),
tot AS (SELECT city, count(*) AS n FROM projects GROUP BY city),
inf AS (SELECT p.point_id, least(100, coalesce(felt, 0) * 5) AS infrastructure_score, coalesce(nb.n, 0) AS nearby_projects,
    coalesce(tot.n, 0) AS total_projects FROM points p LEFT JOIN nb USING (point_id) LEFT JOIN tot ON tot.city = p.city)"""
_MARKERS = """, m AS (SELECT city, country, avg(price_usd) / greatest(avg(area_sqm), 1) AS x, count(*) AS n FROM listings GROUP BY city, country)
SELECT city, country, lat, lng, round(x, 0) AS price_per_area, n AS property_count, round(least(1, x / 50000), 6) AS intensity,
    CASE WHEN least(1, x / 50000) < 1::DOUBLE / 3 THEN '#0000ff' WHEN least(1, x / 50000) < 2::DOUBLE / 3 THEN '#ffff00' ELSE '#ff0000' END AS colour
FROM m JOIN coords USING (city)"""
_SURFACE = """, m AS (SELECT city, avg(price_usd) / greatest(avg(area_sqm), 1) AS x FROM listings GROUP BY city, country),
s AS (SELECT CAST(floor(lat / 0.25::DOUBLE) AS BIGINT) AS y, CAST(floor(lng / 0.25::DOUBLE) AS BIGINT) AS x, sum(m.x) AS v, count(*) AS w
      FROM m JOIN coords USING (city) GROUP BY 1, 2),
k AS (SELECT y + dy AS cy, s.x + dx AS cx, sum(v * exp(-(dy * dy + dx * dx) * 0.0625::DOUBLE / 0.5::DOUBLE))
             / sum(w * exp(-(dy * dy + dx * dx) * 0.0625::DOUBLE / 0.5::DOUBLE)) AS price
      FROM s, range(-4, 5) a(dy), range(-4, 5) b(dx) GROUP BY 1, 2)
SELECT (cy + 0.5::DOUBLE) * 0.25::DOUBLE AS lat, (cx + 0.5::DOUBLE) * 0.25::DOUBLE AS lng, round(price, 4) AS price,
       round(price / (SELECT max(price) FROM k), 6) AS intensity FROM k"""
_FEATURES = _CONSIDERED.rstrip() + _SUPPLY + _SAFE + _BUILT + f""",
allf AS (SELECT p.point_id, p.city, {_INDICES}, demand_score, supply_score, demand_supply_ratio,
    {', '.join(f'{t}_km' for t in lo.POI_TYPES)}, coalesce(poi_count, 0) AS poi_count, {_PROXIMITY} AS proximity_score,
    infrastructure_score, nearby_projects
    FROM points p JOIN sf ON sf.point_id = p.point_id JOIN ds ON ds.point_id = p.point_id JOIN inf ON inf.point_id = p.point_id
    LEFT JOIN wide ON wide.point_id = p.point_id)
"""
_REAL = ("safety_index", "livability_index", "demand_score", "supply_score", "demand_supply_ratio", "proximity_score",
         "infrastructure_score", *[f"{t}_km" for t in lo.POI_TYPES])
_FEATURE_VIEWS = ("points", "pois", "projects", "safety", "demand")


def _features(spark, sf, points=None):
    own, pois, projects, safety, demand = _views(spark, sf, *_FEATURE_VIEWS)
    return lo.location_features(own if points is None else points, pois, projects, safety, demand)


def _shown(df):
    return round_out(df.drop("lat", "lng"), {c: 5 for c in _REAL})


def _refreshed(spark, sf):
    """Features stored for the points of some cities; the rest is computed."""
    points = view(spark, sf, "points")
    stored = _features(spark, sf, points.join(view(spark, sf, "safety").select("city"), "city", "left_semi"))
    return _shown(lo.refresh_features(points, stored, lambda fresh: _features(spark, sf, fresh)))


def _changed(spark, sf):
    """Features stored before some points of interest, projects and a city's record changed; only the points that can see a change are computed again."""
    points, pois, projects, safety, demand = _views(spark, sf, *_FEATURE_VIEWS)
    old = (pois.filter("poi_id % 7 > 0"), projects.withColumn("weight", F.when(F.col("project_id") == 1, 99.0).otherwise(F.col("weight"))),
           safety.withColumn("aqi", F.when(F.col("city") == "JAPAN", 1.0).otherwise(F.col("aqi"))), demand)
    kept = stored(lo.location_features(points, *old).join(lo.feature_signatures(points, *old), "point_id"), "features")
    now = stored(lo.feature_signatures(points, pois, projects, safety, demand), "signatures")
    return _shown(lo.refresh_changed(points, kept, now, lambda stale: _features(spark, sf, stale)).drop("signature"))


_FEATURE_SQL = with_views(_FEATURES + "SELECT point_id, city, " + ", ".join(f"round({c}, 5) AS {c}" for c in _REAL)
                          + ", poi_count, nearby_projects FROM allf", *_FEATURE_VIEWS)
_IMPACT = " UNION ALL ".join(
    f"SELECT point_id, '{c}' AS component, round({c}, 4) AS score, round({w}::DOUBLE * ({c} - 50) / 50 * 100, 4) AS impact_pct, "
    f"round(250000 * ({w}::DOUBLE * ({c} - 50) / 50), 2) AS price_delta FROM allf" for c, w in lo.IMPACT_WEIGHTS.items())

ENTRIES = {
    "poi_within": (
        lambda s, d: round_out(lo.poi_within(*_views(s, d, "points", "pois")).select("point_id", "poi_id", "poi_type", "distance_km"),
                               {"distance_km": 6}),
        with_views(_PAIRS + "SELECT point_id, poi_id, poi_type, round(km, 6) AS distance_km FROM near", "points", "pois")),
    "nearest_poi": (
        lambda s, d: round_out(lo.nearest_poi(*_views(s, d, "points", "pois")).drop("lat", "lng"), {f"{t}_km": 6 for t in lo.POI_TYPES}),
        with_views(_CONSIDERED + f"SELECT p.point_id, p.city, {_TYPES}, coalesce(poi_count, 0) AS poi_count FROM points p "
                   "LEFT JOIN wide USING (point_id)", "points", "pois")),
    "proximity": (
        lambda s, d: round_out(lo.proximity(*_views(s, d, "points", "pois")).select("point_id", "proximity_score", "proximity_rating"),
                               {"proximity_score": 5}),
        with_views(_CONSIDERED.rstrip() + f", z AS (SELECT p.point_id, {_PROXIMITY} AS x FROM points p LEFT JOIN wide USING (point_id)) "
                   f"SELECT point_id, round(x, 5) AS proximity_score, {_RATING.format(x='x')} AS proximity_rating FROM z", "points", "pois")),
    "demand_lookup": (
        lambda s, d: lo.demand_lookup(*_views(s, d, "points", "demand")).drop("lat", "lng"),
        with_views(_DEMAND + " SELECT * FROM f", "points", "demand")),
    "demand_supply": (
        lambda s, d: round_out(lo.demand_supply(*_views(s, d, "points", "demand")).select(
            "point_id", "demand_score", "supply_score", "demand_supply_ratio", "market_status"),
            {"demand_score": 4, "supply_score": 4, "demand_supply_ratio": 4}),
        with_views(_SUPPLY + """ SELECT point_id, round(demand_score, 4) AS demand_score, round(supply_score, 4) AS supply_score,
            round(demand_supply_ratio, 4) AS demand_supply_ratio, CASE WHEN demand_supply_ratio IS NULL OR demand_supply_ratio > 1.2::DOUBLE
            THEN 'seller' WHEN demand_supply_ratio < 0.8::DOUBLE THEN 'buyer' ELSE 'balanced' END AS market_status FROM ds""",
                   "points", "demand")),
    "nearby_projects": (
        lambda s, d: round_out(lo.nearby_projects(*_views(s, d, "points", "projects")).select("point_id", "project_id", "weight", "distance_km"),
                               {"distance_km": 6}),
        with_views(_BUILT + " SELECT point_id, project_id, weight, round(km, 6) AS distance_km FROM pr WHERE km <= 10", "points", "projects")),
    "infrastructure": (
        lambda s, d: round_out(lo.infrastructure(*_views(s, d, "points", "projects")), {"infrastructure_score": 5}),
        with_views(_BUILT + """ SELECT point_id, round(infrastructure_score, 5) AS infrastructure_score, nearby_projects, total_projects,
            CASE WHEN infrastructure_score >= 60 THEN 'high' WHEN infrastructure_score >= 30 THEN 'medium' ELSE 'low' END
            AS appreciation_potential FROM inf""", "points", "projects")),
    "safety_lookup": (
        lambda s, d: lo.safety_lookup(*_views(s, d, "points", "safety")).drop("lat", "lng"),
        with_views(_SAFE + " SELECT * FROM sf", "points", "safety")),
    "safety_livability": (
        lambda s, d: round_out(lo.safety_livability(*_views(s, d, "points", "safety")).select(
            "point_id", "safety_index", "livability_index", "safety_rating", "livability_rating"),
            {"safety_index": 4, "livability_index": 4}),
        with_views(_SAFE + f""", z AS (SELECT point_id, {_INDICES} FROM sf) SELECT point_id, round(safety_index, 4) AS safety_index,
            round(livability_index, 4) AS livability_index, {_RATING.format(x='safety_index')} AS safety_rating,
            {_RATING.format(x='livability_index')} AS livability_rating FROM z""", "points", "safety")),
    "location_features": (lambda s, d: _shown(_features(s, d)), _FEATURE_SQL),
    "refresh_features": (_refreshed, _FEATURE_SQL),
    "refresh_changed": (_changed, _FEATURE_SQL),
    "refresh_all": (
        lambda s, d: lo.refresh_all(view(s, d, "points"), lambda p: _features(s, d, p), scratch_path(s, "features")),
        with_views("SELECT count(*) AS refreshed FROM points", "points")),
    "location_impact": (
        lambda s, d: round_out(lo.location_impact(_features(s, d), 250000.0), {"score": 4, "impact_pct": 4, "price_delta": 2}),
        with_views(_FEATURES + _IMPACT, *_FEATURE_VIEWS)),
    "city_markers": (
        lambda s, d: round_out(lo.city_markers(*_views(s, d, "listings", "coords")), {"intensity": 6}),
        with_views(_MARKERS, "listings", "coords")),
    "cities_with_coords_or_default": (
        lambda s, d: lo.coords_or_default(*_views(s, d, "listings", "coords"), city_coords(s), country="MIDDLE EAST").select("city", "lat", "lng"),
        with_views("SELECT city, lat, lng FROM coords", "coords")),
    "price_surface": (
        lambda s, d: round_out(lo.price_surface(place_intensity(view(s, d, "listings")).join(view(s, d, "coords"), "city"), limit=None),
                               {"price": 4, "intensity": 6}),
        with_views(_SURFACE, "listings", "coords")),
    "price_surface_top": (
        lambda s, d: round_out(lo.price_surface(place_intensity(view(s, d, "listings")).join(view(s, d, "coords"), "city"), limit=500), {"price": 4, "intensity": 6}),
        with_views(_SURFACE + " ORDER BY round(k.price / (SELECT max(price) FROM k), 9) DESC, lat, lng LIMIT 500", "listings", "coords")),
}
