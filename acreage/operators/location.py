"""Places: nearby points of interest, price surface, composite scores and feature vectors.

The formulas of the composite scores are this project's own; weights and full marks are
parameters with documented defaults.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acreage.functions import geo
from acreage.operators.combine import union_all
from acreage.operators.market import place_intensity
from acreage.operators.skew import salted_join
from acreage.session import durable, stored

# Point types, search radius, defaults of missing records, result limits.
POI_TYPES = ("metro", "school", "hospital", "it_park", "commercial")
RADIUS_KM = 10.0
SAFETY_DEFAULTS = {"crime_index": 50.0, "traffic_index": 50.0, "aqi": 100.0, "green_space_score": 50.0,
                   "noise_level": 50.0}
DEMAND_DEFAULTS = {"search_frequency": 500, "prediction_requests": 150, "interaction_count": 1000,
                   "active_listings": 200, "new_developments": 15}
HEAT_COLOURS = {"low": "#0000ff", "medium": "#ffff00", "high": "#ff0000"}

# This project's own weights and full marks.
PROXIMITY_WEIGHTS = {"metro": 0.3, "school": 0.2, "hospital": 0.2, "it_park": 0.15, "commercial": 0.15}
DEMAND_WEIGHTS = {"search_frequency": (0.4, 1000.0), "prediction_requests": (0.3, 300.0),
                  "interaction_count": (0.3, 2000.0)}
SUPPLY_WEIGHTS = {"active_listings": (0.7, 400.0), "new_developments": (0.3, 30.0)}
IMPACT_WEIGHTS = {"proximity_score": 0.12, "demand_score": 0.08, "infrastructure_score": 0.08,
                  "safety_index": 0.07, "livability_index": 0.05}
SITE = ("lat", "lng")

# a cell with more places is split, so many times at most
CELL_ROOM = 64
CELL_LEVELS = 10


# ---- radius search ---------------------------------------------------------------------------

def _home_cell(df: DataFrame, km: float) -> DataFrame:
    band = geo.band_of(F.col("lat"), km)
    return df.withColumn("_band", band).withColumn("_cell", geo.cell_of(F.col("lng"), F.col("_band"), km))


def _neighbour_cells(df: DataFrame, km: float) -> DataFrame:
    """One row for every grid cell a circle of the radius can touch, about nine."""
    reach = geo.longitude_reach(F.col("lat"), km)
    bands = F.sequence(geo.band_of(F.col("lat"), km) - 1, geo.band_of(F.col("lat"), km) + 1)
    spread = df.withColumn("_band", F.explode(bands))
    n = geo.cells_in_band(F.col("_band"), km)
    first = F.floor((F.col("lng") - reach + 180.0) / 360.0 * n).cast("long")
    last = F.floor((F.col("lng") + reach + 180.0) / 360.0 * n).cast("long")
    return spread.withColumn("_raw", F.explode(F.sequence(first, F.least(last, first + n - 1)))).withColumn(
        "_cell", F.pmod(F.col("_raw"), n)).drop("_raw")


def within_radius(points: DataFrame, targets: DataFrame, km: float = RADIUS_KM, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of a point and a target at most ``km`` apart, with their distance.

    An equi-join on grid cells; targets, the smaller side, are copied to the cells around them and
    the exact distance decides. Cells with very many points are salted. Both sides have lat and lng;
    ``on`` adds equality columns.
    """
    left = _home_cell(points, km)
    right = _neighbour_cells(targets.withColumnsRenamed({"lat": "_tlat", "lng": "_tlng"}).withColumns(
        {"lat": F.col("_tlat"), "lng": F.col("_tlng")}), km).drop("lat", "lng")
    pairs = salted_join(left, right, ["_band", "_cell", *on])
    distance = geo.haversine_km(F.col("lat"), F.col("lng"), F.col("_tlat"), F.col("_tlng"))
    return (pairs.withColumn("distance_km", distance).filter(F.col("distance_km") <= km)
            .drop("_band", "_cell", "_tlat", "_tlng"))


def poi_within(points: DataFrame, pois: DataFrame, km: float = RADIUS_KM) -> DataFrame:
    """Every (point, point of interest) pair within the radius."""
    return within_radius(points.select("point_id", "lat", "lng"), pois.select("poi_id", "poi_type", "lat", "lng"), km)


def _poi_places(pois: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points of interest at the very same spot as one row with their number."""
    return pois.groupBy(*keys, "poi_type", "lat", "lng").agg(F.min("poi_id").alias("poi_id"), F.count("*").alias("copies"))


def _split_cells(places: DataFrame, km: float, room: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Cells of the places of each type, and the places with their cell.

    A cell of about ``km`` with more than ``room`` places is split into four, and these again, up to ``levels`` times; so crowded spots have small cells and empty land has large ones. A cell has its
    number of points, the box of its places, one of them, and whether it is a leaf.
    """
    n = geo.cells_in_band(geo.band_of(F.col("lat"), km), km) * (1 << levels)
    fine = places.withColumns({
        "_i": F.floor(F.col("lat") / F.lit(km / geo.KM_PER_DEGREE) * (1 << levels)).cast("long"),
        "_j": F.pmod(F.floor((F.col("lng") + 180.0) / 360.0 * n).cast("long"), n)})
    level = F.col("_level")
    up = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda v: F.struct(
        v.alias("_level"), F.call_function("shiftright", F.col("_i"), levels - v).alias("_ci"), F.call_function("shiftright", F.col("_j"), levels - v).alias("_cj")))
    where = ["poi_type", "_level", "_ci", "_cj"]
    every = stored(fine.select("poi_type", "lat", "lng", "copies", F.inline(up)).groupBy(*where).agg(
        F.sum("copies").alias("n"), F.count("*").alias("spots"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"),
        F.min(F.struct("lat", "lng")).alias("member")), "cells")
    crowded = every.filter((F.col("spots") > room) & (level < levels)).select(
        F.col("poi_type").alias("_t"), (level + 1).alias("_l"), F.col("_ci").alias("_pi"), F.col("_cj").alias("_pj"))
    below = F.col("poi_type").eqNullSafe(F.col("_t")) & (level == F.col("_l")) & (F.call_function("shiftright", F.col("_ci"), F.lit(1)) == F.col("_pi")) \
        & (F.call_function("shiftright", F.col("_cj"), F.lit(1)) == F.col("_pj"))
    deeper = every.filter(level > 0).join(crowded, below, "left_semi")
    cells = stored(every.filter(level == 0).unionByName(deeper).withColumn("leaf", (F.col("spots") <= room) | (level == levels)), "tree")
    leaves = cells.filter("leaf").select(F.col("poi_type").alias("_t"), F.col("_level").alias("_l"), F.col("_ci").alias("_pi"), F.col("_cj").alias("_pj"))
    exploded = fine.select("poi_type", "poi_id", "copies", F.col("lat").alias("_tlat"), F.col("lng").alias("_tlng"), F.inline(up))
    same = F.col("poi_type").eqNullSafe(F.col("_t")) & (level == F.col("_l")) & (F.col("_ci") == F.col("_pi")) & (F.col("_cj") == F.col("_pj"))
    return cells, exploded.join(leaves, same, "left_semi")


def _copied_around(cells: DataFrame, band: Column, km: float) -> DataFrame:
    """Cells with the box of what they hold, each copied to all cells (_band, _cell) whose points can be within ``km`` of something in it."""
    reach = F.greatest(geo.longitude_reach(F.col("south"), km), geo.longitude_reach(F.col("north"), km))
    spread = cells.withColumn("_to", F.explode(F.sequence(band - 1, band + 1)))
    around = geo.cells_in_band(F.col("_to"), km)
    first = F.floor((F.col("west") - reach + 180.0) / 360.0 * around).cast("long")
    last = F.floor((F.col("east") + reach + 180.0) / 360.0 * around).cast("long")
    copied = spread.withColumn("_raw", F.explode(F.sequence(first, F.least(last, first + around - 1)))).withColumn("_cell", F.pmod("_raw", around))
    return copied.drop("_raw", "_band").withColumnRenamed("_to", "_band")


def nearest_in_radius(sites: DataFrame, pois: DataFrame, km: float = RADIUS_KM, room: int = CELL_ROOM, levels: int = CELL_LEVELS) -> DataFrame:
    """(lat, lng, city, poi_type, b, n): for each site and type with a point within ``km`` the nearest, as struct (km, poi_id), and how many there are.

    Sites go down a tree of cells, level by level. A cell beyond the radius is left; one wholly inside adds its number of points without being opened. Only cells that the circle's edge crosses, or
    that may hold something nearer than the nearest place known for the site, are split further, and only such leaves are opened. So a site reads a few cells and leaves, not all points around it.
    """
    cells, members = _split_cells(_poi_places(pois, []), km, room, levels)
    site = [*SITE, "city", "poi_type"]
    top = cells.filter("_level = 0")
    spread = _copied_around(top, F.col("_ci"), km)
    frontier = salted_join(_home_cell(sites.select(*SITE, "city"), km), spread, ["_band", "_cell"]).drop("_band", "_cell") \
        .withColumns({"counted": F.lit(False), "bound": F.lit(float("inf"))})
    box = [F.col(c) for c in ("lat", "lng", "south", "north", "west", "east")]
    counts, opened = [], []
    for level in range(levels + 1):
        here = frontier.withColumns({"floor_km": geo.box_distance_floor_km(*box), "inside": geo.box_distance_ceiling_km(*box) <= km,
                                     "member_km": geo.haversine_km(F.col("lat"), F.col("lng"), F.col("member.lat"), F.col("member.lng"))}).filter(F.col("floor_km") <= km)
        here = here.withColumn("bound", F.least("bound", F.min("member_km").over(Window.partitionBy(*site))))  # the cells that one site meets on one level
        wanted = (~F.col("counted") & ~F.col("inside")) | (F.col("floor_km") <= F.col("bound"))
        here = stored(here.select(*site, "_level", "_ci", "_cj", "leaf", "n", "counted", "inside", "bound", wanted.alias("wanted")), "frontier")
        counts.append(here.filter("inside and not counted").select(*site, "n"))
        opened.append(here.filter("leaf and wanted").select(*site, "_level", "_ci", "_cj", (F.col("counted") | F.col("inside")).alias("counted")))
        down = here.filter("wanted and not leaf").select(*site, "bound", (F.col("counted") | F.col("inside")).alias("counted"), F.col("_ci").alias("_pi"), F.col("_cj").alias("_pj"))
        if level == levels or down.isEmpty():
            break
        children = cells.filter(F.col("_level") == level + 1).withColumnRenamed("poi_type", "_t")
        frontier = down.join(children, F.col("poi_type").eqNullSafe(F.col("_t")) & (F.call_function("shiftright", F.col("_ci"), F.lit(1)) == F.col("_pi"))
                             & (F.call_function("shiftright", F.col("_cj"), F.lit(1)) == F.col("_pj"))).drop("_t", "_pi", "_pj")
    leaves = union_all(opened).withColumnsRenamed({"poi_type": "_t", "_level": "_l", "_ci": "_pi", "_cj": "_pj"})
    read = leaves.join(members, F.col("poi_type").eqNullSafe(F.col("_t")) & (F.col("_level") == F.col("_l")) & (F.col("_ci") == F.col("_pi")) & (F.col("_cj") == F.col("_pj")))
    near = read.withColumn("km", geo.haversine_km(F.col("lat"), F.col("lng"), F.col("_tlat"), F.col("_tlng"))).filter(F.col("km") <= km)
    found = near.groupBy(*site).agg(F.min(F.struct("km", "poi_id")).alias("b"), F.sum(F.when(~F.col("counted"), F.col("copies"))).alias("n"))
    whole = union_all(counts).withColumn("b", F.lit(None).cast(found.schema["b"].dataType))
    return found.unionByName(whole).groupBy(*site).agg(F.min("b").alias("b"), F.sum("n").alias("n"))


def _nearest_in_city(sites: DataFrame, pois: DataFrame, cell_km: float = RADIUS_KM) -> DataFrame:
    """Nearest point of interest of each type in the site's own city, at any distance.

    Sites meet the occupied cells of their city, not its points of interest. A cell is opened only
    when its box can hold something nearer than the member already known for some cell.
    """
    placed = _home_cell(_poi_places(pois, ["city"]), cell_km)
    cells = placed.groupBy("city", "poi_type", "_band", "_cell").agg(
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"),
        F.min(F.struct("lat", "lng")).alias("member"))
    totals = placed.groupBy("city", "poi_type").agg(F.sum("copies").alias("n"))
    meet = sites.join(cells, "city")
    lat, lng = F.col("lat"), F.col("lng")
    meet = meet.withColumns({
        "floor_km": geo.box_distance_floor_km(lat, lng, F.col("south"), F.col("north"), F.col("west"), F.col("east")),
        "member_km": geo.haversine_km(lat, lng, F.col("member.lat"), F.col("member.lng"))})
    per_site = Window.partitionBy(*SITE, "city", "poi_type")  # the occupied cells of one city
    opened = (meet.withColumn("bound_km", F.min("member_km").over(per_site))
              .filter(F.col("floor_km") <= F.col("bound_km")).select(*SITE, "city", "poi_type", "_band", "_cell"))
    members = placed.select("city", "poi_type", "_band", "_cell", F.col("lat").alias("_tlat"),
                            F.col("lng").alias("_tlng"), "poi_id")
    pairs = opened.join(members, ["city", "poi_type", "_band", "_cell"])
    best = pairs.groupBy(*SITE, "city", "poi_type").agg(F.min(F.struct(
        geo.haversine_km(lat, lng, F.col("_tlat"), F.col("_tlng")).alias("km"), F.col("poi_id"))).alias("b"))
    return best.join(totals, ["city", "poi_type"]).select(*SITE, "city", "poi_type", "b", "n")


def poi_with_fallback(points: DataFrame, pois: DataFrame, km: float = RADIUS_KM) -> DataFrame:
    """Nearest and number of points of interest by type for each distinct (lat, lng, city).

    Sites with none in the radius look at all points of interest of their city instead; ``source``
    says which. The radius result is checkpointed, since both the answer and the choice of the sites
    left over read it.
    """
    sites = points.select(*SITE, "city").distinct()
    near = durable(nearest_in_radius(sites, pois, km))
    alone = sites.join(near.select(*SITE, "city").distinct(), [*SITE, "city"], "left_anti")
    far = _nearest_in_city(alone, pois.filter(F.col("poi_type").isin(*POI_TYPES)), km)
    return near.withColumn("source", F.lit("radius")).unionByName(far.withColumn("source", F.lit("city")))


def nearest_poi(points: DataFrame, pois: DataFrame, km: float = RADIUS_KM,
                types: Sequence[str] = POI_TYPES) -> DataFrame:
    """One row for each point: distance to the nearest of each type, and the number considered."""
    found = poi_with_fallback(points, pois, km)
    wide = found.groupBy(*SITE, "city").agg(
        *[F.min(F.when(F.col("poi_type") == t, F.col("b.km"))).alias(f"{t}_km") for t in types],
        F.sum("n").alias("poi_count"))
    return salted_join(points.select("point_id", *SITE, "city"), wide, [*SITE, "city"], "left").withColumn(
        "poi_count", F.coalesce("poi_count", F.lit(0)))


# ---- composite scores ------------------------------------------------------------------------

def rating(score: Column, bands: Sequence[tuple[float, str]] = ((80, "Excellent"), (60, "Good"), (40, "Average")),
           otherwise: str = "Poor") -> Column:
    out = None
    for floor, label in bands:
        out = F.when(score >= floor, label) if out is None else out.when(score >= floor, label)
    return out.otherwise(otherwise)


def weighted_index(parts: Mapping[Column, float] | Sequence[tuple[Column, float]]) -> Column:
    """Sum of weight times component, each component clamped to 0..100. A missing one counts as 0."""
    total = F.lit(0.0)
    for component, weight in (parts.items() if isinstance(parts, Mapping) else parts):
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(component, F.lit(0.0))))
        total = total + F.lit(float(weight)) * clamped
    return total


def proximity(points: DataFrame, pois: DataFrame, km: float = RADIUS_KM,
              weights: Mapping[str, float] = PROXIMITY_WEIGHTS) -> DataFrame:
    """Score 0..100: each type gives full marks at distance 0 and none from the radius on."""
    near = nearest_poi(points, pois, km, tuple(weights))
    score = weighted_index([((1 - F.col(f"{t}_km") / km) * 100, w) for t, w in weights.items()])
    return near.withColumn("proximity_score", score).withColumn("proximity_rating", rating(F.col("proximity_score")))


def _in_order(fields: Iterable[str]) -> Column:
    """A struct that sorts by its fields, nulls last."""
    return F.struct(*[F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("x")).alias(c) for c in fields])


def demand_lookup(points: DataFrame, metrics: DataFrame) -> DataFrame:
    """The city's demand and supply record. No record gives the defaults, a missing field gives 0. Of several records the first counts,
    ordered by their own values, missing ones last."""
    one = metrics.groupBy("city").agg(F.min(_in_order(DEMAND_DEFAULTS)).alias("_r")).select("city", *[F.col(f"_r.{c}.x").alias(c) for c in DEMAND_DEFAULTS])
    joined = points.join(one.withColumn("_found", F.lit(True)), "city", "left")
    return joined.withColumns({c: F.when(F.col("_found"), F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(d))
                               for c, d in DEMAND_DEFAULTS.items()}).drop("_found")


def demand_supply(points: DataFrame, metrics: DataFrame) -> DataFrame:
    """Demand and supply scores 0..100, their ratio and the market status."""
    found = demand_lookup(points, metrics)

    def score(weights: Mapping[str, tuple[float, float]]) -> Column:
        return weighted_index([(F.col(c) * 100.0 / full, w) for c, (w, full) in weights.items()])

    ratio = F.col("demand_supply_ratio")
    status = F.when(ratio.isNull() | (ratio > 1.2), "seller").when(ratio < 0.8, "buyer").otherwise("balanced")
    return (found.withColumns({"demand_score": score(DEMAND_WEIGHTS), "supply_score": score(SUPPLY_WEIGHTS)})
            .withColumn("demand_supply_ratio", F.try_divide("demand_score", "supply_score"))
            .withColumn("market_status", status)
            .withColumn("status_color", F.when(F.col("market_status") == "seller", HEAT_COLOURS["high"])
                        .when(F.col("market_status") == "buyer", HEAT_COLOURS["low"]).otherwise(HEAT_COLOURS["medium"])))


def nearby_projects(points: DataFrame, projects: DataFrame, km: float = RADIUS_KM) -> DataFrame:
    """Projects of the point's city within the radius, one row each with the distance."""
    return within_radius(points.select("point_id", "city", *SITE), projects.select("project_id", "city", "weight", *SITE),
                         km, on=["city"])


def infrastructure(points: DataFrame, projects: DataFrame, km: float = RADIUS_KM, decay_km: float = 5.0) -> DataFrame:
    """Distance-decayed weight of the nearby projects, capped at 100, and what it says of appreciation.

    Sums run over distinct sites and over projects merged by spot, so copies are not paired.
    """
    spots = projects.groupBy("city", *SITE).agg(F.sum("weight").alias("weight"), F.count("*").alias("copies"))
    sites = points.select(*SITE, "city").distinct()
    pairs = within_radius(sites, spots, km, on=["city"])
    felt = pairs.groupBy(*SITE, "city").agg(
        F.sum(F.col("weight") * F.exp(-F.col("distance_km") / decay_km)).alias("_felt"),
        F.sum("copies").alias("nearby_projects"))
    totals = projects.groupBy("city").agg(F.count("*").alias("total_projects"))
    joined = salted_join(points.select("point_id", *SITE, "city"), felt, [*SITE, "city"], "left").join(totals, "city", "left")
    score = F.least(F.lit(100.0), F.coalesce("_felt", F.lit(0.0)) * 5)
    potential = F.when(F.col("infrastructure_score") >= 60, "high").when(
        F.col("infrastructure_score") >= 30, "medium").otherwise("low")
    return joined.select("point_id", score.alias("infrastructure_score"),
                         F.coalesce("nearby_projects", F.lit(0)).alias("nearby_projects"),
                         F.coalesce("total_projects", F.lit(0)).alias("total_projects")).withColumn(
        "appreciation_potential", potential)


def safety_lookup(points: DataFrame, safety: DataFrame) -> DataFrame:
    """The first safety record of a point's city, and area when the points have one.

    "First" is by the record's own values, missing ones last, so the choice is stable. A city without a record gets the
    defaults, and so does a missing field.
    """
    keys = ["city", "area"] if "area" in points.columns and "area" in safety.columns else ["city"]
    one = safety.groupBy(*keys).agg(F.min(_in_order(SAFETY_DEFAULTS)).alias("_r"))
    return points.join(one, keys, "left").withColumns(
        {c: F.coalesce(F.col(f"_r.{c}.x"), F.lit(d)) for c, d in SAFETY_DEFAULTS.items()}).drop("_r")


def safety_livability(points: DataFrame, safety: DataFrame) -> DataFrame:
    """Safety and livability indices 0..100 with the parts they are made of."""
    found = safety_lookup(points, safety)
    parts = found.withColumns({
        "low_crime": 100 - F.col("crime_index"), "calm_traffic": 100 - F.col("traffic_index"),
        "clean_air": 100 - F.col("aqi") / 3, "green": F.col("green_space_score"), "quiet": 100 - F.col("noise_level")})
    col = F.col
    return (parts.withColumn("safety_index", weighted_index([(col("low_crime"), 0.7), (col("calm_traffic"), 0.3)]))
            .withColumn("livability_index", weighted_index([
                (col("low_crime"), 0.25), (col("calm_traffic"), 0.2), (col("clean_air"), 0.25), (col("green"), 0.15),
                (col("quiet"), 0.15)]))
            .withColumn("safety_rating", rating(col("safety_index")))
            .withColumn("livability_rating", rating(col("livability_index"))))


# ---- feature vectors -------------------------------------------------------------------------

def location_features(points: DataFrame, pois: DataFrame, projects: DataFrame, safety: DataFrame,
                      metrics: DataFrame) -> DataFrame:
    """All scores of every point in one row."""
    base = points.select("point_id", "city", *SITE)
    scores = demand_supply(safety_livability(base, safety), metrics).select(
        "point_id", "city", *SITE, "safety_index", "livability_index", "demand_score", "supply_score", "demand_supply_ratio")
    near = proximity(points, pois).select("point_id", *[f"{t}_km" for t in POI_TYPES], "poi_count", "proximity_score")
    built = infrastructure(points, projects).select("point_id", "infrastructure_score", "nearby_projects")
    return scores.join(near, "point_id", "left").join(built, "point_id", "left")


def refresh_features(points: DataFrame, stored: DataFrame, compute) -> DataFrame:
    """Stored features, and computed ones for the points that have none."""
    fresh = points.join(stored.select("point_id"), "point_id", "left_anti")
    kept = stored.join(points.select("point_id"), "point_id", "left_semi")
    return kept.unionByName(compute(fresh))


def _digest(*columns: str) -> Column:
    """A sum of row hashes that does not depend on the order of rows; a repeated row counts again."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


def _cells_seen(sites: DataFrame, things: DataFrame, columns: Sequence[str], km: float, on: Sequence[str] = ()) -> DataFrame:
    """(site columns, _seen, _sure): a digest of all things in the cells that a circle round the site can touch, and whether one of them is surely within the circle."""
    cells = _home_cell(things, km).groupBy(*on, "_band", "_cell").agg(
        _digest(*columns).alias("_d"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"), F.min(F.struct("lat", "lng")).alias("member"))
    met = salted_join(_home_cell(sites, km), _copied_around(cells, F.col("_band"), km), [*on, "_band", "_cell"])
    near = geo.haversine_km(F.col("lat"), F.col("lng"), F.col("member.lat"), F.col("member.lng")) <= km
    return met.groupBy(*SITE, "city").agg(F.sum("_d").cast("string").alias("_seen"), F.max(near).alias("_sure"))


def feature_signatures(points: DataFrame, pois: DataFrame, projects: DataFrame, safety: DataFrame, metrics: DataFrame, km: float = RADIUS_KM) -> DataFrame:
    """(point_id, signature): a digest of everything that a point's features can follow from.

    That is its place, the points of interest and its city's projects in the cells round it, its city's records, and, for a point that may have no point of interest in the radius, all of its city.
    Work grows with points and occupied cells, not with pairs; only cells and cities are copied.
    """
    def by_city(things: DataFrame, name: str) -> DataFrame:
        return things.groupBy("city").agg(_digest(*things.columns).cast("string").alias(name))
    sites = points.select(*SITE, "city").distinct()
    seen = _cells_seen(sites, pois, ["poi_id", "poi_type", "lat", "lng"], km).withColumnsRenamed({"_seen": "_pois", "_sure": "_near"})
    built = _cells_seen(sites, projects, ["project_id", "weight", "lat", "lng"], km, on=["city"]).withColumnRenamed("_seen", "_projects").drop("_sure")
    whole = sites.join(seen, [*SITE, "city"], "left").join(built, [*SITE, "city"], "left") \
        .join(by_city(pois, "_all"), "city", "left").join(by_city(safety, "_safety"), "city", "left").join(by_city(metrics, "_demand"), "city", "left")
    fallback = F.when(~F.coalesce("_near", F.lit(False)), F.col("_all"))
    parts = [F.coalesce(c, F.lit("-")) for c in (F.col("_pois"), F.col("_projects"), F.col("_safety"), F.col("_demand"), fallback)]
    signed = whole.withColumn("signature", F.sha2(F.concat_ws("|", F.col("lat").cast("string"), F.col("lng").cast("string"), F.coalesce("city", F.lit("-")), *parts), 256))
    return salted_join(points.select("point_id", *SITE, "city"), signed.select(*SITE, "city", "signature"), [*SITE, "city"], "left").select("point_id", "signature")


def refresh_changed(points: DataFrame, stored: DataFrame, signatures: DataFrame, compute) -> DataFrame:
    """Stored features whose signature is still that of their point; all others are computed again. Both bear the signature."""
    now = signatures.withColumnRenamed("signature", "_now")
    kept = stored.join(now, "point_id").filter(F.col("signature") == F.col("_now")).drop("_now")
    stale = points.join(kept.select("point_id"), "point_id", "left_anti")
    return kept.unionByName(compute(stale).join(signatures, "point_id"))


def refresh_all(points: DataFrame, compute, path: str) -> DataFrame:
    """Recompute and store every feature row; the result is the number stored."""
    compute(points).write.mode("overwrite").parquet(path)
    return points.sparkSession.read.parquet(path).agg(F.count("*").alias("refreshed"))


def location_impact(features: DataFrame, base_price: Column | float,
                    weights: Mapping[str, float] = IMPACT_WEIGHTS) -> DataFrame:
    """What each score adds to or takes from a base price: weight at 100, nothing at 50."""
    price = base_price if isinstance(base_price, Column) else F.lit(float(base_price))
    rows = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("score"),
                              F.lit(w).alias("weight")) for c, w in weights.items()])
    long = features.select("point_id", price.alias("base_price"), F.inline(rows))
    share = F.col("weight") * (F.col("score") - 50) / 50
    return long.select("point_id", "component", "score", (share * 100).alias("impact_pct"),
                       (F.col("base_price") * share).alias("price_delta"))


# ---- maps ------------------------------------------------------------------------------------

def heat_band(intensity: Column) -> Column:
    return F.when(intensity < 1 / 3, "low").when(intensity < 2 / 3, "medium").otherwise("high")


def heat_colour(intensity: Column) -> Column:
    band = heat_band(intensity)
    return F.when(band == "low", HEAT_COLOURS["low"]).when(band == "medium", HEAT_COLOURS["medium"]).otherwise(
        HEAT_COLOURS["high"])


def city_markers(listings: DataFrame, coords: DataFrame) -> DataFrame:
    """Cities with coordinates, price for one area unit, heat and listing count."""
    places = place_intensity(listings).join(coords, "city")
    return places.select("city", "country", "lat", "lng", F.round("price_per_area", 0).alias("price_per_area"),
                         "property_count", "intensity", heat_colour(F.col("intensity")).alias("colour"))


def coords_or_default(listings: DataFrame, coords: DataFrame, defaults: DataFrame, city: str | None = None,
                      country: str | None = None) -> DataFrame:
    """Places to map: those of the filter, else all cities with coordinates, else the default table.

    Each later choice is kept only when the earlier ones are empty, decided inside the plan.
    """
    from acreage.operators.cleaning import filter_place

    places = listings.select("city", "country").dropna().distinct().join(coords, "city")
    wanted = filter_place(places, city, country)
    others = coords.withColumn("country", F.lit(None).cast("string"))
    spare = defaults.withColumn("country", F.lit(None).cast("string"))
    n_wanted = wanted.agg(F.count("*")).scalar()
    n_others = others.agg(F.count("*")).scalar()
    columns = ["city", "country", "lat", "lng"]
    return (wanted.select(*columns)
            .unionByName(others.filter(n_wanted == 0).select(*columns))
            .unionByName(spare.filter((n_wanted == 0) & (n_others == 0)).select(*columns)))


def price_surface(places: DataFrame, value: str = "price_per_area", weight: str | None = None, cell: float = 0.25,
                  bandwidth: float = 0.5, limit: int | None = None) -> DataFrame:
    """Kernel-weighted mean price over a grid, relative to the highest cell.

    Rows are first summed by cell, so the kernel spreads cells and not listings; every cell reaches
    the cells within two bandwidths. With ``limit``, the highest cells only; those that agree in nine places go by their position.
    """
    reach = int(2 * bandwidth / cell)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    snapped = (places.filter(F.col(value).isNotNull())
               .groupBy(F.floor(F.col("lat") / cell).cast("long").alias("_y"), F.floor(F.col("lng") / cell).cast("long").alias("_x"))
               .agg(F.sum(F.col(value) * w).alias("_v"), F.sum(w).alias("_w")))
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    spread = snapped.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
    kernel = F.exp(-(F.col("_dy") * F.col("_dy") + F.col("_dx") * F.col("_dx")) * (cell * cell) / (2 * bandwidth ** 2))
    surface = (spread.groupBy((F.col("_y") + F.col("_dy")).alias("_cy"), (F.col("_x") + F.col("_dx")).alias("_cx"))
               .agg((F.sum(F.col("_v") * kernel) / F.sum(F.col("_w") * kernel)).alias("price")))
    peak = surface.agg(F.max("price")).scalar()
    out = surface.select(((F.col("_cy") + 0.5) * cell).alias("lat"), ((F.col("_cx") + 0.5) * cell).alias("lng"), "price",
                         F.try_divide(F.col("price"), peak).alias("intensity"))
    return out if limit is None else out.orderBy(F.round("intensity", 9).desc(), "lat", "lng").limit(limit)
