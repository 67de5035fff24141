import math
import random

import pytest
from pyspark.sql import functions as F

from acreage.functions import geo
from acreage.operators import location as lo
from acreage.operators.skew import salted_join
from acreage.session import scratch_path


def km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_KM * math.asin(min(1, math.sqrt(h)))


def spots(seed, n, around, wide):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lat, lng = around[i % len(around)]
        lng = (lng + rng.uniform(-wide, wide) + 180) % 360 - 180
        out.append((i, max(-90.0, min(90.0, lat + rng.uniform(-0.2, 0.2))), lng))
    return out


PLACES = [(0.0, 0.0), (51.0, 17.0), (-65.0, 179.95), (10.0, -179.95), (89.9, 20.0), (-89.95, -100.0)]


def test_radius_join_equals_brute_force(spark):
    points, targets = spots(1, 150, PLACES, 0.3), spots(2, 150, PLACES, 0.3)
    got = lo.within_radius(spark.createDataFrame(points, "point_id int, lat double, lng double"),
                           spark.createDataFrame(targets, "poi_id int, lat double, lng double"), 10.0)
    want = {(p[0], t[0]) for p in points for t in targets if km(p[1:], t[1:]) <= 10.0}
    rows = got.select("point_id", "poi_id").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want and len(want) > 50


def test_radius_join_plan_is_an_equi_join(spark):
    points = spark.createDataFrame(spots(1, 5, PLACES, 0.3), "point_id int, lat double, lng double")
    targets = spark.createDataFrame(spots(2, 5, PLACES, 0.3), "poi_id int, lat double, lng double")
    plan = lo.within_radius(points, targets)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_hot_key_is_split_and_complete(spark):
    big = spark.range(3000).selectExpr("id", "if(id < 2000, 0, id % 7) as k")
    other = spark.createDataFrame([(k, v) for k in range(5) for v in range(2)], "k long, v int")
    for how in ("inner", "left"):
        want = sorted(map(str, big.join(other, "k", how).select("id", "k", "v").collect()))
        got = sorted(map(str, salted_join(big, other, ["k"], how, rows_per_task=300).select("id", "k", "v").collect()))
        assert got == want


def test_nearest_with_fallback_equals_brute_force(spark):
    rng = random.Random(3)
    cities = "abc"
    points = [(i, rng.choice(cities), rng.uniform(0, 4), rng.uniform(0, 4)) for i in range(60)]
    pois = [(i, rng.choice("ab"), rng.choice(lo.POI_TYPES), rng.uniform(0, 4), rng.uniform(0, 4)) for i in range(80)]
    pois += [(100 + i, p[1], p[2], p[3], p[4]) for i, p in enumerate(pois[:10])]  # copies at the same spot
    got = lo.nearest_poi(spark.createDataFrame(points, "point_id int, city string, lat double, lng double"),
                         spark.createDataFrame(pois, "poi_id int, city string, poi_type string, lat double, lng double"), 30.0)
    for row in got.collect():
        me = points[row["point_id"]]
        near = [(q[2], km(me[2:], q[3:])) for q in pois if km(me[2:], q[3:]) <= 30.0]
        seen = near or [(q[2], km(me[2:], q[3:])) for q in pois if q[1] == me[1]]
        assert row["poi_count"] == len(seen)
        for t in lo.POI_TYPES:
            best = min((d for kind, d in seen if kind == t), default=None)
            assert row[f"{t}_km"] == (None if best is None else pytest.approx(best, abs=1e-6))


def test_box_floor_never_exceeds_the_distance(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = []
    for _ in range(300):
        south, west = rng.uniform(-89, 88), rng.uniform(-180, 178)
        north, east = min(90.0, south + rng.uniform(0, 3)), min(180.0, west + rng.uniform(0, 3))
        inside = (rng.uniform(south, north), rng.uniform(west, east))
        rows.append((rng.uniform(-90, 90), rng.uniform(-180, 180), south, north, west, east, *inside))
    df = spark.createDataFrame(rows, "lat double, lng double, s double, n double, w double, e double, a double, b double")
    c = F.col
    bad = df.filter(geo.box_distance_floor_km(c("lat"), c("lng"), c("s"), c("n"), c("w"), c("e"))
                    > geo.haversine_km(c("lat"), c("lng"), c("a"), c("b")))
    assert bad.count() == 0


def test_records_defaults(spark):
    points = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "b", 0.0, 0.0)], "point_id int, city string, lat double, lng double")
    demand = spark.createDataFrame([("a", 10, None, 30, 0, 0)], "city string, search_frequency int, prediction_requests int, "
                                   "interaction_count int, active_listings int, new_developments int")
    got = {r["city"]: tuple(r[c] for c in lo.DEMAND_DEFAULTS) for r in lo.demand_lookup(points, demand).collect()}
    assert got == {"a": (10, 0, 30, 0, 0), "b": (500, 150, 1000, 200, 15)}
    scored = {r["city"]: r for r in lo.demand_supply(points, demand).collect()}
    assert scored["a"]["demand_supply_ratio"] is None and scored["a"]["market_status"] == "seller"
    safety = spark.createDataFrame([("a", 10.0, None, 1.0, 1.0, 1.0)], "city string, crime_index double, traffic_index double, "
                                   "aqi double, green_space_score double, noise_level double")
    safe = {r["city"]: (r["crime_index"], r["traffic_index"], r["aqi"]) for r in lo.safety_lookup(points, safety).collect()}
    assert safe == {"a": (10.0, 50.0, 1.0), "b": (50.0, 50.0, 100.0)}


def test_fallback_chain_of_coordinates(spark, listing):
    df = listing([("A", "x", 1.0, 50.0, 10.0), ("B", "y", 1.0, 50.0, 10.0)])
    coords = spark.createDataFrame([("x", 1.0, 2.0), ("y", 3.0, 4.0)], "city string, lat double, lng double")
    spare = spark.createDataFrame([("z", 5.0, 6.0)], "city string, lat double, lng double")
    cities = lambda *a, **k: sorted(r["city"] for r in lo.coords_or_default(df, *a, **k).collect())
    assert cities(coords, spare, country="A") == ["x"]
    assert cities(coords, spare, country="none") == ["x", "y"]
    assert cities(coords.limit(0), spare, country="none") == ["z"]


def test_impact_is_zero_at_fifty(spark):
    df = spark.createDataFrame([(1, 50.0, 100.0, 0.0, 50.0, 75.0)], ["point_id", *lo.IMPACT_WEIGHTS])
    got = {r["component"]: (r["impact_pct"], r["price_delta"]) for r in lo.location_impact(df, 1000.0).collect()}
    assert got["proximity_score"] == (0.0, 0.0)
    assert got["demand_score"][1] == pytest.approx(80.0) and got["infrastructure_score"][1] == pytest.approx(-80.0)


def test_refresh_all_counts(spark, tmp_path):
    points = spark.range(5).withColumnRenamed("id", "point_id")
    assert lo.refresh_all(points, lambda p: p, str(tmp_path / "f")).first()["refreshed"] == 5


def test_surface_peak_is_one(spark):
    places = spark.createDataFrame([(0.0, 0.0, 10.0), (3.0, 3.0, 20.0)], "lat double, lng double, price_per_area double")
    rows = lo.price_surface(places).collect()
    assert max(r["intensity"] for r in rows) == 1.0 and min(r["price"] for r in rows) >= 10.0 - 1e-9
    assert len(lo.price_surface(places, limit=5).collect()) == 5


def test_one_record_for_a_city(spark):
    """Of several records of a city one counts, and an empty record never hides a full one."""
    points = spark.createDataFrame([(1, "a"), (2, "b")], "point_id int, city string")
    safety = spark.createDataFrame([("a", None, None, None, None, None), ("a", 10.0, 20.0, 30.0, 40.0, 50.0)],
                                   "city string, " + ", ".join(f"{c} double" for c in lo.SAFETY_DEFAULTS))
    got = {r["point_id"]: r["crime_index"] for r in lo.safety_lookup(points, safety).collect()}
    assert got == {1: 10.0, 2: 50.0}
    demand = spark.createDataFrame([("a", 5, 1, 1, 1, 1), ("a", 3, None, 2, 2, 2)], "city string, " + ", ".join(f"{c} int" for c in lo.DEMAND_DEFAULTS))
    got = {r["point_id"]: r["search_frequency"] for r in lo.demand_lookup(points, demand).collect()}
    assert got == {1: 3, 2: 500}


def brute_nearest(sites, pois, km):
    def far(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))
    out = {}
    for s in set(sites):
        for t in {p[1] for p in pois}:
            near = [(far(s, p[2:]), p[0]) for p in pois if p[1] == t and far(s, p[2:]) <= km]
            if near:
                out[(*s, t)] = (round(min(near)[0], 6), len(near), {i for d, i in near if d <= min(near)[0] + 1e-9})
    return out


@pytest.mark.parametrize("room,levels", [(3, 6), (64, 10), (1, 2)])
def test_nearest_in_radius_equals_all_pairs(spark, room, levels):
    rng = random.Random(room)
    centres = [(20.0, 70.0), (0.0, 0.0), (10.0, 180.0), (-33.0, -179.99), (89.95, 10.0)]
    def spot():
        lat, lng = rng.choice(centres)
        return round(max(-90.0, min(90.0, lat + rng.gauss(0, 0.06))), rng.choice([2, 6])), round((lng + rng.gauss(0, 0.06) + 180) % 360 - 180, rng.choice([2, 6]))
    pois = [(i, rng.choice(["metro", "school", None]), *spot()) for i in range(400)]
    sites = [spot() for _ in range(40)] + [(50.0, 50.0)]
    got = lo.nearest_in_radius(spark.createDataFrame([(*s, "c") for s in sites], "lat double, lng double, city string").distinct(),
                               spark.createDataFrame(pois, "poi_id int, poi_type string, lat double, lng double"), 10.0, room, levels).collect()
    want = brute_nearest(sites, pois, 10.0)
    assert {(r["lat"], r["lng"], r["poi_type"]): (round(r["b"]["km"], 6), r["n"]) for r in got} == {k: v[:2] for k, v in want.items()}
    assert all(r["b"]["poi_id"] in want[r["lat"], r["lng"], r["poi_type"]][2] for r in got)


def test_a_dense_city_is_not_read_whole(spark):
    """Four times as many points in the same city: a site reads a little more of it, not four times as much."""
    read = {}
    for n in (10_000, 40_000):
        pois = spark.range(n).select(F.col("id").alias("poi_id"), F.lit("metro").alias("poi_type"), (20 + F.rand(1) * 0.16).alias("lat"), (70 + F.rand(2) * 0.16).alias("lng"))
        sites = spark.range(50).select((20.04 + F.rand(3) * 0.08).alias("lat"), (70.04 + F.rand(4) * 0.08).alias("lng"), F.lit("c").alias("city"))
        pois.write.mode("overwrite").parquet(path := scratch_path(spark, "dense"))
        out = lo.nearest_in_radius(sites, spark.read.parquet(path))
        rows = out.collect()
        assert len(rows) == 50 and all(r["n"] > 0.5 * n for r in rows)
        read[n] = most_joined(out)
    assert 0 < read[10_000] and read[40_000] < 2.6 * read[10_000] and read[40_000] < 0.2 * 50 * 40_000


def most_joined(out):
    """The most rows that a join of a finished query made."""
    stack, most = [out._jdf.queryExecution().executedPlan()], 0
    while stack:
        node = stack.pop()
        if "Join" in node.nodeName():
            rows = node.metrics().get("numOutputRows")
            most = max(most, rows.get().value()) if rows.isDefined() else most
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
        if "AdaptiveSparkPlan" in node.nodeName():
            stack.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            stack.append(node.plan())
    return most


def test_only_points_that_see_a_change_are_computed_again(spark):
    """The features depend on the surroundings; a change recomputes the points near it, and in the city those that may have to look at all of it."""
    rng = random.Random(9)
    points = spark.createDataFrame([(i, "near" if i % 2 else "far", 20 + (i % 40) * 0.05, 70.0 + rng.random() * 0.02) for i in range(80)] + [(99, "near", 40.0, 10.0)],
                                   "point_id int, city string, lat double, lng double")
    spots = [(i, lo.POI_TYPES[i % 5], "near" if i % 2 else "far", 20 + (i % 50) * 0.04, 70.0 + rng.random() * 0.02) for i in range(100)]
    poi_schema = "poi_id int, poi_type string, city string, lat double, lng double"
    before = spark.createDataFrame(spots, poi_schema)
    after = spark.createDataFrame(spots + [(500, "metro", "far", 20.001, 70.01)], poi_schema)
    projects = spark.createDataFrame([(1, "near", 1.0, 20.5, 70.0), (2, "far", 2.0, 21.0, 70.0)], "project_id int, city string, weight double, lat double, lng double")
    safety = spark.createDataFrame([("near", 1.0, 2.0, 3.0, 4.0, 5.0)], "city string, crime_index double, traffic_index double, aqi double, green_space_score double, noise_level double")
    demand = spark.createDataFrame([("far", 1, 2, 3, 4, 5)], "city string, search_frequency int, prediction_requests int, interaction_count int, active_listings int, new_developments int")

    def signed(pois, safe=safety, built=projects):
        return {r["point_id"]: r["signature"] for r in lo.feature_signatures(points, pois, built, safe, demand).collect()}
    old = signed(before)
    assert len(old) == 81 and old == signed(before.repartition(5))
    changed = {i for i, s in signed(after).items() if s != old[i]}
    where = {r["point_id"]: (r["lat"], r["lng"]) for r in points.collect()}
    within = {i for i, spot in where.items() if km(spot, (20.001, 70.01)) <= lo.RADIUS_KM}
    assert within <= changed and len(changed) < 30 and 99 not in changed  # a change in another city than its own
    assert 99 in {i for i, s in signed(spark.createDataFrame(spots[1:2] + spots[2:], poi_schema).filter("poi_id <> 1")).items() if s != old[i]}  # it looks at its whole city
    warmer = {i for i, s in signed(before, safety.withColumn("aqi", F.lit(9.0))).items() if s != old[i]}
    assert warmer == {i for i in where if i % 2}
    built = {i for i, s in signed(before, built=projects.withColumn("weight", F.lit(7.0))).items() if s != old[i]}
    assert built and all(abs(where[i][0] - (20.5 if i % 2 else 21.0)) < 0.3 for i in built)

    kept = lo.location_features(points, before, projects, safety, demand).join(lo.feature_signatures(points, before, projects, safety, demand), "point_id")
    computed = []

    def compute(stale):
        computed.extend(r["point_id"] for r in stale.select("point_id").collect())
        return lo.location_features(stale, after, projects, safety, demand)
    got = lo.refresh_changed(points, kept, lo.feature_signatures(points, after, projects, safety, demand), compute)
    want = lo.location_features(points, after, projects, safety, demand)
    assert sorted(map(str, got.drop("signature").select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert set(computed) == changed
