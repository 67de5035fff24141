from acreage.operators import market as mk


def test_null_keys_are_left_out(listing):
    df = listing([("A", "a", 1.0, 50.0, 10.0), (None, "a", 1.0, 50.0, 30.0), ("A", None, 2.0, 50.0, 20.0)])
    assert [tuple(r) for r in mk.mean_by(df, "country", "price_usd").collect()] == [("A", 15.0)]
    assert mk.kpis(df).first()["total_properties"] == 3
    assert (mk.kpis(df).first()["total_countries"], mk.kpis(df).first()["total_cities"]) == (1, 1)
    assert mk.city_stats(df).count() == 1


def test_ranges_are_half_open_and_show_zero(listing):
    df = listing([("A", "a", 1.0, 50.0, p) for p in (99_999.0, 100_000.0, 500_000.0, 5e6)])
    got = {r["range"]: r["n"] for r in mk.price_ranges(df).collect()}
    assert got == {"under_100k": 1, "100k_500k": 1, "500k_1m": 1, "1m_5m": 0, "over_5m": 1}
    assert sum(r["n"] for r in mk.area_ranges(df).collect()) == 4


def test_heatmap_counts_by_city_name(spark, listing):
    df = listing([("A", "x", 1.0, 50.0, 10.0), ("B", "x", 1.0, 50.0, 20.0), ("B", "y", 1.0, 50.0, 20.0)])
    coords = spark.createDataFrame([("x", 1.0, 2.0)], "city string, lat double, lng double")
    assert sorted((r["country"], r["property_count"]) for r in mk.city_heatmap(df, coords).collect()) == [("A", 2), ("B", 2)]
    assert sorted((r["country"], r["property_count"]) for r in mk.city_heatmap(df, coords, by_country=True).collect()) == [("A", 1), ("B", 1)]


def test_ties_go_to_the_first_name(listing):
    df = listing([("B", "b", 1.0, 50.0, 10.0), ("A", "a", 1.0, 50.0, 10.0)])
    row = mk.extremes(df).first()
    assert (row["most_expensive_country"], row["cheapest_country"], row["most_listings_country"]) == ("A", "A", "A")
    assert [r["city"] for r in mk.top_cities(df, 1).collect()] == ["a"]


def test_insights_read_as_sentences(listing):
    lines = [r["insight"] for r in mk.market_insights(listing([("A", "a", 2.0, 50.0, 1234567.0)] * 2)).orderBy("line").collect()]
    assert lines[0] == "Dataset contains 2 properties across 1 countries"
    assert lines[2] == "Most expensive market: A ($1,234,567 avg)"
    assert lines[5] == "Average property size is 50 sqm with 2.0 rooms"


def test_built_in_coordinates(spark):
    assert mk.city_coords(spark).count() == 42


def test_kpis_scan_groups_before_counting_distinct(listing):
    plan = mk.kpis(listing([("A", "a", 2.0, 50.0, 1.0)]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
