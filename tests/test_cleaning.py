from pyspark.sql import functions as F

from acreage.operators import cleaning as cl


def test_require_drops_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double")
    assert cl.require(df, ["x"]).count() == 1


def test_band_is_over_the_whole_frame_before_other_filters(listing):
    rows = [("A", "a", 3.0, 50.0, float(p)) for p in range(1, 100)] + [("A", "a", 99.0, 50.0, 1e6)]
    kept = cl.clean(listing(rows)).select("price_usd").collect()
    assert min(r[0] for r in kept) == 2.0 and max(r[0] for r in kept) == 99.0


def test_hard_bounds_are_strict(listing):
    rows = [("A", "a", 1.0, a, p) for a, p in [(10.0, 5000.0), (11.0, 1000.0), (11.0, 1001.0), (999.0, 2e6), (1000.0, 5000.0)]]
    assert [(r["area_sqm"], r["price_usd"]) for r in cl.hard_bounds(listing(rows)).collect()] == [(11.0, 1001.0)]


def test_empty_frame_passes_through(listing):
    empty = listing([("A", "a", 1.0, 50.0, 5000.0)]).filter(F.lit(False))
    assert cl.clean(empty).count() == 0 and cl.remove_outliers(empty).count() == 0


def test_removal_report(listing):
    df = listing([("A", "a", 1.0, 50.0, float(p)) for p in (500, 5000, 6000, 7000)])
    row = cl.removal_report(df, cl.hard_bounds(df)).first()
    assert (row["initial_rows"], row["final_rows"], row["removed_rows"], row["removed_pct"]) == (4, 3, 1, 25.0)


def test_finite_rows(spark):
    df = spark.createDataFrame([(1.0, 2), (float("inf"), 2), (float("nan"), 2), (None, 2), (1e308, None)], "a double, b int")
    assert cl.finite_rows(df, ["a", "b"]).count() == 1


def test_prediction_rules(spark):
    df = spark.createDataFrame([("A", "a", "3", 50.0, None), ("A", None, "x", 50.0, 4.0), (None, None, None, None, None)],
                               "country string, city string, rooms string, area_sqm double, building_age double")
    checked = cl.validate(df, cl.PREDICTION_RULES)
    good = cl.accepted(checked).collect()
    assert [(r["building_age"], r["balcony"], r["furnishing_status"], r["range_pct"]) for r in good] == [(10.0, False, "Unknown", 10.0)]
    bad = cl.rejected(checked).collect()
    assert [r["reason"] for r in bad] == ["city is required", "country is required"]
    assert [list(r["reasons"]) for r in bad][0] == ["city is required", "rooms is not a number"]


def test_contact_rules(spark):
    df = spark.createDataFrame([("n", "a@b", "s", "m"), ("n", "ab", "s", "m"), ("", "a@b", "s", None)],
                               "name string, email string, subject string, message string")
    assert [list(r["reasons"]) for r in cl.validate(df, cl.CONTACT_RULES).collect()] == [
        [], ["Invalid email format"], ["name is required", "message is required"]]


def test_missing_required_column(spark):
    df = spark.createDataFrame([("u",)], "username string")
    assert list(cl.validate(df, cl.REGISTRATION_RULES).first()["reasons"]) == ["email is required", "password is required"]
