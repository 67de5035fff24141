from pyspark.sql import functions as F

from acreage.functions import scalars as sc


def values(spark, texts, expr, kind="string"):
    df = spark.createDataFrame([(t,) for t in texts], f"c {kind}")
    return [r[0] for r in df.select(expr(F.col("c"))).collect()]


def test_lenient_numbers(spark):
    assert values(spark, [" 7 ", "nan", "x", "", None, "1e3", "12d", "12f", "-4.5"], sc.num) == [
        7.0, None, None, None, None, 1000.0, None, None, -4.5]


def test_money_drops_commas_and_sign(spark):
    assert values(spark, ["৳1,250,000", "3,000", "free", None], sc.money) == [1250000.0, 3000.0, None, None]


def test_units(spark):
    assert values(spark, [1000.0], sc.sqft_to_sqm, "double") == [1000 * 0.0929]
    assert values(spark, [830.0], lambda c: sc.to_usd(c, "INR"), "double") == [10.0]
    assert values(spark, [83.0], lambda c: sc.to_usd(sc.rent_to_price(c), "INR"), "double") == [200.0]
    assert values(spark, [2000.0, None], sc.age, "double") == [24.0, None]


def test_flags(spark):
    assert values(spark, ["2", "0", "-1", "x", None], sc.flag_gt0) == [1, 0, 0, 0, 0]
    assert values(spark, ["yes", "no", None, "false", "0", "0.0", "1"], sc.flag_truthy) == [1, 1, 1, 0, 0, 0, 1]


def test_clip_keeps_null(spark):
    assert values(spark, [-5.0, 20.0, 200.0, None], lambda c: sc.clip(c, 0, 150), "double") == [0.0, 20.0, 150.0, None]


def test_furnishing_is_not_trimmed(spark):
    assert values(spark, ["FURNISHED", "semi furnished", " furnished", "", None, "other"], sc.normalise_map) == [
        "Furnished", "Semi-Furnished", "Unknown", "Unknown", "Unknown", "Unknown"]


def test_finite(spark):
    assert values(spark, [1.0, float("inf"), float("-inf"), float("nan"), None], sc.finite, "double") == [1.0, None, None, None, None]


def test_rounding_half_up_and_half_even(spark):
    df = spark.createDataFrame([(0.125,)], "x double")
    assert sc.round_out(df, {"x": 2}).first()[0] == 0.13
    assert sc.round_out(df, {"x": 2}, half_even=True).first()[0] == 0.12


def test_unit_hash_ignores_partitioning(spark):
    df = spark.range(500).withColumn("u", sc.unit_hash(["id"]))
    again = spark.range(500).repartition(7).withColumn("u", sc.unit_hash(["id"]))
    assert sorted(df.collect()) == sorted(again.collect())
    assert all(0 <= r["u"] < 1 for r in df.collect())


def test_division_by_zero_area_is_null(spark):
    df = spark.createDataFrame([(100.0, 0.0), (100.0, 50.0)], "price_usd double, area_sqm double")
    assert [r["price_per_sqm"] for r in sc.with_price_per_sqm(df).collect()] == [None, 2.0]


def test_bucket_labels_are_half_open(spark):
    got = values(spark, [9.0, 10.0, 19.9, 20.0, None], lambda c: sc.bucket_label(c, (10, 20), ("low", "mid", "high")), "double")
    assert got == ["low", "mid", "mid", "high", None]
