import math

import pytest
from pyspark.sql import functions as F

from acreage.operators import combine, features as ft


def test_split_is_complete_and_ignores_partitioning(spark):
    a = ft.split(spark.range(3000), ["id"])
    b = ft.split(spark.range(3000).repartition(9), ["id"])
    assert sorted(a.collect()) == sorted(b.collect())
    sizes = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 3000
    assert sizes["train"] / 3000 == pytest.approx(0.7, abs=0.03) and sizes["test"] / 3000 == pytest.approx(0.1, abs=0.03)
    assert sorted(ft.split(spark.range(3000), ["id"], seed=1).collect()) != sorted(a.collect())


def test_folds(spark):
    folds = ft.assign_fold(spark.range(1000), ["id"], 4).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3]


def test_labels_are_sorted_across_prefixes(spark):
    names = ["b", "ab", "aa", "aac", "", None, "Ça", "zz", "nan"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    got = {r["label"]: int(r["label_index"]) for r in combine.label_index(df, "c").collect()}
    expected = sorted({n if n is not None else "nan" for n in names})
    assert got == {n: i for i, n in enumerate(expected)}


def test_unseen_label(spark):
    labels = combine.label_index(spark.createDataFrame([("b",), ("a",)], "c string"), "c")
    df = spark.createDataFrame([("b",), ("zzz",)], "c string")
    assert sorted(r["c_encoded"] for r in ft.label_encode_apply(df, labels, "c").collect()) == [0.0, 1.0]
    with pytest.raises(Exception, match="unseen label"):
        ft.label_encode_apply(df, labels, "c", unseen="error").collect()


def test_scale_of_a_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    scale = ft.robust_scale_fit(df, ["x"])
    assert scale == {"x": (5.0, 1.0)}
    assert [r["x"] for r in ft.robust_scale_apply(df, scale).collect()] == [0.0, 0.0]


def test_fit_and_engineer(spark, listing):
    train = listing([("A", "a", 2.0, 100.0, 10.0), ("A", "a", 3.0, 40.0, 20.0), ("B", "b", 0.0, 200.0, 60.0)])
    fitted = ft.fit_features(train)
    assert fitted.defaults["city"] == 15.0 and fitted.medians["price_usd"] == 20.0
    new = listing([("B", "nowhere", float("inf"), 160.0, None)])
    row = ft.engineer(new, fitted).first()
    assert row["rooms"] == 2.0 and row["city_avg_price"] == 15.0 and row["country_avg_price"] == 60.0
    assert (row["city_encoded"], row["country_encoded"]) == (0.0, 1.0)
    assert (row["is_large"], row["is_small"], row["is_new"], row["is_old"]) == (1, 0, 1, 0)
    assert row["log_area"] == pytest.approx(math.log1p(160)) and row["area_per_room"] == 80.0
    low = ft.engineer(train, fitted).filter("city = 'b'").first()
    assert low["rooms"] == 1.0 and low["area_x_rooms"] == 200.0


def test_prepare_drops_rows_without_a_finite_target(spark, listing):
    train = listing([("A", "a", 2.0, 100.0, float(p)) for p in (10, 20, 30)])
    fitted = ft.fit_features(train)
    assert len(ft.prepare(train, fitted).first()["features"]) == 21
    assert ft.prepare(listing([("A", "a", 2.0, 100.0, -5.0)]), fitted).count() == 0


def test_out_of_fold_mean_leaves_the_own_fold_out(spark):
    df = spark.createDataFrame([("a", 0, 10.0), ("a", 0, 20.0), ("a", 1, 60.0), ("b", 1, 5.0)], "city string, fold int, price_usd double")
    got = {(r["city"], r["fold"]): r["city_avg_price"] for r in ft.target_encode_out_of_fold(df, "city", "fold").collect()}
    assert got == {("a", 0): 60.0, ("a", 1): 15.0, ("b", 1): None}


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n int, t string")
    b = spark.createDataFrame([("y", 2)], "t string, n int")
    assert sorted(tuple(r) for r in combine.union_all([a, b, a]).collect()) == [(1, "x"), (1, "x"), (2, "y")]


def test_middle_of_weights_by_rows(spark):
    means = spark.createDataFrame([("a", 1.0, 5), ("b", 9.0, 1)], "city string, city_avg_price double, n long")
    assert ft.middle_of(means, "city_avg_price") == 1.0


def test_labels_of_one_prefix_are_numbered_in_many_tasks(spark):
    """All labels begin alike; they are in sorted order, and no task has more than a few times its share."""
    n = 40_000
    rows = spark.range(n).select(F.concat(F.lit("Customer#"), F.lpad(((F.col("id") * 7919) % n).cast("string"), 9, "0")).alias("name"), F.lit("one").alias("kind"), (F.col("id") % 100).cast("double").alias("v"))
    got = combine.label_indexes(rows.unionByName(rows.limit(10)), ["name", "kind"], "v")
    numbered = {r["label"]: r["label_index"] for r in got.filter("column = 'name'").collect()}
    assert [numbered[k] for k in sorted(numbered)] == list(map(float, range(n)))
    assert got.filter("column = 'kind'").first()["label_index"] == 0.0
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    ranges = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in got.inputFiles()}).groupBy("_range").count().collect()
    assert len(ranges) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in ranges) < 3 * n / len(ranges) and sum(sizes) == n + 1


def test_means_do_not_depend_on_the_order_of_rows(spark):
    values = [0.1, 1e15, -1e15, 0.2, 0.3, 7.25] * 50
    for seed in range(3):
        df = spark.createDataFrame([(v, "k") for v in values], "price_usd double, city string").repartition(seed + 2).orderBy(F.rand(seed))
        assert ft.target_encode_fit(df, "city").first()["city_avg_price"] == pytest.approx(7.85 / 6, abs=1e-15)
