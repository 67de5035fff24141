import numpy as np
import pytest
from pyspark.sql import functions as F

from acreage.operators import features as ft, modelling as m
from acreage.plans.train import TrainConfig, train

SMALL = TrainConfig(
    key=("id",), grid_a={"trees": [4], "max_depth": [3], "rate": [0.3]}, grid_b={"trees": [3], "max_leaves": [4], "rate": [0.5]},
    settings_c={"maxIter": 4, "maxDepth": 3, "stepSize": 0.3, "minInstancesPerNode": 2}, draws=1, cv_folds=2)


@pytest.fixture(scope="module")
def homes(spark):
    """Listings whose price follows area and city."""
    return spark.range(1200).select(
        "id", F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("country"),
        F.concat(F.lit("c"), (F.col("id") % 6).cast("string")).alias("city"), (1 + F.col("id") % 5).cast("double").alias("rooms"),
        (30 + (F.col("id") * 37) % 200).cast("double").alias("area_sqm"), (F.col("id") % 2).cast("int").alias("balcony"),
        ((F.col("id") * 7) % 60).cast("double").alias("building_age"), F.lit("Furnished").alias("furnishing_status"),
        ((30 + (F.col("id") * 37) % 200) * (1000 + 300 * (F.col("id") % 6))).cast("double").alias("price_usd"))


@pytest.fixture(scope="module")
def trained(homes):
    return train(homes, SMALL)


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, 2))
    y = x @ np.array([2.0, -1.0]) + 0.5 + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, label double")
    model = m.ridge(df, ["a", "b"], alpha=10.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 10.0 * np.eye(2), xc.T @ yc)
    assert model.coefficients.toArray() == pytest.approx(want, abs=1e-5)
    assert model.intercept == pytest.approx(y.mean() - x.mean(0) @ want, abs=1e-5)


class Asked(Exception):
    """Stands for the fit that a query asks for; its arguments are what is looked at."""


def test_queries_ask_for_whole_fits(spark, monkeypatch):
    from acreage.catalog import modelling as c

    def asked(*args, **options):
        raise Asked(args[1:], options)
    rows = spark.range(1).select(F.lit("train").alias("split"))
    monkeypatch.setattr(c, "prepared_splits", lambda *_: (None, None, rows))
    monkeypatch.setattr(c, "listings", lambda *_: rows)
    for place in ((c, "train"), (m, "fit_tuned"), (m, "fit_stack")):
        monkeypatch.setattr(*place, asked)

    def of(name):
        with pytest.raises(Asked) as found:
            c.ENTRIES[name][0](spark, "")
        return found.value.args
    assert of("tuned_trees_a") == ((m.GRID_A,), {}) and of("tuned_trees_b") == ((m.GRID_B,), {})  # 20 draws in 3 folds
    assert of("train_price_model") == ((TrainConfig(),), {})
    (estimators,), options = of("stacked_trees")
    assert not options and len(estimators) == 4 and [e.settings.trees for e in estimators[:2]] == [300, 300]
    monkeypatch.setattr(m.GBTRegressor, "fit", lambda self, _: asked(None, self))
    ((third,), _) = of("early_stopped_trees")
    for e in (third, *estimators[2:]):
        assert (e.getMaxIter(), e.getMaxDepth(), e.getValidationIndicatorCol()) == (300, 8, "hold_out")


def test_draws_are_seeded_and_distinct():
    a = m.draw_settings(m.GRID_A, 20)
    assert a == m.draw_settings(m.GRID_A, 20) and len({str(s) for s in a}) == 20
    assert len(m.draw_settings({"maxDepth": [1, 2]}, 20)) == 2


def test_metrics_of_known_errors(spark):
    df = spark.createDataFrame([("test", 100.0, 110.0), ("test", 200.0, 180.0), ("test", 300.0, 300.0)], "split string, y double, p double")
    row = m.evaluate(df.select("split", F.log1p("y").alias("label"), F.log1p("p").alias("prediction"))).first()
    assert row["mae"] == pytest.approx(10) and row["medae"] == pytest.approx(10)
    assert row["rmse"] == pytest.approx((500 / 3) ** 0.5) and row["r2"] == pytest.approx(1 - 500 / 20000)
    assert row["mape"] == pytest.approx(20 / 3)


def test_band(spark):
    df = spark.createDataFrame([(np.log1p(1000.0).item(), 10.0), (np.log1p(1000.0).item(), 150.0)], "prediction double, w double")
    rows = m.price_band(df, range_pct=F.col("w")).collect()
    assert [(r["price_low"], r["predicted_price"], r["price_high"]) for r in rows] == [(900.0, 1000.0, 1100.0), (0.0, 1000.0, 2500.0)]


def test_best_and_improvement(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.1)], "model string, r2 double")
    assert m.select_best(df).first()["best_model"] == "a"
    got = m.improvement(spark.createDataFrame([("test", 0.7373)], "split string, r2 double")).first()
    assert got["improvement_pct"] == pytest.approx((0.7373 - 0.7153) / 0.7153 * 100)


def test_training_beats_the_mean_and_is_complete(homes, trained):
    model, tables = trained
    metrics = {r["split"]: r for r in tables["metrics"].collect()}
    assert set(metrics) == {"train", "val", "test"} and metrics["test"]["r2"] > 0.3
    assert sum(r["rows"] for r in metrics.values()) <= homes.count()
    assert {r["model"] for r in tables["candidates"].select("model").distinct().collect()} == {"gbt_a", "gbt_b", "gbt_c", "stacking"}
    assert tables["cv"].first()["folds"] == 2


def test_saved_model_scores_the_same(spark, homes, trained, tmp_path):
    model, _ = trained
    asked = homes.limit(20).drop("price_usd").withColumn("range_pct", F.lit(20.0))
    want = sorted(map(str, model.score(asked).collect()))
    loaded = m.PriceModel.load(spark, model.save(str(tmp_path / "model")))
    assert sorted(map(str, loaded.score(asked).collect())) == want
    row = loaded.score(asked).first()
    assert row["price_low"] <= row["predicted_price"] <= row["price_high"] and row["accuracy_pct"] == 20.0
    status = m.model_status(loaded).first()
    assert (status["countries"], status["cities"]) == (2, 6)


def test_unknown_place_is_scored(spark, trained):
    one = spark.createDataFrame([("Z", "nowhere", 3, 100.0, True, None, None)],
                                "country string, city string, rooms int, area_sqm double, balcony boolean, building_age int, furnishing_status string")
    assert trained[0].score(one).first()["predicted_price"] > 0


def test_single_model_needs_no_ridge(homes):
    fitted = ft.fit_features(homes)
    data = ft.prepare(homes, fitted)
    stack = m.fit_stack(data, [m._gbt(1, maxIter=2, maxDepth=2)])
    assert stack.meta is None and stack.transform(data).filter("prediction is null").isEmpty()
