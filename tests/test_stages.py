import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from acreage.operators.boosting import Settings
from acreage.operators.features import FEATURES, assemble, engineer, fit_features, vectorise
from acreage.operators.stages import PriceFeatures, TreeRegressor


@pytest.fixture(scope="module")
def homes(spark):
    return spark.range(900).select(
        "id", F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("country"), F.concat(F.lit("c"), (F.col("id") % 6).cast("string")).alias("city"),
        (1 + F.col("id") % 5).cast("double").alias("rooms"), (30 + (F.col("id") * 37) % 200).cast("double").alias("area_sqm"), (F.col("id") % 2).cast("int").alias("balcony"),
        F.when(F.col("id") % 50 != 0, ((F.col("id") * 7) % 60).cast("double")).alias("building_age"), F.lit("Furnished").alias("furnishing_status"),
        ((30 + (F.col("id") * 37) % 200) * (1000 + 300 * (F.col("id") % 6))).cast("double").alias("price_usd"))


@pytest.fixture(scope="module")
def saved(homes, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "pipeline")
    model = Pipeline(stages=[PriceFeatures(), TreeRegressor(Settings(trees=8, max_depth=4, rate=0.4))]).fit(homes)
    model.write().overwrite().save(path)
    return model, path


def scores(model, rows):
    return [(r["id"], r["prediction"]) for r in model.transform(rows).orderBy("id").collect()]


def test_a_pipeline_read_back_scores_alike(homes, saved):
    model, path = saved
    assert scores(PipelineModel.load(path), homes) == scores(model, homes)


def test_another_session_scores_alike(spark, homes, saved):
    model, path = saved
    other = spark.newSession()
    rows = other.createDataFrame(homes.toPandas())
    assert scores(PipelineModel.read().session(other).load(path), rows) == scores(model, homes)


def test_the_vector_is_that_of_the_fitted_features(homes, saved):
    fitted = fit_features(homes)
    want = {r["id"]: r for r in vectorise(engineer(homes, fitted), fitted).collect()}
    got = {r["id"]: r for r in saved[0].stages[0].transform(homes).collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert np.array_equal(got[key]["features"].toArray(), want[key]["features"].toArray()) and got[key]["label"] == want[key]["label"]


def test_the_trees_follow_the_price(homes, saved):
    r2 = saved[0].transform(homes).agg((1 - F.sum(F.pow(F.col("label") - F.col("prediction"), 2)) / (F.var_pop("label") * F.count("*"))).alias("r2")).first()["r2"]
    assert r2 > 0.9


def test_rows_to_score_are_all_kept(spark, homes, saved):
    rows = spark.createDataFrame([(1, "A", "c0", 2.0, 80.0, 1, 5.0, "Furnished", 7.0), (2, None, "nowhere", None, None, None, None, None, None), (2, "B", "c1", float("inf"), -5.0, 0, -3.0, "", None)],
                                 "id long, country string, city string, rooms double, area_sqm double, balcony int, building_age double, furnishing_status string, log_area double")
    out = saved[0].transform(rows)
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 2]
    assert "label" not in out.columns and "log_area" not in out.columns
    fitted = saved[0].stages[0].fitted
    want = assemble(engineer(rows.withColumn("balcony", F.col("balcony").cast("double")), fitted), fitted.scale).filter("id = 1").first()["features"].toArray()
    assert np.array_equal(out.filter("id = 1").first()["features"].toArray(), want)
    assert saved[0].transform(rows.limit(0)).count() == 0


def test_input_columns_keep_their_values(homes, saved):
    out = saved[0].transform(homes)
    assert out.select(*homes.columns).exceptAll(homes).count() == 0
    assert out.columns == [*homes.columns, "features", "label", "prediction"] and len(out.first()["features"]) == len(FEATURES)


def test_unfitted_stages_are_saved_too(tmp_path):
    stages = Pipeline(stages=[PriceFeatures(labelCol="y", targetCol="paid"), TreeRegressor({"trees": 3}, labelCol="y")])
    stages.write().overwrite().save(str(tmp_path / "p"))
    first, second = Pipeline.load(str(tmp_path / "p")).getStages()
    assert first.getOrDefault("targetCol") == "paid" and second.getOrDefault("settings")["trees"] == 3 and second.getLabelCol() == "y"
