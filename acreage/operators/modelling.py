"""Tree models, stacking, evaluation and scoring."""

from __future__ import annotations

import math
import os
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Model
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from acreage.functions.scalars import unit_hash
from acreage.operators.boosting import BoostedTrees, Boosting, Settings, search
from acreage.operators.combine import union_all
from acreage.operators.features import (FittedFeatures, assemble, assign_fold, engineer, fit_and_engineer, from_log,
                                        vectorise)
from acreage.operators.quantiles import quantiles
from acreage.session import stored

# Search spaces, the settings of the third model and the earlier model's score.
GRID_A = {
    "trees": [200, 300, 500],
    "max_depth": [6, 8, 10, 12],
    "rate": [0.05, 0.1, 0.15],
    "least_rows": [1, 3, 5],
    "row_share": [0.8, 0.9, 1.0],
    "column_share": [0.8, 0.9, 1.0],
    "l1": [0, 0.1, 0.5],
    "l2": [1, 1.5, 2],
}
GRID_B = {
    "trees": [200, 300, 500],
    "max_depth": [6, 8, 10, 12],
    "rate": [0.05, 0.1, 0.15],
    "max_leaves": [31, 50, 70],
    "least_rows": [10, 20, 30],
    "row_share": [0.8, 0.9, 1.0],
    "column_share": [0.8, 0.9, 1.0],
    "l1": [0, 0.1, 0.5],
    "l2": [0, 0.1, 0.5],
}
SETTINGS_C = {"maxIter": 300, "maxDepth": 8, "minInstancesPerNode": 5, "stepSize": 0.1, "subsamplingRate": 0.9}
SEARCH_DRAWS = 20
SEARCH_FOLDS = 3
STACK_FOLDS = 3
CV_FOLDS = 5
FITS_AT_ONCE = 4  # of a stack; a run of boosted trees may keep one core busy only
RIDGE_ALPHA = 1.0
EARLIER_R2 = 0.7153
MAPE_EPSILON = 1e-10


def draw_settings(grid: Mapping[str, Sequence], draws: int, seed: int = 42) -> list[dict]:
    """Distinct random combinations of a search space."""
    sizes = [len(v) for v in grid.values()]
    chosen = random.Random(seed).sample(range(math.prod(sizes)), min(draws, math.prod(sizes)))
    out = []
    for number in chosen:
        setting = {}
        for name, values in grid.items():
            number, place = divmod(number, len(values))
            setting[name] = values[place]
        out.append(setting)
    return out


def _gbt(seed: int, **settings) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol="label", seed=seed, **settings)


def fit_tuned(train: DataFrame, grid: Mapping[str, Sequence] = GRID_A, draws: int = SEARCH_DRAWS, fold: str = "fold",
              folds: int = SEARCH_FOLDS, seed: int = 42) -> tuple[Boosting, dict, float]:
    """Random search by cross-validated R², all settings and folds grown side by side. Returns the estimator with the
    best settings, the settings and their score. Folds come from a column, so they do not depend on partitioning."""
    settings = draw_settings(grid, draws, seed)
    scores = search(train, [Settings(**s, seed=seed) for s in settings], folds, fold)
    best = max(range(len(scores)), key=scores.__getitem__)
    return Boosting(Settings(**settings[best], seed=seed)), settings[best], scores[best]


def gbt_a(train: DataFrame, **options) -> Boosting:
    """The first model: trees grown level by level."""
    return fit_tuned(train, GRID_A, **options)[0]


def gbt_b(train: DataFrame, **options) -> Boosting:
    """The second model: trees grown best leaf first, up to a number of leaves."""
    return fit_tuned(train, GRID_B, **options)[0]


def gbt_c(settings: Mapping = SETTINGS_C, early_stop: str | None = "hold_out", seed: int = 42) -> GBTRegressor:
    """The third model: fixed settings, stopped early on the rows marked in ``early_stop``."""
    estimator = _gbt(seed, **settings)
    return estimator.setValidationIndicatorCol(early_stop) if early_stop else estimator


def mark_hold_out(df: DataFrame, key: Sequence[str | Column], share: float = 0.1, seed: int = 7) -> DataFrame:
    return df.withColumn("hold_out", unit_hash(key, seed) < share)


# ---- stacking --------------------------------------------------------------------------------

def ridge(train: DataFrame, inputs: Sequence[str], label: str = "label", alpha: float = RIDGE_ALPHA) -> LinearRegressionModel:
    """Ridge regression with the penalty alpha on the raw coefficients.

    Spark scales the loss by 1/(n·sd), so the penalty it needs is alpha·sd/n.
    """
    from pyspark.ml.feature import VectorAssembler

    moments = train.agg(F.count(label).alias("n"), F.stddev_samp(label).alias("sd")).first()
    vector = VectorAssembler(inputCols=list(inputs), outputCol="_stacked").transform(train)
    return LinearRegression(featuresCol="_stacked", labelCol=label, predictionCol="prediction", elasticNetParam=0.0,
                            standardization=False, regParam=alpha * moments["sd"] / moments["n"], solver="l-bfgs",
                            maxIter=200, tol=1e-10).fit(vector)


@dataclass
class StackedModel:
    """Base models and, with two or more, a ridge over their scores."""

    bases: list[Model | BoostedTrees]
    meta: LinearRegressionModel | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        if self.meta is None:
            return self.bases[0].setPredictionCol("prediction").transform(df)
        columns = [f"_base_{i}" for i in range(len(self.bases))]
        for model, column in zip(self.bases, columns):
            df = model.setPredictionCol(column).transform(df)
        score = F.lit(float(self.meta.intercept))
        for weight, column in zip(self.meta.coefficients.toArray(), columns):
            score = score + F.lit(float(weight)) * F.col(column)
        return df.withColumn("prediction", score).drop(*columns)


def fit_stack(train: DataFrame, estimators: Sequence[Estimator | Boosting], fold: str = "stack_fold", folds: int = STACK_FOLDS,
              alpha: float = RIDGE_ALPHA) -> StackedModel:
    """Base models on all rows, and a ridge on scores each row got from models that did not see it."""
    if len(estimators) < 2:
        return StackedModel([estimators[0].fit(train)])
    columns = [f"_base_{i}" for i in range(len(estimators))]
    # each model on all rows and without each fold, no fit waits for another's answer
    jobs = [(i, f) for f in (None, *range(folds)) for i in range(len(estimators))]

    @inheritable_thread_target(train.sparkSession)
    def fitted(job):
        i, f = job
        return estimators[i].fit(train if f is None else train.filter(F.col(fold) != f))
    with ThreadPool(FITS_AT_ONCE) as pool:
        models = dict(zip(jobs, pool.map(fitted, jobs, chunksize=1), strict=True))
    scored = []
    for f in range(folds):
        held = train.filter(F.col(fold) == f)
        for i, column in enumerate(columns):
            held = models[i, f].setPredictionCol(column).transform(held)
        scored.append(held.select("label", *columns))
    meta = ridge(stored(union_all(scored), "scores"), columns, alpha=alpha)
    return StackedModel([models[i, None] for i in range(len(estimators))], meta)


# ---- evaluation ------------------------------------------------------------------------------

def evaluate_all(predicted: DataFrame, by: str = "split", groups: Sequence[str] = ("train", "val", "test"),
                 label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Errors on the price scale for each group, and R² on the log scale as well."""
    y, p = from_log(F.col(label)), from_log(F.col(prediction))
    err = y - p
    # every pass below would score the rows again
    rows = stored(predicted.select(by, F.col(label).alias("_yl"), F.col(prediction).alias("_pl"),
                                    y.alias("_y"),
                                    err.alias("_e"), F.abs(err).alias("_ae")), "scored")
    middles = quantiles(rows, {g: (F.when(F.col(by) == g, F.col("_ae")), 0.5) for g in groups})
    medae = F.create_map(*[F.lit(v) for g in groups for v in (str(g), middles[g])]) if groups else F.lit(None)
    return rows.groupBy(by).agg(
        F.count("*").alias("rows"),
        F.avg("_ae").alias("mae"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        (1 - F.try_divide(F.sum(F.col("_e") * F.col("_e")), F.var_pop("_y") * F.count("*"))).alias("r2"),
        (1 - F.try_divide(F.sum(F.pow(F.col("_yl") - F.col("_pl"), 2)), F.var_pop("_yl") * F.count("*"))).alias("r2_log"),
        (F.avg(F.abs(F.col("_e") / (F.col("_y") + MAPE_EPSILON))) * 100).alias("mape"),
    ).withColumn("medae", F.try_element_at(medae, F.col(by).cast("string")))


def evaluate(predicted: DataFrame, name: str = "test", **columns) -> DataFrame:
    """The same metrics for one frame under one name."""
    return evaluate_all(predicted.withColumn("split", F.lit(name)), groups=(name,), **columns)


def select_best(metrics: DataFrame, model: str = "model", score: str = "r2") -> DataFrame:
    """The model with the highest score; ties go to the first name."""
    best = F.min(F.struct((-F.col(score)).alias("k"), F.col(model).alias("m")))
    return metrics.agg(best.alias("b")).select(F.col("b.m").alias("best_model"), (-F.col("b.k")).alias("best_score"))


def improvement(metrics: DataFrame, base: float = EARLIER_R2) -> DataFrame:
    """Gain in test R² over an earlier model, in per cent."""
    return metrics.filter(F.col("split") == "test").select(
        F.col("r2"), ((F.col("r2") - base) / base * 100).alias("improvement_pct"))


def summarise_folds(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of the score over the folds."""
    return scores.agg(F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"), F.count("*").alias("folds"))


def cross_val(df: DataFrame, fit: Callable[[DataFrame], Model | StackedModel], key: Sequence[str],
              folds: int = CV_FOLDS, seed: int = 42) -> DataFrame:
    """R² on the log scale of each fold. Encoders and scaling are fitted inside the fold; ``fit`` gets
    the prepared rows with their stacking fold and hold-out mark."""
    folded = stored(assign_fold(df, key, folds, seed), "folded", spread=True)
    scored = []
    for f in range(folds):
        fitted, made = fit_and_engineer(folded, F.col("fold") != f)
        rows = vectorise(made, fitted)
        rest = mark_hold_out(assign_fold(rows.filter(F.col("fold") != f), key, STACK_FOLDS, seed + 2, "stack_fold"), key)
        model = fit(rest.select("features", "label", "stack_fold", "hold_out"))
        held = rows.filter(F.col("fold") == f)
        scored.append(model.transform(held).select("fold", "label", "prediction"))
    return (union_all(scored).groupBy("fold").agg(
        (1 - F.try_divide(F.sum(F.pow(F.col("label") - F.col("prediction"), 2)), F.var_pop("label") * F.count("*"))).alias("r2"),
        F.count("*").alias("rows")))


# ---- scoring ---------------------------------------------------------------------------------

def price_band(df: DataFrame, prediction: Column | str = "prediction", range_pct: Column | float = 10.0) -> DataFrame:
    """Price from the log score with a symmetric band, never below zero."""
    score = F.col(prediction) if isinstance(prediction, str) else prediction
    share = (range_pct if isinstance(range_pct, Column) else F.lit(float(range_pct))) / 100
    price = from_log(score)
    return df.withColumns({
        "predicted_price": F.round(price, 2),
        "price_low": F.round(F.greatest(F.lit(0.0), price * (1 - share)), 2),
        "price_high": F.round(price * (1 + share), 2),
        "currency": F.lit("USD"),
    })


@dataclass
class PriceModel:
    """A fitted model with the feature values it was trained on."""

    fitted: FittedFeatures
    model: StackedModel
    metrics: DataFrame | None = None
    info: dict[str, str] = field(default_factory=dict)

    def score(self, df: DataFrame, range_pct: float = 10.0) -> DataFrame:
        """Price and band for each row. A ``range_pct`` column overrides the argument."""
        width = F.coalesce(F.col("range_pct").cast("double"), F.lit(float(range_pct))) if "range_pct" in df.columns \
            else F.lit(float(range_pct))
        inputs = [f"_in_{c}" for c in df.columns]
        kept = df.withColumns({n: F.col(c) for n, c in zip(inputs, df.columns)})
        kept = kept.withColumn("balcony", F.col("balcony").cast("double"))
        made = assemble(engineer(kept, self.fitted), self.fitted.scale)
        banded = price_band(self.model.transform(made), range_pct=width).withColumn("accuracy_pct", width)
        return banded.select(*[F.col(n).alias(c) for n, c in zip(inputs, df.columns)],
                             "predicted_price", "price_low", "price_high", "accuracy_pct", "currency")

    def save(self, path: str) -> str:
        """Models, keyed tables, numbers and metrics below one folder."""
        spark = self.fitted.tables["city"].sparkSession
        for i, base in enumerate(self.model.bases):
            where = os.path.join(path, f"base_{i}")
            if isinstance(base, BoostedTrees):
                base.save(spark, where)
            else:
                base.write().overwrite().save(where)
        if self.model.meta is not None:
            self.model.meta.write().overwrite().save(os.path.join(path, "meta"))
        for name, table in self.fitted.tables.items():
            table.write.mode("overwrite").parquet(os.path.join(path, f"table_{name}"))
        rows = [("median", k, v, None) for k, v in self.fitted.medians.items()]
        rows += [("default", k, v, None) for k, v in self.fitted.defaults.items()]
        rows += [("scale", k, m, s) for k, (m, s) in self.fitted.scale.items()]
        rows += [("boosted", str(i), float(isinstance(base, BoostedTrees)), None) for i, base in enumerate(self.model.bases)]
        rows += [("bases", "count", float(len(self.model.bases)), None),
                 ("bases", "stacked", float(self.model.meta is not None), None)]
        spark.createDataFrame(rows, "kind string, name string, value double, extra double").coalesce(1).write.mode(
            "overwrite").parquet(os.path.join(path, "numbers"))
        if self.metrics is not None:
            self.metrics.write.mode("overwrite").parquet(os.path.join(path, "metrics"))
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PriceModel":
        from acreage.operators.features import LABELLED

        numbers = spark.read.parquet(os.path.join(path, "numbers")).collect()  # one row for each column
        kind = lambda k: {r["name"]: r for r in numbers if r["kind"] == k}
        fitted = FittedFeatures(
            {n: r["value"] for n, r in kind("median").items()}, {n: r["value"] for n, r in kind("default").items()},
            {c: spark.read.parquet(os.path.join(path, f"table_{c}")) for c in LABELLED},
            {n: (r["value"], r["extra"]) for n, r in kind("scale").items()})
        shape = kind("bases")
        boosted = kind("boosted")
        bases = [BoostedTrees.load(spark, os.path.join(path, f"base_{i}")) if boosted[str(i)]["value"] else GBTRegressionModel.load(os.path.join(path, f"base_{i}"))
                 for i in range(int(shape["count"]["value"]))]
        meta = LinearRegressionModel.load(os.path.join(path, "meta")) if shape["stacked"]["value"] else None
        try:
            metrics = spark.read.parquet(os.path.join(path, "metrics"))
        except AnalysisException as error:  # a model may be saved before it is evaluated
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            metrics = None
        return cls(fitted, StackedModel(bases, meta), metrics)


def model_status(model: PriceModel) -> DataFrame:
    """Saved metrics with the number of countries and cities the model knows."""
    counts = {c: model.fitted.tables[c].filter(F.col(f"{c}_avg_price").isNotNull()).agg(F.count("*")).scalar()
              for c in ("country", "city")}
    if model.metrics is None:
        return model.fitted.tables["country"].sparkSession.range(1).select(F.lit(counts["country"]).alias("countries"), F.lit(counts["city"]).alias("cities"))
    return model.metrics.withColumn("countries", counts["country"]).withColumn("cities", counts["city"])
