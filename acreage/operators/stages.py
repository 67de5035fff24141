"""Features and boosted trees as ``pyspark.ml`` stages, so that one ``PipelineModel`` holds, saves and loads both."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.operators.boosting import BoostedTrees, Boosting, Settings
from acreage.operators.cleaning import finite_rows
from acreage.operators.features import FEATURES, LABELLED, FittedFeatures, assemble, engineer, fit_features, to_log

_NUMBERS = "kind string, name string, value double, extra double"


class _Writer(MLWriter):
    """Params as every stage writes them, then what the model learnt."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance._save_learnt(self.sparkSession, path)


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.cls._load_learnt(self.sparkSession, path))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _Learnt(MLReadable, MLWritable):
    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader(cls)


class _FeatureParams(HasFeaturesCol, HasLabelCol):
    targetCol = Param(Params._dummy(), "targetCol", "price whose logarithm is the label; rows to score need not have it", TypeConverters.toString)
    accuracy = Param(Params._dummy(), "accuracy", "accuracy of approximate medians; 0 for exact ones", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", targetCol="price_usd", accuracy=0)


class PriceFeatures(Estimator, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits medians, label numbers, mean prices and scales on all rows it is given."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", targetCol="price_usd", accuracy=0):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, train: DataFrame) -> "PriceFeaturesModel":
        target = self.getOrDefault("targetCol")
        named = train if target == "price_usd" else train.withColumn("price_usd", F.col(target))
        return self._copyValues(PriceFeaturesModel(fit_features(named, self.getOrDefault("accuracy") or None)))


class PriceFeaturesModel(Model, _FeatureParams, _Learnt):
    """Adds the scaled feature vector and, where the price is there, its logarithm.

    Rows with a price are rows to learn from: those with a number that is not finite are dropped. Rows without one are all kept, and an impossible
    number is NaN in the vector. A null or unseen place gets the middle mean price, an unseen label index 0. Every input column keeps its value; columns
    that begin with ``_in_`` or bear a feature's name are replaced.
    """

    def __init__(self, fitted: FittedFeatures | None = None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, df: DataFrame) -> DataFrame:
        features, label, target = (self.getOrDefault(c) for c in ("featuresCol", "labelCol", "targetCol"))
        kept = [c for c in df.columns if c not in FEATURES or c in ("rooms", "area_sqm", "balcony", "building_age")]
        kept = [c for c in kept if c not in (features, label)]
        rows = df.select(*[F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(kept)],
                         *[F.col(c) for c in (*LABELLED, "rooms", "area_sqm", "building_age")], F.col("balcony").cast("double").alias("balcony"),
                         *([F.col(target).cast("double").alias("price_usd")] if target in df.columns else []))
        made = engineer(rows, self.fitted)
        if target in df.columns:
            made = finite_rows(made.withColumn("_label", to_log(F.col("price_usd"))), (*FEATURES, "_label"))
        out = assemble(made, self.fitted.scale, "_features")
        return out.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(kept)], F.col("_features").alias(features),
                          *([F.col("_label").alias(label)] if target in df.columns else []))

    def _save_learnt(self, spark, path: str) -> None:
        for name, table in self.fitted.tables.items():
            table.write.parquet(os.path.join(path, f"table_{name}"))
        rows = [("median", k, v, None) for k, v in self.fitted.medians.items()] + [("default", k, v, None) for k, v in self.fitted.defaults.items()]
        rows += [("scale", k, float(m), float(s)) for k, (m, s) in self.fitted.scale.items()]
        spark.createDataFrame(rows, _NUMBERS).coalesce(1).write.parquet(os.path.join(path, "numbers"))

    @staticmethod
    def _load_learnt(spark, path: str) -> FittedFeatures:
        numbers = spark.read.schema(_NUMBERS).parquet(os.path.join(path, "numbers")).collect()  # one row for each column
        values = lambda kind: {r["name"]: r["value"] for r in numbers if r["kind"] == kind}
        return FittedFeatures(values("median"), values("default"), {c: spark.read.parquet(os.path.join(path, f"table_{c}")) for c in LABELLED},
                              {r["name"]: (r["value"], r["extra"]) for r in numbers if r["kind"] == "scale"})


class _TreeParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    settings = Param(Params._dummy(), "settings", "settings of the trees by name")

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", settings=asdict(Settings()))


class TreeRegressor(Estimator, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Second-order boosted trees with fixed settings; names that ``settings`` leaves out have their defaults."""

    def __init__(self, settings: Settings | Mapping | None = None, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        chosen = asdict(settings) if isinstance(settings, Settings) else dict(settings or {})
        self._set(settings=chosen, featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol)

    def _fit(self, train: DataFrame) -> "TreeRegressionModel":
        boosting = Boosting(Settings(**self.getOrDefault("settings")), self.getOrDefault("featuresCol"), self.getOrDefault("labelCol"))
        return self._copyValues(TreeRegressionModel(boosting.fit(train)))


class TreeRegressionModel(Model, _TreeParams, _Learnt):
    """Adds the prediction of the trees."""

    def __init__(self, trees: BoostedTrees | None = None):
        super().__init__()
        self.trees = trees

    def _transform(self, df: DataFrame) -> DataFrame:
        trees = BoostedTrees(self.trees.cuts, self.trees.base, self.trees.trees, self.getOrDefault("featuresCol"), self.getOrDefault("predictionCol"))
        return trees.transform(df)

    def _save_learnt(self, spark, path: str) -> None:
        self.trees.save(spark, path)

    @staticmethod
    def _load_learnt(spark, path: str) -> BoostedTrees:
        return BoostedTrees.load(spark, path)
