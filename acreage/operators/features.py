"""Features of a listing for the price model, fitted on training rows only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acreage.functions.scalars import exact_mean, finite, unit_hash
from acreage.operators.cleaning import finite_rows
from acreage.operators.combine import label_index, label_indexes
from acreage.operators.quantiles import quantiles
from acreage.session import stored

# Columns, thresholds and the order of the feature vector.
FILLED = ("rooms", "area_sqm", "balcony", "building_age", "price_usd")
LABELLED = ("country", "city", "furnishing_status")
LARGE_SQM, SMALL_SQM = 150, 50
NEW_YEARS, OLD_YEARS = 5, 30
FEATURES = (
    "country_encoded", "city_encoded", "rooms", "area_sqm", "balcony",
    "building_age", "furnishing_status_encoded",
    "city_avg_price", "country_avg_price",
    "log_area", "area_squared", "sqrt_area",
    "area_per_room", "rooms_squared",
    "is_large", "is_small",
    "is_new", "is_old", "log_age",
    "area_x_rooms", "area_x_age",
)
SPLIT = {"train": 0.7, "val": 0.3 * (1 - 0.333), "test": 0.3 * 0.333}
ARRAY_SPLIT = {"train": 0.9 * (1 - 0.222), "val": 0.9 * 0.222, "test": 0.1}


# ---- splitting -------------------------------------------------------------------------------

def split(df: DataFrame, key: Sequence[str | Column], seed: int = 42, fractions: Mapping[str, float] = SPLIT,
          column: str = "split") -> DataFrame:
    """Label each row by a hash of its key. The label depends on the key and the seed only, so
    repartitioning, retries and other rows do not move it, and copies stay together."""
    u = unit_hash(key, seed)
    names = list(fractions)
    edge, label = 0.0, None
    for name in names[:-1]:
        edge += fractions[name]
        label = F.when(u < edge, name) if label is None else label.when(u < edge, name)
    return df.withColumn(column, F.lit(names[0]) if label is None else label.otherwise(names[-1]))


def assign_fold(df: DataFrame, key: Sequence[str | Column], k: int, seed: int = 42, column: str = "fold") -> DataFrame:
    return df.withColumn(column, F.least(F.lit(k - 1), F.floor(unit_hash(key, seed) * k)).cast("int"))


# ---- imputation and target means -------------------------------------------------------------

def fill_values(df: DataFrame, columns: Sequence[str] = FILLED, accuracy: int | None = None) -> dict[str, float]:
    """Medians of the finite values of each column."""
    present = [c for c in columns if c in df.columns]
    return quantiles(df.select(*[finite(F.col(c)).alias(c) for c in present]), {c: (c, 0.5) for c in present},
                     accuracy=accuracy)


def fill_median(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    """Infinities and gaps replaced by the fitted medians."""
    return df.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(m).cast("double"))
                           for c, m in medians.items() if c in df.columns})


def clip_low(df: DataFrame, column: str = "rooms", lo: float = 1) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) < lo, F.lit(lo)).otherwise(F.col(column)))


def target_encode_fit(train: DataFrame, key: str, target: str = "price_usd") -> DataFrame:
    """Mean target and row count of each key, rows without a key left out."""
    return (train.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(exact_mean(F.col(target)).alias(f"{key}_avg_price"), F.count("*").alias("n")))


def middle_of(means: DataFrame, column: str) -> float | None:
    """Median of the looked-up means over the training rows: each key's mean counts as often as the key has rows, n."""
    return quantiles(means, {"m": (column, 0.5)}, weight="n")["m"]


def target_encode_apply(df: DataFrame, means: DataFrame, key: str, default: float | None) -> DataFrame:
    """Look the mean up; unseen keys take the default."""
    name = f"{key}_avg_price"
    return (df.join(means.select(key, name), key, "left")
            .withColumn(name, F.coalesce(F.col(name), F.lit(default).cast("double"))))


def target_encode_out_of_fold(train: DataFrame, key: str, fold: str, target: str = "price_usd") -> DataFrame:
    """Mean target of the key over the other folds, so no row sees its own price.

    Totals come from the (key, fold) sums, so the rows are aggregated once; the frame joined back has
    at most one row for each key and fold.
    """
    name = f"{key}_avg_price"
    value = F.col(target).try_cast("decimal(38,6)")
    inner = train.groupBy(key, fold).agg(F.coalesce(F.sum(value), F.lit(0).cast("decimal(38,6)")).alias("_s"), F.count(value).alias("_n"))
    whole = Window.partitionBy(key)  # one row for each fold
    rest = inner.select(key, fold, F.try_divide((F.sum("_s").over(whole) - F.col("_s")).cast("double"),
                                                F.sum("_n").over(whole) - F.col("_n")).alias(name))
    return train.join(rest, [key, fold], "left")


# ---- derived columns -------------------------------------------------------------------------

def area_features(df: DataFrame) -> DataFrame:
    a = F.col("area_sqm")
    return df.withColumns({"log_area": F.log1p(a), "area_squared": a * a, "sqrt_area": F.sqrt(a)})


def room_features(df: DataFrame) -> DataFrame:
    r = F.col("rooms").cast("double")
    return df.withColumns({"area_per_room": F.try_divide(F.col("area_sqm"), r), "rooms_squared": r * r})


def size_flags(df: DataFrame) -> DataFrame:
    a = F.col("area_sqm")
    return df.withColumns({"is_large": F.when(a > LARGE_SQM, 1).otherwise(0),
                           "is_small": F.when(a < SMALL_SQM, 1).otherwise(0)})


def age_features(df: DataFrame) -> DataFrame:
    y = F.col("building_age")
    return df.withColumns({"is_new": F.when(y <= NEW_YEARS, 1).otherwise(0),
                           "is_old": F.when(y > OLD_YEARS, 1).otherwise(0), "log_age": F.log1p(y)})


def interactions(df: DataFrame) -> DataFrame:
    a = F.col("area_sqm")
    return df.withColumns({"area_x_rooms": a * F.col("rooms"), "area_x_age": a * F.col("building_age")})


def derived(df: DataFrame) -> DataFrame:
    for step in (area_features, room_features, size_flags, age_features, interactions):
        df = step(df)
    return df


def to_log(c: Column) -> Column:
    return F.log1p(c)


def from_log(c: Column) -> Column:
    return F.expm1(c)


# ---- label encoding --------------------------------------------------------------------------

def label_encode_fit(train: DataFrame, column: str) -> DataFrame:
    return label_index(train, column)


def label_encode_apply(df: DataFrame, labels: DataFrame, column: str, unseen: str = "zero") -> DataFrame:
    """Add ``<column>_encoded``. An unseen label becomes 0, or an error on request."""
    key = "_label"
    table = labels.select(F.col("label").alias(key), F.col("label_index").alias("_index"))
    found = df.withColumn(key, F.coalesce(F.col(column).cast("string"), F.lit("nan"))).join(table, key, "left")
    fallback = F.lit(0.0) if unseen == "zero" else F.raise_error(
        F.concat(F.lit(f"unseen label in {column}: "), F.col(key))).cast("double")
    return found.withColumn(f"{column}_encoded", F.coalesce("_index", fallback)).drop(key, "_index")


def unseen_counts(df: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each labelled column whose label the fit did not see."""
    for c in LABELLED:
        known = tables[c].select(F.col("label").alias(f"_k_{c}"), F.lit(True).alias(f"_seen_{c}"))
        df = df.join(known, F.coalesce(F.col(c).cast("string"), F.lit("nan")) == F.col(f"_k_{c}"), "left")
    return df.agg(*[F.count_if(F.col(f"_seen_{c}").isNull()).alias(c) for c in LABELLED]).unpivot(
        [], list(LABELLED), "column", "unseen")


# ---- scaling ---------------------------------------------------------------------------------

def robust_scale_fit(df: DataFrame, columns: Sequence[str] = FEATURES,
                     accuracy: int | None = None) -> dict[str, tuple[float, float]]:
    """Median and quartile spread of each column; a spread of 0 counts as 1."""
    q = quantiles(df, {(c, p): (c, p) for c in columns for p in (0.25, 0.5, 0.75)}, accuracy=accuracy)
    out = {}
    for c in columns:
        middle = q[(c, 0.5)] or 0.0
        spread = (q[(c, 0.75)] or 0.0) - (q[(c, 0.25)] or 0.0)
        out[c] = (middle, spread or 1.0)
    return out


def robust_scale_apply(df: DataFrame, scale: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in scale.items()})


# ---- everything together ---------------------------------------------------------------------

@dataclass
class FittedFeatures:
    """What training rows taught: small numbers, and one keyed table for each text column.

    A table holds label, index and, for places, the mean price, so each text column costs one
    join when features are made.
    """

    medians: dict[str, float]
    defaults: dict[str, float]
    tables: dict[str, DataFrame]
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)


def fit_tables(train: DataFrame, accuracy: int | None = None) -> FittedFeatures:
    """Medians, then all labels and mean prices in one aggregation; the scale is still to be fitted."""
    medians = fill_values(train, accuracy=accuracy)
    filled = fill_median(train, medians)
    keyed = stored(label_indexes(filled, LABELLED, "price_usd"), "labels")
    tables, defaults = {}, {}
    for c in LABELLED:
        table = keyed.filter(F.col("column") == c)
        if c in ("city", "country"):
            name = f"{c}_avg_price"
            tables[c] = table.select("label", "label_index", F.col("mean").alias(name))
            known = table.filter(F.col("n_mean") > 0).select(F.col("label").alias(c), F.col("mean").alias(name),
                                                             F.col("n_mean").alias("n"))
            defaults[c] = middle_of(known, name)
        else:
            tables[c] = table.select("label", "label_index")
    return FittedFeatures(medians, defaults, tables)


def fit_and_engineer(df: DataFrame, is_train: Column, accuracy: int | None = None) -> tuple[FittedFeatures, DataFrame]:
    """Everything fitted on the training rows, and the features of all rows.

    The features are written once: the scale takes several passes over them and training many more.
    """
    fitted = fit_tables(df.filter(is_train), accuracy)
    made = stored(engineer(df, fitted), "features", spread=True)
    fitted.scale = robust_scale_fit(made.filter(is_train), accuracy=accuracy)
    return fitted, made


def fit_features(train: DataFrame, accuracy: int | None = None) -> FittedFeatures:
    return fit_and_engineer(train, F.lit(True), accuracy)[0]


def engineer(df: DataFrame, fitted: FittedFeatures) -> DataFrame:
    """All features from the fitted values. An unseen place gets the middle mean price, an unseen
    label index 0."""
    df = clip_low(fill_median(df, fitted.medians))
    for c in LABELLED:
        priced = c in fitted.defaults
        key = f"_key_{c}"
        table = fitted.tables[c].select(F.col("label").alias(key), F.col("label_index").alias(f"{c}_encoded"),
                                        *([f"{c}_avg_price"] if priced else []))
        df = df.withColumn(key, F.coalesce(F.col(c).cast("string"), F.lit("nan"))).join(table, key, "left").drop(key)
        filled = {f"{c}_encoded": F.coalesce(f"{c}_encoded", F.lit(0.0))}
        if priced:
            looked_up = F.when(F.col(c).isNotNull(), F.col(f"{c}_avg_price"))
            filled[f"{c}_avg_price"] = F.coalesce(looked_up, F.lit(fitted.defaults[c]).cast("double"))
        df = df.withColumns(filled)
    return derived(df)


def assemble(df: DataFrame, scale: Mapping[str, tuple[float, float]], output: str = "features") -> DataFrame:
    """The scaled feature vector in its fixed order, next to the original columns."""
    names = {c: f"_scaled_{c}" for c in FEATURES}
    scaled = df.withColumns({names[c]: (F.col(c).cast("double") - F.lit(scale[c][0])) / F.lit(scale[c][1])
                             for c in FEATURES})
    # a record to score may hold an impossible number; it becomes NaN in the vector, not a failed job
    return VectorAssembler(inputCols=list(names.values()), outputCol=output, handleInvalid="keep").transform(scaled).drop(*names.values())


def vectorise(made: DataFrame, fitted: FittedFeatures, with_target: bool = True) -> DataFrame:
    """Feature vector and, for training, the log price; rows that are not all finite are dropped."""
    checked = list(FEATURES)
    if with_target:
        made = made.withColumn("label", to_log(F.col("price_usd").cast("double")))
        checked.append("label")
    return assemble(finite_rows(made, checked), fitted.scale)


def prepare(df: DataFrame, fitted: FittedFeatures, with_target: bool = True) -> DataFrame:
    """From listings to feature vectors with values fitted before."""
    return vectorise(engineer(df, fitted), fitted, with_target)
