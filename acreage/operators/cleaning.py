"""Filters and cleaning rules for the unified listing table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.functions.scalars import clip, normalise_map
from acreage.operators.quantiles import quantiles

# Bounds of a plausible listing.
ROOMS = (1, 20)
AREA_SQM = (10, 2000)
AGE_YEARS = (0, 150)
PRICE_PERCENTILES = (0.01, 0.99)
HARD_PRICE = (1000, 2000000)
HARD_AREA = (10, 1000)
FENCE = (0.05, 0.95, 1.5)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value, not null and not NaN, in every named column."""
    return df.dropna(subset=list(columns))


def between_filter(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """Closed range; null is dropped."""
    return df.filter(F.col(column).between(lo, hi))


def percentile_band(df: DataFrame, column: str = "price_usd", lo: float = PRICE_PERCENTILES[0],
                    hi: float = PRICE_PERCENTILES[1], accuracy: int | None = None) -> DataFrame:
    """Rows between two percentiles of the whole frame, both ends kept."""
    q = quantiles(df, {"lo": (column, lo), "hi": (column, hi)}, accuracy=accuracy)
    return df.filter(F.lit(False)) if q["lo"] is None else between_filter(df, column, q["lo"], q["hi"])


def clip_column(df: DataFrame, column: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    return df.withColumn(column, clip(F.col(column), lo, hi))


def normalise_furnishing(df: DataFrame) -> DataFrame:
    return df.withColumn("furnishing_status", normalise_map(F.col("furnishing_status")))


def hard_bounds(df: DataFrame) -> DataFrame:
    """Strict price and area bounds applied before modelling."""
    price, area = F.col("price_usd"), F.col("area_sqm")
    return df.filter((price > HARD_PRICE[0]) & (price < HARD_PRICE[1])
                     & (area > HARD_AREA[0]) & (area < HARD_AREA[1]))


def iqr_fence(df: DataFrame, column: str = "price_usd", lo: float = FENCE[0], hi: float = FENCE[1],
              k: float = FENCE[2], accuracy: int | None = None) -> DataFrame:
    """Rows within ``k`` spreads of the outer percentiles."""
    q = quantiles(df, {"lo": (column, lo), "hi": (column, hi)}, accuracy=accuracy)
    if q["lo"] is None:
        return df.filter(F.lit(False))
    spread = q["hi"] - q["lo"]
    return between_filter(df, column, q["lo"] - k * spread, q["hi"] + k * spread)


def clean(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Every cleaning rule in order: price band, rooms, area, age, furnishing."""
    df = percentile_band(df, accuracy=accuracy)
    df = between_filter(df, "rooms", *ROOMS)
    df = between_filter(df, "area_sqm", *AREA_SQM)
    return normalise_furnishing(clip_column(df, "building_age", *AGE_YEARS))


def remove_outliers(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Hard bounds, then the fence computed on what they leave."""
    return iqr_fence(hard_bounds(df), accuracy=accuracy)


def removal_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many rows a step took away."""
    n0 = before.agg(F.count("*").alias("initial_rows"))
    n1 = after.agg(F.count("*")).scalar()
    return (n0.withColumn("final_rows", n1)
            .withColumn("removed_rows", F.col("initial_rows") - F.col("final_rows"))
            .withColumn("removed_pct", F.try_divide(F.col("removed_rows") * 100.0, F.col("initial_rows"))))


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose named columns are all numbers: no null, NaN or infinity.

    A finite number times zero is zero, anything else is not, so one sum tests all columns and each
    column's expression is evaluated once in the pushed-down filter.
    """
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(c).cast("double") * 0.0
    return df.filter(total == 0.0)


def filter_place(df: DataFrame, city: str | None = None, country: str | None = None) -> DataFrame:
    """Listings of a place; a missing argument does not filter."""
    for column, value in (("city", city), ("country", country)):
        if value:
            df = df.filter(F.col(column) == value)
    return df


@dataclass(frozen=True)
class Rules:
    """What a submitted record must hold, and what is filled in when it does not say."""

    required: tuple[str, ...] = ()
    non_blank: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    email: str | None = None
    defaults: Mapping[str, object] = field(default_factory=dict)


PREDICTION_RULES = Rules(
    required=("country", "city", "rooms", "area_sqm"),
    numeric=("rooms", "area_sqm", "building_age", "range_pct"),
    defaults={"balcony": False, "building_age": 10, "furnishing_status": "Unknown", "range_pct": 10.0},
)
CONTACT_RULES = Rules(non_blank=("name", "email", "subject", "message"), email="email")
REGISTRATION_RULES = Rules(non_blank=("username", "email", "password"), email="email")


def _reasons(df: DataFrame, rules: Rules) -> Column:
    def present(c: str) -> Column:
        return F.col(c).isNotNull() if c in df.columns else F.lit(False)

    checks = [F.when(~present(c), F.lit(f"{c} is required")) for c in rules.required]
    checks += [F.when(~present(c) | (F.col(c) == "") if c in df.columns else F.lit(True), F.lit(f"{c} is required"))
               for c in rules.non_blank]
    checks += [F.when(present(c) & F.col(c).cast("string").try_cast("double").isNull(), F.lit(f"{c} is not a number"))
               for c in rules.numeric if c in df.columns]
    if rules.email in df.columns:
        checks.append(F.when(present(rules.email) & (F.col(rules.email) != "") & ~F.contains(F.col(rules.email), F.lit("@")),
                             F.lit("Invalid email format")))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def validate(df: DataFrame, rules: Rules) -> DataFrame:
    """Add ``reasons``, empty for a good record, and fill the defaults."""
    checked = df.withColumn("reasons", _reasons(df, rules))
    fill = {}
    for c, value in rules.defaults.items():
        if c in df.columns:
            fill[c] = F.coalesce(F.col(c), F.lit(value).cast(df.schema[c].dataType))
        else:
            fill[c] = F.lit(value)
    return checked.withColumns(fill) if fill else checked


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).drop("reasons")


def rejected(checked: DataFrame) -> DataFrame:
    """Bad records with the first thing wrong, as the caller would be told."""
    return checked.filter(F.size("reasons") > 0).withColumn("reason", F.element_at("reasons", 1))
