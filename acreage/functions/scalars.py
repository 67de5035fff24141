"""Column expressions for cleaning and converting listing fields. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units of local currency for one US dollar.
UNITS_PER_USD = {"BDT": 110, "INR": 83, "PLN": 4, "JPY": 150, "USD": 1}

# Unit factors and the year ages are counted from.
SQM_PER_SQFT = 0.0929
RENT_MULTIPLE = 200
REFERENCE_YEAR = 2024

# Spellings of the furnishing state.
FURNISHING = {
    "furnished": "Furnished",
    "semi-furnished": "Semi-Furnished",
    "semi furnished": "Semi-Furnished",
    "semifurnished": "Semi-Furnished",
    "unfurnished": "Unfurnished",
    "unknown": "Unknown",
    "": "Unknown",
}


def quoted(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def col_or(df: DataFrame, name: str, default=None) -> Column:
    """The named column, or a literal when the frame lacks it."""
    return quoted(name) if name in df.columns else F.lit(default)


def finite(c: Column) -> Column:
    """Null for NaN and both infinities, the only numbers that are not zero when taken times zero."""
    c = c.cast("double")
    return F.when(c * 0.0 == 0.0, c)


def num(c: Column) -> Column:
    """Lenient number: text that is not a number becomes null, and so does NaN.

    Java would read '12d' and '12f' as numbers; those type suffixes are refused.
    """
    text = c.cast("string")
    value = F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))
    suffixed = F.substring(F.rtrim(text), -1, 1).isin("d", "D", "f", "F")  # also the end of "inf"
    return F.when(suffixed & (F.abs(value) < float("inf")), None).otherwise(value)


def money(c: Column) -> Column:
    """Amount written with thousands commas and a taka sign."""
    return num(F.translate(c.cast("string"), ",৳", ""))


def sqft_to_sqm(c: Column) -> Column:
    return c * F.lit(SQM_PER_SQFT)


def to_usd(c: Column, currency: str) -> Column:
    return c / F.lit(float(UNITS_PER_USD[currency]))


def rent_to_price(c: Column) -> Column:
    """A rough sale price from a monthly rent."""
    return c * F.lit(float(RENT_MULTIPLE))


def age(c: Column, ref_year: int = REFERENCE_YEAR) -> Column:
    return F.lit(float(ref_year)) - c


def flag_gt0(c: Column) -> Column:
    return F.when(num(c) > 0, 1).otherwise(0)


def flag_truthy(c: Column) -> Column:
    """1 for any text, the word 'no' and missing values included; 0 for false and for zero."""
    text = c.cast("string")
    return F.when((F.lower(text) == "false") | (num(c) == 0), 0).otherwise(1)


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bounds that keep null as null."""
    out = F.when(c.isNull(), None)
    if lo is not None:
        out = out.when(c < lo, F.lit(lo))
    if hi is not None:
        out = out.when(c > hi, F.lit(hi))
    return out.otherwise(c)


def normalise_map(c: Column, mapping: Mapping[str, str] = FURNISHING, default: str = "Unknown") -> Column:
    """Look up the lower-cased text; whatever is not listed takes the default."""
    lookup = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return F.coalesce(F.try_element_at(lookup, F.lower(c)), F.lit(default))


def price_per_sqm(price: Column, area: Column) -> Column:
    return F.try_divide(price, area)


def with_price_per_sqm(df: DataFrame) -> DataFrame:
    return df.withColumn("price_per_sqm", price_per_sqm(F.col("price_usd"), F.col("area_sqm")))


def exact_sum(c: Column) -> Column:
    """Sum to six decimal places in whole units of the last one, so that it does not depend on the order of the rows; what is no finite number is left out."""
    return F.sum(c.try_cast("decimal(38,6)"))


def exact_mean(c: Column) -> Column:
    """Mean by :func:`exact_sum`."""
    return F.try_divide(exact_sum(c).cast("double"), F.count(c.try_cast("decimal(38,6)")))


def round_out(df: DataFrame, places: Mapping[str, int], half_even: bool = False) -> DataFrame:
    """Round the named columns; half up by default, half even on request."""
    rounder = F.bround if half_even else F.round
    return df.withColumns({c: rounder(c, n) for c, n in places.items()})


def unit_hash(parts: Sequence[Column | str], seed: int = 42) -> Column:
    """A number in [0, 1) fixed by the values alone, so it ignores partitioning and retries."""
    joined = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str)
                                                              else p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def bucket_label(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Half-open ranges: below the first edge, between edges, from the last edge on."""
    out = F.when(c < edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(c < edge, label)
    return out.when(c.isNotNull(), labels[-1])
