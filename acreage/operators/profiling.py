"""Column profiles: missing values, statistics, histograms, correlation, outliers, findings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acreage.functions.scalars import finite, quoted
from acreage.operators.combine import union_all
from acreage.operators.quantiles import quantiles
from acreage.operators.ranking import top_per_group
from acreage.session import local_frame

# Thresholds of the findings.
SPARSE_SHARE = 0.5
FEW_DISTINCT = 10
HIGH_CORRELATION = 0.7
HIGH_SKEW = 1.0
WHISKER = 1.5
OUTLIER_SHARE = 0.05
HIGH_CARDINALITY_SHARE = 0.5
HISTOGRAM_BINS = 30


def column_kinds(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and text columns, by schema alone."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]
    return numeric, text


def _null(df: DataFrame, column: str) -> Column:
    missing = quoted(column).isNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(quoted(column))
    return missing


def _number(column: str) -> Column:
    x = quoted(column).cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


def _numbers(df: DataFrame, columns: Sequence[str] | None, first: int | None = None) -> list[str]:
    chosen = list(columns) if columns is not None else column_kinds(df)[0]
    return chosen if first is None else chosen[:first]


def shape(df: DataFrame, head: int = 5) -> tuple[DataFrame, DataFrame]:
    """Column list with types and the row count, and the first rows."""
    fields = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    columns = local_frame(df.sparkSession, fields, "position int, column string, type string")
    return columns.withColumn("rows", df.agg(F.count("*")).scalar()), df.limit(head)


def _by_column(df: DataFrame, columns: Sequence[str], measure: Callable[[str], Column], name: str, *whole: Column) -> DataFrame:
    """(column, ``name``) for each column, and the aggregates ``whole`` of all rows. One scan, whatever the columns are called."""
    wide = df.agg(*whole, *[measure(c).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias(name)) for i, c in enumerate(columns)]
    return wide.select(*wide.columns[:len(whole)], F.inline(F.array(*rows))) if rows else wide.select(
        *wide.columns[:len(whole)], F.lit("").alias("column"), F.lit(None).cast("double").alias(name)).limit(0)


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct values of each column; numeric columns with few are flagged."""
    numeric, text = column_kinds(df)
    chosen = list(columns) if columns is not None else [*numeric, *text]
    if approx:
        counts = _by_column(df, chosen, lambda c: F.approx_count_distinct(F.when(~_null(df, c), quoted(c))), "n_distinct")
    else:
        # (column, value) pairs are grouped with a partial count, so hot values shrink before the shuffle
        pairs = _stack(df, chosen).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
        found = pairs.groupBy("column").agg(F.count("*").alias("n_distinct"))
        names = local_frame(df.sparkSession, [(c,) for c in chosen], "column string")
        counts = names.join(found, "column", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
    return counts.withColumn("maybe_categorical",
                             F.col("column").isin(numeric) & (F.col("n_distinct") < FEW_DISTINCT))


def _stack(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value as text) rows, NaN read as missing."""
    def as_text(c: str) -> Column:
        real = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
        value = quoted(c) + F.lit(0.0) if real else quoted(c)  # one zero, whatever its sign
        return F.when(~_null(df, c), value.cast("string"))
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), as_text(c).alias("value"))
                                        for c in columns])))


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing values of every column, complete columns included. One scan."""
    return (_by_column(df, df.columns, lambda c: F.count_if(_null(df, c)), "missing", F.count("*").alias("_rows"))
            .withColumn("missing_pct", F.try_divide(F.col("missing") * 100.0, F.col("_rows")))
            .withColumnRenamed("_rows", "rows"))


def missing(df: DataFrame) -> DataFrame:
    """Columns with missing values, the emptiest first."""
    return (missing_counts(df).filter(F.col("missing") > 0).select("column", "missing", "missing_pct")
            .orderBy(F.desc("missing_pct"), "column"))


def missing_overall(df: DataFrame) -> DataFrame:
    """Columns with gaps and the missing share of all cells."""
    return missing_counts(df).agg(F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
                                  F.sum("missing").alias("missing_cells"),
                                  F.avg("missing_pct").alias("missing_pct"))


def drop_sparse(df: DataFrame, share: float = SPARSE_SHARE) -> DataFrame:
    """Without the columns whose missing share is above the limit. The schema depends on the data,
    so the counts, one number for each column, are read first."""
    sparse = [r["column"] for r in missing_counts(df).filter(F.col("missing_pct") > share * 100).collect()]
    return df.select(*[quoted(c) for c in df.columns if c not in sparse])


def impute_median(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """Numeric gaps filled with the column's median; whole-number columns become double."""
    chosen = _numbers(df, columns)
    gaps = df.agg(*[F.count_if(_null(df, c)) for c in chosen]).first() if chosen else ()
    holes = [c for c, n in zip(chosen, gaps) if n]
    if not holes:
        return df
    medians = quantiles(df, {c: (c, 0.5) for c in holes}, accuracy=accuracy)
    return df.withColumns({c: F.coalesce(_number(c), F.lit(medians[c]).cast("double")) for c in holes})


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The most frequent value of each column, the smallest on ties. Values are counted with a
    partial count, so no task holds all values of a column."""
    counts = _stack(df, columns).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("k"), "value")).alias("b"))
    return best.select("column", F.col("b.value").alias("mode"), (-F.col("b.k")).alias("n"))


def impute_mode(df: DataFrame, columns: Sequence[str] | None = None, default: str = "Unknown") -> DataFrame:
    """Text gaps filled with the column's mode, or the default when the column is empty."""
    chosen = list(columns) if columns is not None else column_kinds(df)[1]
    if not chosen:
        return df
    modes = {r["column"]: r["mode"] for r in column_modes(df, chosen).collect()}
    return df.withColumns({c: F.coalesce(quoted(c), F.lit(modes.get(c, default))) for c in chosen})


def describe(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row for each numeric column."""
    chosen = _numbers(df, columns)
    q = quantiles(df, {(c, p): (c, p) for c in chosen for p in (0.25, 0.5, 0.75)}, accuracy=accuracy)
    return _by_column(df, chosen, lambda c: F.struct(F.count(_number(c)).alias("count"), F.avg(_number(c)).alias("mean"),
                            F.stddev_samp(_number(c)).alias("std"), F.min(_number(c)).alias("min"),
                            F.lit(q[(c, 0.25)]).cast("double").alias("q25"),
                            F.lit(q[(c, 0.5)]).cast("double").alias("q50"),
                            F.lit(q[(c, 0.75)]).cast("double").alias("q75"),
                            F.max(_number(c)).alias("max")), "s").select("column", "s.*")


def top_values(df: DataFrame, n: int = 5, columns: Sequence[str] | None = None, first: int | None = None) -> DataFrame:
    """The most frequent values of the text columns (all, or the ``first`` few) with their share of all rows."""
    chosen = list(columns) if columns is not None else column_kinds(df)[1][:first]
    stacked = _stack(df, chosen).groupBy("column", "value").agg(F.count("*").alias("n"))
    total = stacked.groupBy("column").agg(F.sum("n").alias("rows"),
                                          F.count_if(F.col("value").isNotNull()).alias("n_distinct"))
    ranked = top_per_group(stacked.filter(F.col("value").isNotNull()), ["column"], [F.desc("n"), F.asc("value")], n)
    return (ranked.join(F.broadcast(total), "column")  # one row for each column
            .select("column", "value", "n", (F.col("n") * 100.0 / F.col("rows")).alias("pct"), "n_distinct"))


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = HISTOGRAM_BINS,
              first: int | None = None) -> DataFrame:
    """Equal-width bins from the smallest to the largest value; the top edge is in the last bin.

    A column with one single value is spread over half a unit on each side. Empty bins are shown. Infinite values are in no bin.
    """
    chosen = _numbers(df, columns, None if columns is not None else first)
    ends = df.agg(*[a for c in chosen for a in (F.min(finite(quoted(c))), F.max(finite(quoted(c))))]).first()
    items, edges = [], []
    for c, lo, hi in zip(chosen, ends[::2], ends[1::2]):
        if lo is None:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        x = finite(quoted(c))
        slot = F.when(x.isNotNull(), F.least(F.lit(bins - 1), F.floor((x - lo) / (hi - lo) * bins))).cast("int")
        items.append(F.struct(F.lit(c).alias("column"), slot.alias("bin")))
        edges.append((c, float(lo), float(hi)))
    spark = df.sparkSession
    grid = (local_frame(spark, edges, "column string, lo double, hi double")
            .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))))
    counts = (df.select(F.inline(F.array(*items))).filter(F.col("bin").isNotNull())
              .groupBy("column", "bin").agg(F.count("*").alias("n")))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, ["column", "bin"], "left").select(
        "column", "bin", (F.col("lo") + F.col("bin") * width).alias("from"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("to"), F.coalesce("n", F.lit(0)).alias("n"))


def _fences(df: DataFrame, columns: Sequence[str], accuracy: int | None) -> dict[str, tuple]:
    q = quantiles(df, {(c, p): (c, p) for c in columns for p in (0.25, 0.5, 0.75)}, accuracy=accuracy)
    out = {}
    for c in columns:
        q1, q2, q3 = (q[(c, p)] for p in (0.25, 0.5, 0.75))
        if q1 is not None:
            out[c] = (q1, q2, q3, q1 - WHISKER * (q3 - q1), q3 + WHISKER * (q3 - q1))
    return out


def box_stats(df: DataFrame, columns: Sequence[str] | None = None, first: int | None = None,
              accuracy: int | None = None) -> DataFrame:
    """Quartiles, the whiskers that reach the last value inside the fences, and the rows beyond."""
    fences = _fences(df, _numbers(df, columns, None if columns is not None else first), accuracy)

    def box(c: str) -> Column:
        (q1, q2, q3, lo, hi), x = fences[c], _number(c)
        return F.struct(
            F.lit(q1).alias("q1"), F.lit(q2).alias("median"), F.lit(q3).alias("q3"),
            F.min(F.when(x >= lo, x)).alias("whisker_low"), F.max(F.when(x <= hi, x)).alias("whisker_high"),
            F.count_if((x < lo) | (x > hi)).alias("outliers"))
    return _by_column(df, list(fences), box, "s").select("column", "s.*")


def box_outliers(df: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    """The rows drawn as points beyond the whiskers of one column."""
    fence = _fences(df, [column], accuracy).get(column)
    if fence is None:
        return df.filter(F.lit(False))
    x = _number(column)
    return df.filter((x < fence[3]) | (x > fence[4]))


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, first: int | None = None,
                 accuracy: int | None = None) -> DataFrame:
    """Rows beyond the quartile fences and whether they are more than the reported share."""
    fences = _fences(df, _numbers(df, columns, None if columns is not None else first), accuracy)
    beyond = _by_column(df, list(fences), lambda c: F.count_if((_number(c) < fences[c][3]) | (_number(c) > fences[c][4])), "outliers",
                        F.count("*").alias("_rows"))
    return (beyond
            .withColumn("outlier_pct", F.try_divide(F.col("outliers") * 100.0, F.col("_rows")))
            .withColumn("flagged", F.col("outliers") > F.col("_rows") * OUTLIER_SHARE).drop("_rows"))


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of columns, over the rows that have both. One scan."""
    chosen = _numbers(df, columns)
    pairs = list(combinations(chosen, 2))
    wide = df.agg(*[F.corr(_number(a), _number(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r{i}").alias("r"))
                     for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))


def high_correlation(df: DataFrame, columns: Sequence[str] | None = None, above: float = HIGH_CORRELATION) -> DataFrame:
    return correlation(df, columns).filter(F.abs("r") > above)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row. Copies collapse in the partial count before the shuffle."""
    copies = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("_copies"))
    return copies.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
                      F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates")).withColumn(
        "duplicate_pct", F.try_divide(F.col("duplicates") * 100.0, F.col("rows")))


def sample_skewness(x: Column) -> Column:
    """The bias-corrected skewness; Spark's own is the population value."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def skew_flags(df: DataFrame, columns: Sequence[str] | None = None, first: int | None = None) -> DataFrame:
    chosen = _numbers(df, columns, None if columns is not None else first)
    return _by_column(df, chosen, lambda c: sample_skewness(_number(c)), "skewness").withColumn("flagged", F.abs("skewness") > HIGH_SKEW)


def category_flags(df: DataFrame, columns: Sequence[str] | None = None, first: int | None = None) -> DataFrame:
    """Text columns with very many values, or with exactly two."""
    chosen = list(columns) if columns is not None else column_kinds(df)[1][:first]
    rows = df.agg(F.count("*")).scalar()
    return (cardinality(df, chosen).select("column", "n_distinct").withColumn("_rows", rows)
            .withColumn("flag", F.when(F.col("n_distinct") > F.col("_rows") * HIGH_CARDINALITY_SHARE, "high_cardinality")
                        .when(F.col("n_distinct") == 2, "binary").otherwise("none")).drop("_rows"))


def profile_report(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """All findings in one long table of (kind, column, metric, value)."""
    numeric, text = column_kinds(df)

    def long(frame: DataFrame, kind: str, metrics: Sequence[str]) -> DataFrame:
        key = F.col("column") if "column" in frame.columns else F.lit(None).cast("string")
        values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return frame.select(F.lit(kind).alias("kind"), key.alias("column"), F.inline(values))

    parts = [
        long(missing_counts(df), "missing", ["missing", "missing_pct"]),
        long(missing_overall(df), "missing_overall", ["columns_with_missing", "missing_pct"]),
        long(duplicate_count(df), "duplicates", ["rows", "duplicates", "duplicate_pct"]),
        long(cardinality(df), "cardinality", ["n_distinct", "maybe_categorical"]),
    ]
    if numeric:
        parts += [
            long(describe(df, accuracy=accuracy), "describe", ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]),
            long(skew_flags(df), "skew", ["skewness", "flagged"]),
            long(iqr_outliers(df, accuracy=accuracy), "outliers", ["outliers", "outlier_pct", "flagged"]),
        ]
    if len(numeric) > 1:
        pairs = correlation(df).withColumn("column", F.concat_ws(" ~ ", "column_a", "column_b"))
        parts.append(long(pairs, "correlation", ["r"]))
    if text:
        flags = category_flags(df)
        parts.append(long(flags.withColumn("high_cardinality", F.col("flag") == "high_cardinality")
                          .withColumn("binary", F.col("flag") == "binary"), "category", ["high_cardinality", "binary"]))
    return union_all(parts)
