"""The profile of a table that grows: each part is profiled alone, and the parts' states are merged."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acreage.functions.scalars import quoted
from acreage.operators.profiling import column_kinds

#: Sizes of the sketches: distinct values err by about 0.8 %, ranks of quartiles by about 0.1 % of the rows.
DISTINCT_BITS, RANKS = 14, 4_096


def profile_states(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each numeric and text column, from one pass: rows, present values, mean and squared deviations, least and greatest, and mergeable sketches of distinct values and of ranks.

    Numbers that are NaN count as missing, infinities as values without a mean. Text columns have no numbers.
    """
    numeric, text = column_kinds(df)
    chosen = [c for c in (columns if columns is not None else df.columns) if c in numeric or c in text]
    items = []
    for c in chosen:
        x = quoted(c).cast("double")
        number = F.when(~F.isnan(x), x) if c in numeric else F.lit(None).cast("double")
        value = F.when(number.isNotNull(), number.cast("string")) if c in numeric else quoted(c).cast("string")
        items.append(F.struct(F.lit(c).alias("column"), F.lit("numeric" if c in numeric else "text").alias("kind"), number.alias("x"), value.alias("t")))
    if not items:
        raise ValueError("no numeric or text column")
    return df.select(F.inline(F.array(*items))).groupBy("column", "kind").agg(
        F.count("*").alias("rows"), F.count("t").alias("present"), F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("squares"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.hll_sketch_agg("t", DISTINCT_BITS).alias("distinct"), F.kll_sketch_agg_double("x", F.lit(RANKS)).alias("ranks"))


def merge_states(states: DataFrame) -> DataFrame:
    """(column, kind, rows, missing, n_distinct, mean, std, min, q25, q50, q75, max) of all parts together.

    Counts, ends, mean and deviation are those of the whole table but for rounding; distinct values and quartiles are within the sketches' errors. A column that a part lacks counts there as missing
    in no row.
    """
    whole = Window.partitionBy("column", "kind")  # one row for each part
    centred = states.withColumn("_mean", F.try_divide(F.sum(F.col("n") * F.col("mean")).over(whole), F.sum(F.when(F.col("n") > 0, F.col("n"))).over(whole)))
    merged = centred.groupBy("column", "kind").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("rows") - F.col("present")).alias("missing"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"), F.max("_mean").alias("mean"),
        F.sum("n").alias("_n"), F.sum(F.col("squares") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2)).alias("_squares"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("ranks"))).alias("_ranks"))
    quartile = lambda share: F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_ranks", F.lit(share)))
    return merged.select("column", "kind", "rows", "missing", "n_distinct", "mean", F.when(F.col("_n") > 1, F.sqrt(F.col("_squares") / (F.col("_n") - 1))).alias("std"), "min",
                         quartile(0.25).alias("q25"), quartile(0.5).alias("q50"), quartile(0.75).alias("q75"), "max")


class GrowingProfile:
    """States of parts below one folder. A part that comes again replaces its state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, part: str, df: DataFrame) -> None:
        """Profile one part, say a file that has come; no other part is read."""
        profile_states(df).write.mode("overwrite").parquet(os.path.join(self.path, f"part={part}"))

    def profile(self) -> DataFrame:
        return merge_states(self.spark.read.parquet(self.path))
