"""Concatenation and distinct values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acreage.functions.scalars import exact_mean
from acreage.session import stored


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames one after the other, matched by column name, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct combinations; those with a null are left out."""
    return df.select(*columns).dropna().distinct().orderBy(*columns)


def label_indexes(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """Distinct texts of each column numbered from 0 in sorted order; null counts as the text 'nan'.

    All columns share one aggregation, which also gives the rows and, with ``target``, the mean of
    each label; rows without a value do not enter the mean. Its result, one row for each label, is
    written once, so the rows are not read again.

    The order is total but no task sees all labels, however alike they begin: they are dealt out by ranges of (column, label), which are sampled from the labels themselves, and numbered where they
    lie. The first label and the number of each column's rows in a range, at most one row for each range and column, say at which number a range begins.
    """
    value = F.col(target).cast("double") if target else F.lit(None).cast("double")
    items = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("label"),
                      F.when(F.col(c).isNotNull(), value).alias("_v")) for c in columns]
    counted = stored(df.select(F.inline(F.array(*items))).groupBy("column", "label")
                     .agg(exact_mean(F.col("_v")).alias("mean"), F.count("*").alias("n"), F.count("_v").alias("n_mean")), "labels")
    # a range is a partition; written with its number, which a later read would not tell
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(counted.repartitionByRange(parts, "column", "label").withColumn("_range", F.spark_partition_id()), "label-ranges")
    before = Window.partitionBy("column").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("column", "_range").agg(F.count("*").alias("_n"))
               .select("column", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    inside = F.row_number().over(Window.partitionBy("column", "_range").orderBy("label"))
    return dealt.withColumn("_place", inside).join(F.broadcast(offsets), ["column", "_range"]).select(  # a row for each range and column
        "column", "label", (F.col("_offset") + F.col("_place") - 1).cast("double").alias("label_index"), "mean", "n", "n_mean")


def label_index(df: DataFrame, column: str) -> DataFrame:
    """The numbered labels of one column."""
    return label_indexes(df, [column]).select("label", "label_index")
