"""The whole profile of a table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from acreage.operators import profiling
from acreage.session import stored
from acreage.sources.files import read_listings, write_listings, write_stats


def treat_missing(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Sparse columns dropped, numeric gaps filled with medians, text gaps with modes."""
    return profiling.impute_mode(profiling.impute_median(profiling.drop_sparse(df), accuracy=accuracy))


def profile(spark: SparkSession, path: str, output: str, fmt: str = "csv", accuracy: int | None = None) -> dict[str, DataFrame]:
    """Read, describe, fill gaps, find insights and save: statistics, report and the filled table.

    Numbers in a CSV are typed by one inference pass; a second one parses the rows and writes them, and all
    that follows reads what was written. The filled table is written first and the statistics read it back.
    """
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path) if fmt == "csv" \
        else read_listings(spark, path, fmt=fmt)
    if fmt == "csv":
        raw = stored(raw, "raw")
    columns, head = profiling.shape(raw)
    before = profiling.missing(raw)
    write_listings(treat_missing(raw, accuracy), os.path.join(output, "processed"), partition_by=())
    filled = spark.read.parquet(os.path.join(output, "processed"))
    stats = profiling.describe(filled, accuracy=accuracy)
    write_stats(stats, os.path.join(output, "numerical_statistics"))
    report = profiling.profile_report(filled, accuracy=accuracy)
    report.write.mode("overwrite").parquet(os.path.join(output, "report"))
    return {"columns": columns, "head": head, "missing": before, "processed": filled, "statistics": stats,
            "top_values": profiling.top_values(filled), "report": spark.read.parquet(os.path.join(output, "report"))}
