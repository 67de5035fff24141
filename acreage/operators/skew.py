"""Equi-joins whose hot keys are split over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.session import stored

ROWS_PER_TASK = 2_000_000


def salted_join(big: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner",
                rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Join ``big`` with ``other``; keys with many rows in ``big`` are spread over several salts.

    The keys of ``big`` are counted first; without a hot one this is the plain join, which Spark
    may still broadcast. Only the hot keys are replicated on the other side, once for each salt, so every matching
    pair appears exactly once. The salt is a hash of the row and its partition id, hence the same
    after a retry, and copies of one row in different partitions still spread out. ``how`` may
    be inner or left.
    """
    keys = list(keys)
    hot = (big.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows_per_task)
           .select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_parts")))
    if hot.isEmpty():
        return big.join(other, keys, how)
    hot = stored(hot, "hot-keys")  # at most one row for each ``rows_per_task`` rows of ``big``
    left = (big.join(hot, keys, "left")
            .withColumn("_salt", F.pmod(F.xxhash64(*big.columns, F.spark_partition_id()),
                                        F.coalesce("_parts", F.lit(1))).cast("int"))
            .drop("_parts"))
    right = (other.join(hot, keys, "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
             .drop("_parts"))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
