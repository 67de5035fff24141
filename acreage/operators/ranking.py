"""First rows of each group without one task holding a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Up to this many rows Spark itself keeps only the leading rows of each group before the shuffle.
PUSHED_LIMIT = 1_000


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group.

    For small ``n`` the filter on ``row_number`` is planned with a group limit below the shuffle.
    Larger ``n`` ranks the rows of each input partition first; a row outside the first ``n`` of
    its partition cannot be among the first ``n`` of the group. The partition id is the same when
    a task is retried.
    """
    if n > PUSHED_LIMIT:
        sliced = df.withColumn("_slice", F.spark_partition_id())
        part = Window.partitionBy(*by, "_slice").orderBy(*order)
        df = sliced.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= n).drop("_slice", "_rank")
    whole = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= n).drop("_rank")
