"""Statistics of each user kept current while predictions arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from acreage.operators.snapshot import BUCKETS, Snapshot


def _totals(history: DataFrame) -> DataFrame:
    return history.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("*").alias("total_predictions"), F.count("predicted_price").alias("priced"), F.sum("predicted_price").alias("price_sum"), F.max("created_at").alias("last_prediction"))


def _added(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Totals of a batch on top of those so far."""
    both = new if old is None else old.unionByName(new)
    return both.groupBy("user_id").agg(F.sum("total_predictions").alias("total_predictions"), F.sum("priced").alias("priced"), F.sum("price_sum").alias("price_sum"),
                                       F.max("last_prediction").alias("last_prediction"))


def user_stats_stream(history: DataFrame, output: str, checkpoint: str, once: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Totals of each user in a table of their own, brought up to date by every batch.

    A batch is summed up by user and added to the buckets of the users it has; the others keep their files. A batch that runs again is not added twice. The stream
    itself keeps no state.
    """
    spark = history.sparkSession
    table = Snapshot(spark, output, "user_id", buckets)

    def store(batch: DataFrame, batch_id: int) -> None:
        table.apply(_totals(batch), _added, batch_id)

    writer = history.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_user_stats(spark: SparkSession, output: str) -> DataFrame:
    """Predictions of each user so far: how many, mean price and the last date."""
    rows = Snapshot(spark, output, "user_id").read()
    if rows is None:  # no batch yet
        return spark.createDataFrame([], "user_id long, total_predictions long, avg_price double, last_prediction timestamp")
    return rows.select("user_id", "total_predictions", F.try_divide("price_sum", "priced").alias("avg_price"), "last_prediction")
