"""Streams over the event files, run until all files are read."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from acreage.catalog.accounts import _STATS_SQL
from acreage.catalog.modelling import _one_model
from acreage.functions.scalars import round_out
from acreage.plans.views import table, view, with_views
from acreage.session import scratch_path
from acreage.streaming.scoring import read_requests, score_stream
from acreage.streaming.user_stats import latest_user_stats, user_stats_stream


def _event_stream(spark, sf):
    return read_requests(spark, sf, table(spark, sf, "events").schema, glob="events.parquet")


def user_stats(spark, sf):
    """Events as they arrive in the history shape, summed up for each user."""
    history = _event_stream(spark, sf).select(
        F.col("event_id").alias("id"), "user_id", (F.col("value") * 1000).alias("predicted_price"), F.col("ts").alias("created_at"))
    output = scratch_path(spark, "user-stats")
    user_stats_stream(history, output, scratch_path(spark, "user-stats-state")).awaitTermination()
    return round_out(latest_user_stats(spark, output), {"avg_price": 3})


def scored_requests(spark, sf):
    """Submitted records scored by a small model and appended to the history."""
    model = _one_model(spark, sf)
    requests = view(spark, sf, "requests")
    folder = scratch_path(spark, "requests")
    requests.write.parquet(folder)
    stream = read_requests(spark, folder, T.StructType([T.StructField(f.name, f.dataType) for f in requests.schema.fields]))
    output = scratch_path(spark, "scored")
    score_stream(stream, model, output, scratch_path(spark, "scored-state")).awaitTermination()
    return spark.read.parquet(output)


ENTRIES = {
    "user_stats_stream": (user_stats, _STATS_SQL),
    "scored_request_stream": (
        lambda s, d: scored_requests(s, d).select("request_id", "user_id", "city", "rooms", "area_sqm", "building_age"),
        with_views("""SELECT request_id, user_id, city, CAST(rooms AS BIGINT) AS rooms, area_sqm,
            CAST(coalesce(building_age, 10) AS BIGINT) AS building_age FROM requests
            WHERE user_id IS NOT NULL AND city IS NOT NULL AND TRY_CAST(rooms AS DOUBLE) IS NOT NULL""", "requests")),
}
