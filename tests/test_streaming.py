from pyspark.sql import functions as F
from pyspark.sql import types as T

from acreage.operators.accounts import user_prediction_stats
from acreage.streaming.scoring import read_requests, rejected_requests, score_requests, score_stream
from acreage.streaming.user_stats import latest_user_stats, user_stats_stream


class FixedModel:
    """Stands in for a fitted model: price is area times 100."""

    def score(self, df, range_pct=10.0):
        return df.withColumns({"predicted_price": F.col("area_sqm") * 100, "currency": F.lit("USD"), "accuracy_pct": F.lit(10.0)})


SCHEMA = T.StructType([T.StructField("request_id", T.IntegerType()), T.StructField("user_id", T.IntegerType()),
                       T.StructField("country", T.StringType()), T.StructField("city", T.StringType()),
                       T.StructField("rooms", T.StringType()), T.StructField("area_sqm", T.DoubleType())])
ROWS = [(1, 7, "A", "a", "2", 50.0), (2, None, "A", "a", "2", 60.0), (3, 7, "A", None, "2", 50.0), (4, 8, "A", "a", "x", 50.0), (5, 8, "A", "b", "3", 70.0)]


def test_scored_stream_equals_the_batch(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(ROWS[:3], SCHEMA).write.parquet(folder)
    start = lambda: score_stream(read_requests(spark, folder, SCHEMA), FixedModel(), out, str(tmp_path / "ck")).awaitTermination()
    start()
    spark.createDataFrame(ROWS[3:], SCHEMA).write.mode("append").parquet(folder)
    start()
    start()  # nothing new, nothing twice
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("request_id", "predicted_price", "building_age").collect())
    assert got == [(1, 5000.0, 10), (5, 7000.0, 10)]
    whole = spark.createDataFrame(ROWS, SCHEMA)
    batch = score_requests(whole, FixedModel()).filter("user_id is not null")
    assert sorted(r["request_id"] for r in batch.collect()) == [1, 5]
    assert {r["request_id"]: r["reason"] for r in rejected_requests(whole).collect()} == {3: "city is required", 4: "rooms is not a number"}


def test_user_stats_stream_equals_the_batch(spark, tmp_path):
    folder, out = str(tmp_path / "h"), str(tmp_path / "s")
    schema = T.StructType.fromDDL("id int, user_id int, predicted_price double, created_at timestamp_ntz")
    rows = spark.range(60).select(F.col("id").cast("int").alias("id"), (F.col("id") % 4).cast("int").alias("user_id"),
                                  (F.col("id") * 10).cast("double").alias("predicted_price"),
                                  F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("created_at"))
    for low, high in ((0, 20), (20, 45), (45, 60)):
        rows.filter(F.col("id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(folder)
        user_stats_stream(read_requests(spark, folder, schema, files_per_batch=1), out, str(tmp_path / "ck")).awaitTermination()
    want = sorted(tuple(r) for r in user_prediction_stats(rows).collect())
    assert sorted(tuple(r) for r in latest_user_stats(spark, out).collect()) == want
