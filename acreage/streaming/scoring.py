"""Requests scored as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from acreage.operators.cleaning import PREDICTION_RULES, accepted, rejected, validate


def read_requests(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                  glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Files that keep arriving in a folder, as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def score_requests(requests: DataFrame, model) -> DataFrame:
    """Validated, completed and scored requests. The same plan serves a table and a stream."""
    good = accepted(validate(requests, PREDICTION_RULES))
    typed = good.withColumns({
        "rooms": F.col("rooms").cast("string").try_cast("double").cast("long"),
        "area_sqm": F.col("area_sqm").cast("string").try_cast("double"),
        "building_age": F.col("building_age").cast("string").try_cast("double").cast("long"),
    })
    return model.score(typed)


def rejected_requests(requests: DataFrame) -> DataFrame:
    return rejected(validate(requests, PREDICTION_RULES))


def history_rows(scored: DataFrame) -> DataFrame:
    """What is kept: the scored requests of known users."""
    return scored.filter(F.col("user_id").isNotNull()).drop("currency", "accuracy_pct", "range_pct")


def score_stream(requests: DataFrame, model, output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append scored requests of known users to the history. Stateless; the file sink and the
    checkpoint make every request appear once even when the job restarts."""
    writer = (history_rows(score_requests(requests, model)).writeStream.format("parquet").outputMode("append")
              .option("path", output).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()
