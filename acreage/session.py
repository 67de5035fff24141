"""Session defaults and durable cut points."""

from __future__ import annotations

import os
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", memory: str = "12g", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("acreage")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``; without the setting, one in the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{os.urandom(8).hex()}")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch data that no later plan reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame, spread: bool = False) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder.

    ``spread`` is for data that is read many times: when it came out in fewer partitions than there
    are cores, it is dealt out evenly and written once more.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    cut = df.checkpoint(eager=True)
    cores = context.defaultParallelism
    if spread and cut.rdd.getNumPartitions() < cores:
        return cut.repartition(cores).checkpoint(eager=True)
    return cut


def stored(df: DataFrame, name: str, spread: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back. Unlike a checkpoint, a file tells the planner
    its size, so a lookup table that is small enough is broadcast and a large one is not; it is smaller, and
    a pass reads only the columns it needs. ``spread`` as in :func:`durable`."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    cut = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread and cut.select(F.input_file_name()).distinct().count() < cores:
        return stored(cut.repartition(cores), name)
    return cut


# Arrow types of the columns a local frame may have
_ARROW = {"int": "int32", "long": "int64", "double": "float64", "string": "string", "boolean": "bool_"}


def local_frame(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A small frame from driver values whose size the planner knows, so that joins broadcast it.

    A frame made from a list of rows counts as huge and would have the other side shuffled.
    """
    names, kinds = zip(*[part.split() for part in schema.split(",")])
    columns = list(zip(*rows)) or [() for _ in names]
    arrays = [pa.array(list(c), type=getattr(pa, _ARROW[k])()) for c, k in zip(columns, kinds)]
    return spark.createDataFrame(pa.table(dict(zip(names, arrays))))
