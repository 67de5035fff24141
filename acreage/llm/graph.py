"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` (a, b) to (node, root): for each linked node the smallest node that can be reached.

    Large and small stars in turn: every node hands its larger neighbours, then its smaller ones, to the smallest.
    A node with many neighbours is only ever counted with partial aggregates and joined to a stored table of
    minima, so Spark can broadcast that table or split the large side. Empty links give an empty table.
    The turns end when every larger node hangs on one node that hangs on none.
    """
    n = links.count()
    edges = scratch.put(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), n)

    def open_ends() -> bool:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up + down > 1").coalesce(n // 50_000 + 1).count() > 0
    while open_ends():
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = scratch.put(both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low")), 2 * n)
        large = scratch.put(both.join(lows, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
                            .filter("u <> v").distinct(), 2 * n)
        lows = scratch.put(large.groupBy("u").agg(F.min("v").alias("low")), n)
        small = large.join(lows, "u")
        edges = scratch.put(small.select("u", F.col("low").alias("v"))
                            .unionAll(small.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))).distinct(), 2 * n)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
