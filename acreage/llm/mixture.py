"""Sources mixed to target weights by hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreage.llm.common import Scratch, apart, n_words

BITS, LEVELS, ALL_BITS = 12, 3, 60


def hash_place(key: Column) -> Column:
    """A fixed place of a document in 0 .. 2^60 - 1, from its id."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size) with ``target``: the budget (``share`` of all sizes) dealt by weight, none above ``limit`` times its size.

    Sources in code-point order, null last, take the weights in turn. What a full source cannot take goes to the others by weight;
    in the order of limit / weight the full ones come first, so one running sum finds them. There is one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double")) \
        .withColumn("most", F.col("source_size") * F.lit(float(limit)))
    everything = Window.partitionBy()
    earlier = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    found = ranked.withColumn("level", level).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    water = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("most") / F.col("weight"))).over(everything)
    return found.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.least("most", water * F.col("weight")))) \
        .select("source", "source_size", "target")


def _same_source(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    return a.join(b.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


@apart
def mix_sources(docs: DataFrame, scratch: Scratch, weights=(5, 2, 1), share: float = 1.5, limit: float = 2.0, key: str = "doc_id",
                source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with _size, _source_size, _target and _copies: how often the mix takes each document.

    A source whose target is q times its size takes each document floor(q) times and, for the rest, once more where the document's hash place
    is below the source's threshold. The threshold comes from histograms: words by source and hash bucket (2^12), then only
    the bucket in which the budget ends is dealt into 2^12 again, and once more; nothing is sorted but the at most 4,096 buckets of a source.
    The last bucket, 2^24 places wide, is taken if that brings the sum nearer to the target. No document is taken more than ``limit`` times, rounded up.

    Null texts have size 0; null sources are one source; rows that share an id share the decision; a null id counts as the empty id. Further columns pass
    through; an empty table gives an empty table. A source that holds most rows is only met in partial sums and in a join with one row for each source; texts stay where they are.
    """
    rows = scratch.put(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), hash_place(F.col(key)).alias("place")))
    bounds = scratch.put(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
                         .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
                         .withColumns({"rest": F.col("target") - F.col("passes") * F.col("source_size"), "prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long")}))
    for depth in range(1, LEVELS + 1):
        low = ALL_BITS - BITS * depth
        inside = _same_source(rows, bounds).filter(F.shiftright("place", low + BITS) == F.col("prefix"))
        hist = inside.groupBy("source", F.shiftright("place", low).alias("bucket")).agg(F.sum("size").alias("words"))
        sums = _same_source(hist, bounds).withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        ends = sums.filter(F.col("upto") > F.col("rest")).groupBy("source").agg(
            F.min("bucket").alias("bucket"), F.min(F.struct("bucket", "upto", "words")).alias("end"))
        bounds = scratch.put(_same_source(bounds, ends, "left").withColumns({
            "prefix": F.col("bucket"), "before": F.col("end.upto") - F.col("end.words"), "after": F.col("end.upto")})
            .select("source", "source_size", "target", "passes", "rest", "prefix", "before", "after"))
    bounds = bounds.withColumn("threshold", F.shiftleft(F.when(F.col("after") - F.col("rest") < F.col("rest") - F.col("before"), F.col("prefix") + 1)
                                                        .otherwise(F.col("prefix")), ALL_BITS - BITS * LEVELS))
    more = (F.col("rest") > 0) & (F.col("threshold").isNull() | (F.col("place") < F.col("threshold")))
    bounds = scratch.put(bounds.select("source", *(F.col(c).alias(f"_{c}") for c in ("source_size", "target", "passes", "rest", "threshold"))).withColumnRenamed("source", "_source"))
    more = (F.col("_rest") > 0) & (F.col("_threshold").isNull() | (hash_place(F.col(key)) < F.col("_threshold")))
    return docs.join(bounds, F.col(source).eqNullSafe(F.col("_source")), "left").withColumns({
        "_size": n_words(F.col(text)), "_copies": F.col("_passes") + F.when(more, 1).otherwise(0)}).drop("_source", "_passes", "_rest", "_threshold")
