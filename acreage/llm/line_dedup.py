"""Lines that many documents share are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.llm.common import WHITE, Scratch, apart, ascii_lower


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashes(text: Column, min_chars: int) -> Column:
    """For each line two 64-bit hashes of its key, or null if the key is too short to count."""
    def one(line: Column) -> Column:
        key = F.btrim(line, F.lit(WHITE))
        return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))
    return F.transform(_lines(ascii_lower(text)), one)


@apart
def drop_common_lines(docs: DataFrame, scratch: Scratch, min_docs: int = 10, min_chars: int = 1, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """``docs`` without the lines found in at least ``min_docs`` documents.

    Lines are cut at \\n; a line's key has white space stripped at both ends and A-Z in lower case. Adds n_lines
    and n_dropped (long) and replaces the text by the lines that stay, in their order. Each key counts a document once, however
    often it stands there; rows that share an id are one document for the count, and each is cleaned by itself.
    Null and empty texts are one empty line; a null id is an id like any other; further columns pass through unchanged; an empty
    table gives an empty table.

    Only 128-bit hashes with ids are shuffled for the counts. The frequent hashes are a stored table, so Spark broadcasts it while
    it is small and otherwise splits hot lines of the large side.
    """
    found = docs.select(F.col(key).alias("_id"), F.explode(F.array_distinct(F.filter(_hashes(F.col(text), min_chars), lambda h: h.isNotNull()))).alias("_h")) \
        .select("_id", "_h.h1", "_h.h2")
    common = scratch.put(found.groupBy("h1", "h2").agg(F.count_distinct(F.struct("_id")).alias("n"))
                         .filter(F.col("n") >= min_docs).select("h1", "h2"))
    drops = found.join(common, ["h1", "h2"]).groupBy("_id").agg(F.collect_set(F.struct("h1", "h2")).alias("_drops"))
    # the merge hint keeps one plan for every size: texts go by id, and are never met by a broadcast that grows with the input
    rows = docs.join(scratch.put(drops).hint("merge"), F.col(key).eqNullSafe(F.col("_id")), "left").drop("_id")
    kept = F.when(F.col("_drops").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(F.transform(
        F.filter(F.arrays_zip(_lines(F.col(text)).alias("line"), _hashes(F.col(text), min_chars).alias("hash")),
                 lambda x: x["hash"].isNull() | ~F.array_contains(F.col("_drops"), x["hash"])), lambda x: x["line"]), "\n"))
    n_kept = F.when(F.col("_drops").isNull(), F.size(_lines(F.col(text)))).otherwise(
        F.size(F.filter(_hashes(F.col(text), min_chars), lambda h: h.isNull() | ~F.array_contains(F.col("_drops"), h))))
    return (rows.withColumns({"n_lines": F.size(_lines(F.col(text))).cast("long"), "_kept": n_kept.cast("long"), text: kept})
            .withColumn("n_dropped", F.col("n_lines") - F.col("_kept")).drop("_drops", "_kept"))
