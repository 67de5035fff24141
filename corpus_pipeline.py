"""The corpus pipeline: quality, shared lines, near duplicates, benchmark passages, source weights.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acreage.llm import bottomk, decontaminate, importance, line_dedup, mixture
from acreage.llm.common import Scratch, free_names, table, text_key



def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return importance.resample(docs, table(spark, sf_dir, "labels"), Scratch(spark, "quality")).filter("_kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars follows the text."""
    out = line_dedup.drop_common_lines(docs, Scratch(spark, "lines"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: of those with the smallest id the first by its text's hash; equal rows once. A document without an id stays if its group has none with one.

    Rows are kept, not ids: a row that shares its id with a kept one goes if it belongs to another document's group.
    """
    name, digest = free_names(docs, "row_id", "row_text")
    kept = bottomk.grouped(docs, Scratch(spark, "groups")).filter("first").select(_name(F.col("doc_id")).alias(name), F.col("text_key").alias(digest)).distinct()
    # equal rows meet where the join put them
    return docs.withColumns({name: _name(F.col("doc_id")), digest: text_key(F.col("text"))}).join(kept.hint("merge"), [name, digest], "left_semi") \
        .dropDuplicates([name, digest]).select(*docs.columns)


def _name(key: Column) -> Column:
    """An id as text, empty for null, so that plain equality finds it."""
    return F.coalesce(key.cast("string"), F.lit(""))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the number of the copy."""
    taken = mixture.mix_sources(docs, Scratch(spark, "mix")).filter("_copies > 0")
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy"))


def _own_names(stage):
    """A stage whose input's columns that begin with an underscore, as inner columns of operators do, bear other names while it runs."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clashing = [c for c in docs.columns if c.startswith("_")]
        away = dict(zip(clashing, free_names(docs, *[f"input{c}" for c in clashing])))
        return stage(spark, docs.withColumnsRenamed(away), sf_dir).withColumnsRenamed({other: name for name, other in away.items()})
    return run


STAGES = [(name, _own_names(stage)) for name, stage in [("quality classifier", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]]

#: SQL expresses neither the sampled classifier nor the groups.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again as the next one's."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
