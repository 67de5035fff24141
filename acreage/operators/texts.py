"""Keyword intent of messages and block classes of articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keywords in the order they are tried.
INTENTS = ("hello", "hi", "emi", "roi", "price", "invest", "loan", "market", "buy", "rent", "help")

# Patterns and lengths that tell the block classes apart.
HEADING = r"^[A-Z][A-Z\s\d:]+$"
HEADING_LENGTH = 80
NUMBERED = r"^\d+\.\s+[A-Z]"
SUBHEADING = r"^[A-Z][a-zA-Z\s]+:"
SUBHEADING_LENGTH = 100


def intent(df: DataFrame, column: str = "text", keywords: Sequence[str] = INTENTS) -> DataFrame:
    """The first keyword the lower-cased, trimmed message contains anywhere, even inside a word."""
    message = F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), r"^\s+|\s+$", "")
    found = F.when(message == "", "empty")
    for word in keywords:
        found = found.when(F.contains(message, F.lit(word)), word)
    return df.withColumn("intent", found.otherwise("default"))


def intent_counts(df: DataFrame, column: str = "text", keywords: Sequence[str] = INTENTS) -> DataFrame:
    return intent(df, column, keywords).groupBy("intent").agg(F.count("*").alias("n"))


def blocks(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The blank-line separated blocks of each text with their class and position."""
    parts = df.select(key, F.posexplode(F.split(column, r"\n\n+")).alias("position", "block"))
    parts = parts.withColumn("block", F.regexp_replace("block", r"^\s+|\s+$", "")).filter(F.col("block") != "")
    block, size = F.col("block"), F.length("block")
    kind = (F.when(block.rlike(HEADING) & (size < HEADING_LENGTH), "heading")
            .when(block.rlike(NUMBERED), "numbered")
            .when(F.contains(block, F.lit("\n-")) | block.startswith("-"), "bullets")
            .when(block.rlike(SUBHEADING) & (size < SUBHEADING_LENGTH) & ~F.contains(block, F.lit(".")), "subheading")
            .otherwise("paragraph"))
    return parts.withColumn("kind", kind)


def block_counts(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Blocks of each class in each text."""
    return blocks(df, key, column).groupBy(key, "kind").agg(F.count("*").alias("n"))
