"""Problem 7: token ids of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrivener.llm.tokens import count_column, encode_column
from scrivener.session import table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document's text."""
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of ids of every document's text."""
    return count_column(table(spark, sf_dir, "documents"), ["doc_id"], "text")


QUERIES = {"p7_ids": p7_ids, "p7_counts": p7_counts}
SQL: dict[str, str] = {}
