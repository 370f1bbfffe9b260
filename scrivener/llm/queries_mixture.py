"""Problem 8: a mixture of the sources of mix_targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrivener.llm.mixture import mix, report
from scrivener.session import table


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return report(*mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the mixture and how often each occurs."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


QUERIES = {"p8_shares": p8_shares, "p8_mixture": p8_mixture}
SQL: dict[str, str] = {}
