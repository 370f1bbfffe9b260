"""Problem 9: abusive, hateful or sexual content of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm.abuse import labelled, score, train
from scrivener.session import table


def _scored(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, train(labelled(documents, table(spark, sf_dir, "moderation_labels"))), keys)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a remark."""
    return _scored(spark, sf_dir, ["doc_id"]).where("unsafe").select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, sf_dir, ["doc_id"])


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each source hold a remark; documents without source are a group of their own."""
    rows = _scored(spark, sf_dir, ["doc_id", "source"])
    return rows.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if("unsafe").alias("unsafe"), F.avg(F.col("unsafe").cast("int")).alias("rate")
    )


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
SQL: dict[str, str] = {}
