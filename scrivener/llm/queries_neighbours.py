"""Problem 6: the most similar vectors of every chunk and criterion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm.neighbours import nearest
from scrivener.session import table


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "content_chunks").select("vec_id", "embedding")
    return chunks.unionByName(table(spark, sf_dir, "checklist_items").select("vec_id", F.col("checklist_embedding").alias("embedding")))


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other vectors of every vector."""
    return nearest(_vectors(spark, sf_dir), "vec_id", "embedding", k=5)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the five most similar of the other, of similarity 0.8 or more.

    The floor bounds the scan, as a neighbour below it is no case; ``p6_neighbours`` has none.
    """
    rows = nearest(_vectors(spark, sf_dir), "vec_id", "embedding", k=5, least=0.8)
    return rows.select(F.least("id", "other").alias("vec_a"), F.greatest("id", "other").alias("vec_b")).distinct()


QUERIES = {"p6_found": p6_found, "p6_neighbours": p6_neighbours}
SQL: dict[str, str] = {}
