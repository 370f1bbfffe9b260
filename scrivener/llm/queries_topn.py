"""Problem 5: the best checklist matches and key messages of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm.topn import top_n
from scrivener.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places 1 to 5 of every upload and item, 1 to 3 of every upload's key messages."""
    items = top_n(table(spark, sf_dir, "matched_chunks"), ["upload_id", "item_code"], "similarity_score", "match_id", 5)
    messages = top_n(table(spark, sf_dir, "key_message_matches"), ["upload_id"], "confidence_score", "match_id", 3)
    cols = ["match_id", "place"]
    return items.select(F.lit("item").alias("src"), *cols).unionByName(messages.select(F.lit("key_message").alias("src"), *cols))


def p5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept rows of every upload and item with their scores."""
    return top_n(table(spark, sf_dir, "matched_chunks"), ["upload_id", "item_code"], "similarity_score", "match_id", 5)


QUERIES = {"p5_found": p5_found, "p5_rows": p5_rows}

_RANKED = """
    select {keys}, {score}, match_id, cast(row_number() over (partition by {keys} order by {score} desc, match_id) as int) as place
    from (select distinct {keys}, match_id, {score} from {table} where {score} is not null and not isnan({score}))
"""
_ITEMS = _RANKED.format(keys="upload_id, item_code", score="similarity_score", table="matched_chunks")
_MESSAGES = _RANKED.format(keys="upload_id", score="confidence_score", table="key_message_matches")

SQL = {
    "p5_found": f"""
        select 'item' as src, match_id, place from ({_ITEMS}) where place <= 5
        union all
        select 'key_message' as src, match_id, place from ({_MESSAGES}) where place <= 3
    """,
    "p5_rows": f"select upload_id, item_code, similarity_score, match_id, place from ({_ITEMS}) where place <= 5",
}
