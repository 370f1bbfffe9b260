"""Problem 3: units above 1,500 and chunks above 400 characters in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm.pieces import split_column
from scrivener.session import once, table

LIMITS = {"unit": ("source_chunks", "unit_id", 1500, 150), "chunk": ("content_chunks", "vec_id", 400, 40)}


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    parts = []
    for src, (name, key, limit, overlap) in LIMITS.items():
        rows = table(spark, sf_dir, name).select(F.lit(src).alias("src"), F.col(key).cast("bigint").alias("row_id"), "text")
        if with_text:
            rows = once(rows.where(F.char_length("text") > limit), "row_id")
        parts.append(split_column(rows, ["src", "row_id"], "text", limit, overlap, with_text))
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text above its limit, and whether some stretch without a natural boundary had to be cut."""
    by_row = _pieces(spark, sf_dir, False).groupBy("src", "row_id").agg(F.bool_or("forced").alias("forced"))
    return by_row.select("src", "row_id", F.when(F.col("forced"), "forced").otherwise("natural").alias("kind"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces with their text."""
    return _pieces(spark, sf_dir, True)


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}

_STRETCHES = r"""
    select distinct '{src}' as src, {key} as row_id,
        list_bool_or(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(text,
            '[ \t\r\n]*\n[ \t\r\n]*\n[ \t\r\n]*', chr(1), 'g'), '([.!?…])[ \t\r\n]+', '\1' || chr(1), 'g'),
            '([。！？])', '\1' || chr(1), 'g'), chr(1)), lambda s: length_of(s) > {limit})) as forced
    from {name} where length_of(text) > {limit}
"""

SQL = {
    "p3_found": "select src, row_id, case when forced then 'forced' else 'natural' end as kind from ("
    + " union all ".join(_STRETCHES.format(src=s, name=n, key=k, limit=m) for s, (n, k, m, _) in LIMITS.items())
    .replace("length_of(s)", r"length(regexp_replace(s, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'))")
    .replace("length_of(text)", "length(text)")
    + ")",
}
