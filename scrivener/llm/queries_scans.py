"""Problem 1: noise in scanned units and machine reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm.scans import best_repairs, noise, repaired
from scrivener.session import cut, once, table

#: Without metadata, an image can only have been read by a recogniser, and the lines of a scanned page are several,
#: short, and mostly end within a sentence.
_WRAPPED = r"""
    metadata.extraction_method is null and (source_type = 'image' or source_type = 'page' and text like '%\n%'
    and array_max(transform(split(text, '\\n'), s -> length(s))) <= 110
    and size(filter(split(text, '\\r?\\n'), s -> s rlike '[\\p{L}\\p{N},\\-\\u2010\\u00ac\\u00ad] ?$')) >= 0.4 * size(filter(split(text, '\\r?\\n'), s -> trim(s) <> '')))
"""


def _scanned_and_clean(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    units = once(table(spark, sf_dir, "source_chunks").select("unit_id", "upload_id", "source_type", "text", "metadata"), "unit_id")
    is_scan = F.coalesce(F.col("metadata.extraction_method") == "ocr", F.expr(_WRAPPED), F.lit(False))
    units = units.withColumn("is_scan", is_scan)
    reads = once(table(spark, sf_dir, "ocr_results").select("ocr_id", "upload_id", "text"), "ocr_id")
    pages = units.where("is_scan").select(F.lit("unit").alias("src"), F.col("unit_id").alias("row_id"), "upload_id", "text")
    reads = reads.select(F.lit("ocr").alias("src"), F.col("ocr_id").alias("row_id"), "upload_id", "text")
    clean = units.where("not is_scan and metadata.extraction_method is not null").select("text")
    return pages.unionByName(reads), clean


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with broken or misread words, headers and page numbers."""
    return noise(*_scanned_and_clean(spark, sf_dir), cut)[0]


def p1_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scanned unit and machine read in continuous paragraphs."""
    scanned, clean = _scanned_and_clean(spark, sf_dir)
    lines, repairs, _ = noise(scanned, clean, cut)
    return repaired(scanned, lines, best_repairs(repairs, clean))


QUERIES = {"p1_found": p1_found, "p1_text": p1_text}
SQL: dict[str, str] = {}
