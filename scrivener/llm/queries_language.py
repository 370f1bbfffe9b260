"""Problem 4: languages of uploads and units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm.language import fit, label_language, languages, segment_languages
from scrivener.session import cut, once, table


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``unit_id, upload_id, languages`` of every unit, judged once and kept for several uses."""
    units = once(table(spark, sf_dir, "source_chunks").select("unit_id", "upload_id", "text"), "unit_id")
    return cut(languages(units, ["unit_id", "upload_id"], "text", fit(units)))


def _uploads(units: DataFrame) -> DataFrame:
    """The language of most of an upload's text, its share and confidence."""
    parts = units.select("upload_id", F.explode("languages").alias("x")).groupBy("upload_id", "x.lang").agg(
        F.sum("x.letters").alias("letters"), (F.sum(F.col("x.letters") * F.col("x.confidence")) / F.sum("x.letters")).alias("sure")
    )
    best = parts.where("letters > 0").groupBy("upload_id").agg(
        F.max(F.struct("letters", F.col("lang").alias("lang"), "sure")).alias("best"), F.sum("letters").alias("all")
    )
    share = F.col("best.letters") / F.col("all")
    return best.select("upload_id", F.col("best.lang").alias("lang"), (F.col("best.sure") * share).alias("confidence"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses whose label is missing or wrong, and the languages of units that hold several."""
    units = _units(spark, sf_dir)
    analyses = once(table(spark, sf_dir, "analysis_results").select("analysis_id", "upload_id", "detected_language"), "analysis_id")
    judged = analyses.join(_uploads(units), "upload_id")
    wrong = judged.where(~F.coalesce(label_language(F.col("detected_language")) == F.col("lang"), F.lit(False)))
    several = units.where(F.size("languages") > 1).select("unit_id", F.explode("languages.lang").alias("lang"))
    return wrong.select(F.lit("analysis").alias("src"), F.col("analysis_id").alias("row_id"), "lang").unionByName(
        several.select(F.lit("unit").alias("src"), F.col("unit_id").alias("row_id"), "lang")
    )


def p4_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every analysis with the language of its upload and a confidence; null where the upload has no text."""
    analyses = once(table(spark, sf_dir, "analysis_results").select("analysis_id", "upload_id", "detected_language"), "analysis_id")
    return analyses.join(_uploads(_units(spark, sf_dir)), "upload_id", "left").select("analysis_id", "detected_language", "lang", "confidence")


def p4_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit with the languages of its text, their shares and confidences."""
    rows = _units(spark, sf_dir).select("unit_id", F.explode_outer("languages").alias("x"))
    return rows.select("unit_id", "x.lang", "x.letters", "x.share", "x.confidence")


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of one language of every unit, with a confidence."""
    units = once(table(spark, sf_dir, "source_chunks").select("unit_id", "text"), "unit_id")
    return segment_languages(units, ["unit_id"], "text", fit(units)).select("unit_id", "no", "lang", "confidence", "letters", "segment")


QUERIES = {"p4_found": p4_found, "p4_analyses": p4_analyses, "p4_units": p4_units, "p4_segments": p4_segments}
SQL: dict[str, str] = {}
