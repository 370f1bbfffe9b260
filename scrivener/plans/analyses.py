"""Composite queries: review chunks, document analysis, evaluation of reads, moving averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivener.functions import metrics, quality, text
from scrivener.operators.ranges import framed
from scrivener.plans import sql
from scrivener.plans.reviews import ALIASES
from scrivener.session import once, table

_CHUNK = (45, 10)


def review_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 45 words of every unit and its description, with an id and a location that names the part if there are several."""
    units = once(table(spark, sf_dir, "source_chunks").select("unit_id", "source_type", "source_no", "text", "description_of_image_video"), "unit_id")
    full = F.concat_ws(" ", F.when(F.trim("text") != "", F.col("text")), F.when(F.trim("description_of_image_video") != "", F.col("description_of_image_video")))
    words = units.select("unit_id", "source_type", "source_no", text.words(full).alias("w")).where("size(w) > 0")
    parts = words.select("*", F.size(text.windows(F.col("w"), *_CHUNK)).alias("n"), F.posexplode(text.windows(F.col("w"), *_CHUNK)).alias("at", "chunk"))
    place = F.concat_ws(" ", F.initcap("source_type"), F.col("source_no").cast("string"))
    location = F.when(F.col("n") > 1, F.concat(place, F.lit(", part "), (F.col("at") + 1).cast("string"))).otherwise(place)
    return parts.select("unit_id", F.concat(F.lit("unit-"), F.col("unit_id").cast("string"), F.lit("-"), (F.col("at") + 1).cast("string")).alias("chunk_id"), location.alias("location"), "chunk")


def upload_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every upload's units, characters, words, summed and least quality, and weak units."""
    units = once(table(spark, sf_dir, "source_chunks").select("unit_id", "upload_id", "text"), "unit_id")
    t = F.col("t")
    rows = units.withColumn("t", text.clean_text(F.col("text"))).where("t <> ''")
    rows = rows.select("upload_id", F.length(t).alias("chars"), F.size(text.words(t)).alias("words"), quality.text_quality(t).alias("q"))
    weak = (F.col("chars") < 30) | (F.col("q") < 35)
    return rows.groupBy("upload_id").agg(
        F.count("*").alias("units"), F.sum("chars").alias("chars"), F.sum("words").alias("words"), F.round(F.sum("q"), 2).alias("total_quality"),
        F.min("q").alias("least_quality"), F.count_if(weak).alias("weak"),
    )


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the second read of a unit against the first, by engine: count, sum, least and greatest."""
    w = Window.partitionBy("unit_id").orderBy("ocr_id")
    rows = once(table(spark, sf_dir, "ocr_results").select("ocr_id", "unit_id", "text", "engine"), "ocr_id").withColumn("r", F.row_number().over(w))
    a = rows.where("r = 1").select("unit_id", F.col("text").alias("a"))
    b = rows.where("r = 2").select("unit_id", F.col("text").alias("b"), "engine")
    scored = a.join(b, "unit_id").withColumn("accuracy", F.round((1 - metrics.cer(F.col("a"), F.col("b"))) * 100, 2))
    return scored.groupBy("engine").agg(
        F.count("*").alias("cases"), F.round(F.sum("accuracy"), 2).alias("total"), F.min("accuracy").alias("least"), F.max("accuracy").alias("most")
    )


def moving_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every read averaged over the 15 reads around it in its upload, missing ones counting as 0."""
    rows = once(table(spark, sf_dir, "ocr_results").select("ocr_id", "upload_id", "quality_score"), "ocr_id")
    around = framed(rows, "upload_id", "ocr_id", 7, lambda w: F.sum("quality_score").over(w), "sum")
    return around.select("ocr_id", F.round(F.coalesce("sum", F.lit(0.0)) / 15, 4).alias("moving"))


def media_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of media texts at 150 words a minute, as a clock shows it."""
    rows = once(table(spark, sf_dir, "source_chunks").select("unit_id", "source_type", "text"), "unit_id").where("source_type in ('audio', 'video')")
    seconds = F.size(text.words(F.coalesce("text", F.lit("")))) * 0.4
    return rows.select("unit_id", text.clock(seconds).alias("length"))


def brand_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand with its aliases."""
    brands = table(spark, sf_dir, "key_message_matches").select("brand_product").distinct()
    return brands.select("brand_product", F.explode(text.brand_aliases(F.col("brand_product"))).alias("alias"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe names of analysed files."""
    rows = once(table(spark, sf_dir, "analysis_results").select("analysis_id", "file_name"), "analysis_id").where("file_name is not null")
    return rows.select("analysis_id", text.safe_file_name(F.col("file_name")).alias("name"))


def keyword_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored keywords of analyses in their common form, and whether they are too general."""
    rows = once(table(spark, sf_dir, "analysis_results").select("analysis_id", "extracted_keywords"), "analysis_id")
    words = rows.select(F.explode("extracted_keywords").alias("k")).select(text.keyword_form(F.col("k")).alias("keyword")).where("keyword <> ''")
    return words.groupBy("keyword").agg(F.count("*").alias("n")).withColumn("generic", text.is_generic(F.col("keyword")))


QUERIES = {
    "cq3_review_chunks": review_chunks, "cq1_upload_profiles": upload_profiles, "cq8_evaluation": evaluation, "w3_moving_quality": moving_confidence,
    "dt2_media_seconds": media_seconds, "st14_brand_aliases": brand_aliases, "st21_file_names": file_names, "fp12_keyword_kinds": keyword_kinds,
}

_FULL = "trim(coalesce(case when trim(text) <> '' then text || ' ' end, '') || coalesce(case when trim(d) <> '' then d end, ''))"

SQL = {
    "cq3_review_chunks": f"""
        with u as (select distinct on (unit_id) unit_id, source_type, source_no, text, description_of_image_video as d from source_chunks),
        w as (select unit_id, source_type, source_no, {sql.words(_FULL)} as w from u), s as (select *, len(range(0, len(w), 35)) as n, unnest(range(0, len(w), 35)) as a from w)
        select unit_id, 'unit-' || unit_id || '-' || cast(a / 35 as int) + 1 as chunk_id, concat_ws(' ', upper(left(source_type, 1)) || lower(source_type[2:]), cast(source_no as varchar))
            || case when n > 1 then ', part ' || cast(a / 35 as int) + 1 else '' end as location, array_to_string(w[a + 1:a + 45], ' ') as chunk from s""",
    "cq1_upload_profiles": f"""
        with t as (select upload_id, {sql.clean('text')} as t from {sql.UNITS}), q as (select upload_id, length(t) as chars, len({sql.words('t')}) as words, {sql.quality('t')} as q from t where t <> '')
        select upload_id, count(*) as units, sum(chars) as chars, sum(words) as words, round(sum(q), 2) as total_quality, min(q) as least_quality,
            count(*) filter (chars < 30 or q < 35) as weak from q group by 1""",
    "cq8_evaluation": f"""
        with r as (select unit_id, engine, {sql.metric('text')} as t, row_number() over (partition by unit_id order by ocr_id) as r from {sql.READS}),
        p as (select b.engine, a.t as a, b.t as b from r a join r b on a.unit_id = b.unit_id and a.r = 1 and b.r = 2),
        s as (select engine, round((1 - case when a = '' and b = '' then 0.0 when a = '' then 1.0 else least(1.0, levenshtein(a, b) / length(a)) end) * 100, 2) as accuracy from p)
        select engine, count(*) as cases, round(sum(accuracy), 2) as total, min(accuracy) as least, max(accuracy) as most from s group by 1""",
    "w3_moving_quality": f"select ocr_id, round(coalesce(sum(quality_score) over (partition by upload_id order by ocr_id rows between 7 preceding and 7 following), 0) / 15, 4) as moving from {sql.READS}",
    "dt2_media_seconds": f"""
        with s as (select unit_id, cast(floor(len({sql.words("coalesce(text, '')")}) * 0.4 + 0.5) as int) as s from {sql.UNITS} where source_type in ('audio', 'video'))
        select unit_id, lpad(cast(s // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') as length from s""",
    "st14_brand_aliases": f"select brand_product, alias from {ALIASES}",
    "st21_file_names": f"select analysis_id, regexp_replace(trim(file_name), '[^A-Za-z0-9._-]+', '_', 'g') as name from {sql.ANALYSES} where file_name is not null",
    "fp12_keyword_kinds": rf"""
        with k as (select unnest(extracted_keywords) as k from {sql.ANALYSES}),
        f as (select regexp_replace(regexp_replace(regexp_replace(lower(coalesce(k, '')), '[^a-z0-9+/\- ]', ' ', 'g'), ' +', ' ', 'g'), '^[ /-]+|[ /-]+$', '', 'g') as keyword from k),
        t as (select keyword, count(*) as n, list_filter(regexp_extract_all(keyword, '[a-z0-9]+'), lambda x: length(x) > 2) as t from f where keyword <> '' group by 1)
        select keyword, n, len(t) > 0 and len(list_filter(t, lambda x: not list_contains({sql.values(text.GENERIC_WORDS)}, x))) = 0 as generic from t""",
}
