"""Checklists, review results, brands, analyses: aggregations, top lists, joins and stored versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivener.functions import text
from scrivener.operators.checklists import REVIEWERS, SECTIONS as NUMBERED, checklist_rows
from scrivener.operators.matching import alias_positions, correct_words, cosine_best, fuzzy_brands, tfidf_best
from scrivener.operators.ranges import last_known
from scrivener.operators.records import loaded
from scrivener.operators.tables import changed_files, content_key, missing, newest, page_of, page_size, unprocessed, upsert
from scrivener.plans import sql
from scrivener.plans.records import SQL as RECORDS
from scrivener.session import once, table
from scrivener.sources.sinks import message_table

SECTIONS = ("medical review", "legal review", "regulatory review")


def _matches(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return once(table(spark, sf_dir, "matched_chunks").select("match_id", *cols), "match_id")


def _analyses(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return once(table(spark, sf_dir, "analysis_results").select("analysis_id", *cols), "analysis_id")


def _chunks(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return once(table(spark, sf_dir, "content_chunks").select("vec_id", *cols), "vec_id")


def _reads(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return once(table(spark, sf_dir, "ocr_results").select("ocr_id", *cols), "ocr_id")


def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of every upload by section and status."""
    rows = _matches(spark, sf_dir, "upload_id", "section", "status")
    return rows.groupBy("upload_id", "section").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "Satisfied").alias("satisfied"),
        F.count_if(F.col("status") == "Not Satisfied").alias("not_satisfied"),
    )


def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upload complies if none of its results is negative."""
    rows = _matches(spark, sf_dir, "upload_id", "status")
    bad = F.coalesce(F.bool_or(F.col("status") == "Not Satisfied"), F.lit(False))
    return rows.groupBy("upload_id").agg(F.when(bad, "Non-Compliant").otherwise("Compliant").alias("overall"))


def engine_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quality of each engine's reads with a known confidence, of all its reads if there is none."""
    rows = _reads(spark, sf_dir, "engine", "quality_score", "confidence_score")
    known = F.avg(F.when(F.col("confidence_score") >= 0, F.col("quality_score")))
    return rows.groupBy("engine").agg(F.coalesce(F.round(known, 2), F.round(F.avg("quality_score"), 2)).alias("accuracy"))


def quality_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, sum, least and greatest quality of each engine and variant."""
    rows = _reads(spark, sf_dir, "engine", "selected_variant", "quality_score")
    return rows.groupBy("engine", "selected_variant").agg(
        F.count("*").alias("n"), F.round(F.sum("quality_score"), 2).alias("total"), F.min("quality_score").alias("least"), F.max("quality_score").alias("most")
    )


def method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of every upload by extraction method."""
    rows = once(table(spark, sf_dir, "source_chunks").select("unit_id", "upload_id", "metadata.extraction_method"), "unit_id")
    return rows.groupBy("upload_id", F.coalesce("extraction_method", F.lit("unknown")).alias("method")).agg(F.count("*").alias("units"))


def alias_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many brands an alias may mean."""
    brands = table(spark, sf_dir, "key_message_matches").select("brand_product").distinct()
    rows = brands.select("brand_product", F.explode(text.brand_aliases(F.col("brand_product"))).alias("alias"))
    return rows.groupBy("alias").agg(F.count_distinct("brand_product").alias("brands"))


def mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean valid confidence of each engine and mean quality weighted by length."""
    rows = _reads(spark, sf_dir, "engine", "confidence_score", "quality_score", "text_length")
    weight = F.greatest(F.coalesce("text_length", F.lit(0)), F.lit(1))
    quality = F.when(F.col("quality_score").isNotNull(), weight)
    return rows.groupBy("engine").agg(
        F.round(F.avg(F.when(F.col("confidence_score") >= 0, F.least(F.lit(1.0), F.col("confidence_score")))), 4).alias("confidence"),
        F.round(F.sum(F.col("quality_score") * weight) / F.sum(quality), 4).alias("weighted_quality"),
    )


def upload_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of an upload's reads without repetition, in order of their first occurrence."""
    rows = _reads(spark, sf_dir, "upload_id", "warnings").select("upload_id", "ocr_id", F.posexplode("warnings").alias("at", "warning"))
    first = rows.groupBy("upload_id", "warning").agg(F.min(F.struct("ocr_id", "at")).alias("first"))
    listed = first.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("first", "warning"))).alias("w"))
    return listed.select("upload_id", F.array_join(F.transform("w", lambda x: x["warning"]), "; ").alias("warnings"))


def upload_texts(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """The texts of all units of every upload, joined in order; at most ``limit`` characters if it is given."""
    units = once(table(spark, sf_dir, "source_chunks").select("unit_id", "upload_id", "text"), "unit_id")
    rows = units.select("upload_id", "unit_id", text.clean_text(F.col("text")).alias("t")).where("t <> ''")
    listed = rows.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("unit_id", "t"))).alias("x"))
    joined = F.array_join(F.transform("x", lambda y: y["t"]), "\n")
    return listed.select("upload_id", (joined if limit is None else F.substring(joined, 1, limit)).alias("full_text"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight key phrases of every chunk: frequent stretches of 2 to 4 content words, longer ones first."""
    tokens = _chunks(spark, sf_dir, "text").select("vec_id", text.content_tokens(F.col("text")).alias("w"))
    rows = tokens.select("vec_id", F.explode(text.ngrams(F.col("w"), 2, 4)).alias("term"))
    counted = rows.groupBy("vec_id", "term").agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("n"), (-F.length("term")).alias("l"), "term")
    # all candidates of a chunk, as a keyword taken before may rule out any number of them
    listed = counted.groupBy("vec_id").agg(F.array_sort(F.collect_list(order)).alias("x"))
    return listed.select("vec_id", F.array_join(text.distinct_keywords(F.transform("x", lambda y: y["term"]), 8), "; ").alias("keywords"))


def term_counts(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """How often every stretch of 2 to 4 content words occurs in its chunk; the ``most`` commonest of each if it is given."""
    tokens = _chunks(spark, sf_dir, "text").select("vec_id", text.content_tokens(F.col("text")).alias("w"))
    rows = tokens.select("vec_id", F.explode(text.ngrams(F.col("w"), 2, 4)).alias("term"))
    counted = rows.groupBy("vec_id", "term").agg(F.count("*").alias("n"))
    if most is None:
        return counted
    order = Window.partitionBy("vec_id").orderBy(F.desc("n"), F.desc(F.length("term")), "term")
    return counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


def term_counts_120(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 120 commonest stretches of every chunk."""
    return term_counts(spark, sf_dir, 120)


def tfidf_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three chunks nearest to every criterion by shared words."""
    items = table(spark, sf_dir, "checklist_items").select(F.col("vec_id").alias("item_id"), F.col("checklist_description").alias("text"))
    return tfidf_best(items, _chunks(spark, sf_dir, "text"), "item_id", "vec_id", "text", 3, 0.05)


def cosine_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three chunks nearest to every criterion by their vectors."""
    items = table(spark, sf_dir, "checklist_items").select(F.col("vec_id").alias("item_id"), "checklist_embedding")
    return cosine_best(items, _chunks(spark, sf_dir, "embedding"), "item_id", "checklist_embedding", "vec_id", "embedding", 3, 64)


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "key_message_matches").select(F.explode(text.brand_aliases(F.col("brand_product"))).alias("alias")).distinct()


def first_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brand that every unit mentions first, and where."""
    units = once(table(spark, sf_dir, "source_chunks").select("unit_id", "text"), "unit_id")
    found = alias_positions(units, "unit_id", "text", _brands(spark, sf_dir))
    return found.groupBy("unit_id").agg(F.min(F.struct("position", "alias")).alias("x")).select("unit_id", "x.alias", "x.position")


def fuzzy_first_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that machine reads mention, misread or not."""
    found = fuzzy_brands(_reads(spark, sf_dir, "text"), "ocr_id", "text", _brands(spark, sf_dir))
    return found.select("ocr_id", "alias", F.round("score", 4).alias("score"))


def corrected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of machine reads that are nearly a word of the checklists."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    words = _reads(spark, sf_dir, "text").select(F.explode(found).alias("word")).distinct()
    terms = table(spark, sf_dir, "checklist_items").select(F.explode(text.evidence_terms(F.col("checklist_description"))).alias("term")).distinct()
    return correct_words(words, terms).select("word", "best", F.round("score", 4).alias("score"))


def latest_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest analysis of every upload."""
    rows = _analyses(spark, sf_dir, "upload_id", "created_at", "file_name", "file_type")
    return newest(rows, ["upload_id"], ["created_at", "analysis_id"]).select("upload_id", "analysis_id", "file_name", "file_type")


def unreviewed_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads with an analysis but without a review result."""
    analysed = table(spark, sf_dir, "analysis_results").select("upload_id").where("upload_id is not null")
    return missing(analysed, table(spark, sf_dir, "matched_chunks").select("upload_id").distinct(), "upload_id")


def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria of the version updated last, of the reviewed sections, in order of section and code."""
    items = table(spark, sf_dir, "checklist_items")
    last = items.agg(F.max_by("checklist_version", "updated_date").alias("v"))
    section = F.lower(text.clean_text(F.col("section_name")))
    rows = items.join(F.broadcast(last), F.col("checklist_version") == F.col("v")).where(section.isin(*SECTIONS))  # last is one row
    return rows.orderBy("section_name", "item_code", "vec_id").select("vec_id", "item_code", section.alias("section"), "checklist_version")


def judged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result with the words of its criterion, how many of them its chunk holds, and whether they are enough."""
    rows = _matches(spark, sf_dir, "upload_id", "item_code", "checklist_version", "vec_id", "similarity_score")
    items = once(table(spark, sf_dir, "checklist_items").where("item_code is not null").select("item_code", "checklist_version", "checklist_description"), "item_code", "checklist_version")
    items = items.select("item_code", "checklist_version", text.evidence_terms(F.col("checklist_description")).alias("criterion"))
    chunks = _chunks(spark, sf_dir, "text").select("vec_id", text.evidence_terms(F.col("text")).alias("found"))
    full = rows.join(items, ["item_code", "checklist_version"]).join(chunks, "vec_id")
    hits = F.size(F.array_intersect("criterion", "found"))
    enough = text.direct_evidence(F.col("criterion"), F.col("found"))
    return full.select("match_id", "upload_id", "item_code", "vec_id", "similarity_score", "criterion", hits.cast("long").alias("hits"), enough.alias("enough"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the chunk of every result holds enough words of its criterion."""
    return judged_results(spark, sf_dir).select("match_id", "hits", "enough")


def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every upload and item satisfied if a result of similarity 0.55 or more has enough direct evidence."""
    rows = judged_results(spark, sf_dir)
    good = F.col("enough") & (F.col("similarity_score") >= 0.55) & ~F.isnan("similarity_score")
    status = F.when(F.bool_or(F.coalesce(good, F.lit(False))), "Satisfied").otherwise("Not Satisfied")
    return rows.groupBy("upload_id", "item_code").agg(status.alias("status"), F.count("*").alias("results"))


def stored_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version v2 of the checklist updated by version v3: rows replaced by code, dates of creation kept."""
    items = table(spark, sf_dir, "checklist_items").select("item_code", "section_name", "checklist_description", "checklist_version", "created_date", "vec_id").where("item_code is not null")
    old, new = (newest(items.where(F.col("checklist_version") == v), ["item_code"], ["vec_id"]) for v in ("v2", "v3"))
    return upsert(old, new, ["item_code"], keep=["created_date"]).select(
        "item_code", "section_name", "checklist_version", F.unix_seconds("created_date").alias("created"), "vec_id"
    )


def checklist_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checklists as documents have them: a heading before each criterion of a numbered section, and its row."""
    items = table(spark, sf_dir, "checklist_items").where("checklist_version is not null")
    name = text.clean_text(F.col("section_name"))
    head = items.select(F.col("checklist_version").alias("doc"), (F.col("vec_id") * 2).alias("line_no"), F.concat(F.lit("# "), name).alias("line"))
    row = F.concat_ws(" | ", "item_code", "checklist_description", "reviewer_type", "mandatory_status")
    return head.unionByName(items.select(F.col("checklist_version").alias("doc"), (F.col("vec_id") * 2 + 1).alias("line_no"), row.alias("line")))


def parsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria of checklist documents, with their sections."""
    return checklist_rows(checklist_lines(spark, sf_dir)).select("doc", "line_no", "section", "item_code", "description", "reviewer", "mandatory")


def new_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses of 2025 whose content and parameters no earlier analysis had: a key of upload, kind, language and translation."""
    rows = _analyses(spark, sf_dir, "upload_id", "file_type", "target_language", "translated", "created_at")
    key = content_key(*[F.col(c) for c in ("upload_id", "file_type", "target_language", "translated")])
    keyed = rows.select("analysis_id", "created_at", key.alias("key"))
    later = F.col("created_at") >= F.lit("2025-01-01").cast("timestamp")
    return unprocessed(keyed.where(later).select("key"), keyed.where(~later).select("key"), "key")


def changed_message_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-message files whose state of 2025 was not loaded before: name, last change and number of records."""
    rows = table(spark, sf_dir, "key_message_records").groupBy("record_id", "source_file").agg(F.min("received_at").alias("received_at"))  # the first delivery

    def state(df: DataFrame) -> DataFrame:
        return df.groupBy(F.col("source_file").alias("path")).agg(F.unix_micros(F.max("received_at")).alias("modified"), F.count("*").alias("size"))

    return changed_files(state(rows), state(rows.where(F.col("received_at") < F.lit("2025-01-01").cast("timestamp"))))


def message_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid key messages as they replace a stored table."""
    return message_table(loaded(table(spark, sf_dir, "key_message_records")), "record_id").select("record_key", "brand", "key_message", "key_words")


def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses by the extension of their file."""
    rows = _analyses(spark, sf_dir, "file_name").select(text.extension(F.coalesce("file_name", F.lit(""))).alias("extension"))
    return rows.groupBy("extension").agg(F.count("*").alias("analyses"))


def newest_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest results, as a page shows them."""
    rows = _matches(spark, sf_dir, "upload_id", "item_code", "created_date").where("created_date is not null")
    return page_of(rows, [F.desc("created_date"), F.asc("match_id")], 0, page_size(500, 200)).select("match_id", "upload_id", "item_code")


def message_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of every upload within 0.05 of its best score."""
    rows = once(table(spark, sf_dir, "key_message_matches").select("match_id", "upload_id", "confidence_score"), "match_id")
    rows = rows.where("confidence_score is not null and not isnan(confidence_score)")
    best = rows.groupBy("upload_id").agg(F.max("confidence_score").alias("best"))
    full = rows.join(best, "upload_id").where(F.col("confidence_score") >= F.greatest(F.lit(0.05), F.col("best") - 0.05))
    return full.select("upload_id", "match_id", "confidence_score")


def mapped_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best messages of every upload in one line."""
    rows = once(table(spark, sf_dir, "key_message_matches").select("match_id", "upload_id", "brand_product", "key_message", "confidence_score"), "match_id")
    rows = rows.where("confidence_score is not null and not isnan(confidence_score)")
    order = Window.partitionBy("upload_id").orderBy(F.desc("confidence_score"), "match_id")
    top = rows.withColumn("r", F.row_number().over(order)).where("r <= 3")
    part = F.concat(F.coalesce("brand_product", F.lit("")), F.lit(": "), F.coalesce("key_message", F.lit("")))
    listed = top.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("r", part.alias("p")))).alias("x"))
    return listed.select("upload_id", F.array_join(F.transform("x", lambda y: y["p"]), " | ").alias("summary"))


def section_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit with the last heading in capitals before it or at its start."""
    units = once(table(spark, sf_dir, "source_chunks").select("unit_id", "upload_id", "text"), "unit_id")
    line = F.trim(F.split(F.coalesce("text", F.lit("")), "\r?\n", 2)[0])
    heading = F.when(line.rlike("^[A-Z][A-Z ]{4,60}$"), line)
    rows = units.select("unit_id", "upload_id", heading.alias("own"))
    return last_known(rows, "upload_id", "unit_id", "own", "heading").select("unit_id", "heading")


def source_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and numbers of all units of every upload as a comma list in order; a unit without number by its type."""
    units = once(table(spark, sf_dir, "source_chunks").select("unit_id", "upload_id", "source_type", "source_no"), "unit_id")
    number = F.when(F.col("source_no") != 0, F.col("source_no").cast("string"))
    rows = units.select("upload_id", "unit_id", F.concat_ws(" ", F.coalesce("source_type", F.lit("")), number).alias("place"))
    listed = rows.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("unit_id", "place"))).alias("x"))
    return listed.select("upload_id", F.array_join(F.transform("x", lambda y: y["place"]), ", ").alias("location"))


def reply_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model as JSON, fenced or with words around, read again; what is no valid status is negative."""
    rows = _matches(spark, sf_dir, "item_code", "status")
    reply = F.concat(F.lit("Here: ```json {\"results\":[{\"item_code\":\""), F.coalesce("item_code", F.lit("")), F.lit("\",\"status\":\""), F.coalesce("status", F.lit("Maybe")), F.lit("\"}]} ``` done"))
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    status = F.get_json_object(body, "$.results[0].status")
    valid = F.when(status.isin("Satisfied", "Not Satisfied"), status).otherwise("Not Satisfied")
    return rows.select("match_id", valid.alias("status"))


QUERIES = {
    "ag1_section_counts": section_counts, "ag2_overall_status": overall_status, "ag3_engine_accuracy": engine_accuracy, "ag4_quality_by_variant": quality_by_variant,
    "ag5_method_counts": method_counts, "ag7_alias_counts": alias_counts, "ag9_mean_confidence": mean_confidence, "ag14_upload_warnings": upload_warnings,
    "ag15_upload_texts": upload_texts, "kw1_keywords": keywords, "ag16_term_counts_120": term_counts_120,
    "ag16_term_counts": term_counts, "j1_tfidf_matches": tfidf_matches, "j2_cosine_matches": cosine_matches,
    "j3_first_brands": first_brands, "j4_fuzzy_brands": fuzzy_first_brands, "j6_corrected_words": corrected_words, "j8_latest_analyses": latest_analyses,
    "j9_unreviewed_uploads": unreviewed_uploads, "fp1_checklist": checklist, "fp4_evidence": evidence, "cq4_review_status": review_status,
    "sk5_stored_checklist": stored_checklist, "st13_parsed_rows": parsed_rows, "sc2_file_types": file_types, "tk4_newest_reviews": newest_reviews,
    "tk2_message_ranks": message_ranks, "sm2_mapped_summary": mapped_summary, "w4_section_carried": section_carried, "js1_reply_status": reply_status,
    "st22_source_locations": source_locations, "cq10_new_work": new_work, "cq9_changed_message_files": changed_message_files, "sk1_message_tables": message_tables,
}

ALIASES = rf"""
    (select distinct brand_product, alias from (select brand_product, unnest(list_transform([b, p, f, trim(regexp_split_to_array(f, '[-\s/(]')[1])], lambda x: lower(x))) as alias
        from (select brand_product, b, p, trim(regexp_replace(p, '(?i)\b({'|'.join(text.DOSAGE_FORMS)})\b', '', 'g')) as f
            from (select distinct brand_product, trim(brand_product) as b, trim(regexp_replace(trim(brand_product), '\(.*?\)', '', 'g')) as p from key_message_matches)))
     where length(alias) > 2)
"""
GRAMS = f"""
    (select vec_id, term, count(*) as n from (select vec_id, unnest(flatten([
        case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')) else [] end,
        case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) else [] end,
        case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) else [] end])) as term
        from (select vec_id, {sql.content('text')} as w from {sql.CHUNKS})) group by all)
"""
_EVIDENCE = f"""
    with i as (select distinct on (item_code, checklist_version) item_code, checklist_version, {sql.evidence('checklist_description')} as criterion from checklist_items where item_code is not null),
    c as (select vec_id, {sql.evidence('text')} as found from {sql.CHUNKS}),
    e as (select match_id, upload_id, item_code, similarity_score, len(criterion) as n, len(list_intersect(criterion, found)) as hits
        from {sql.MATCHES} m join i using (item_code, checklist_version) join c using (vec_id)),
    d as (select *, n > 0 and (hits >= least(2, n) or hits / n >= 0.45) as enough from e)
"""
_VALID = "(select distinct on (match_id) * from key_message_matches where confidence_score is not null and not isnan(confidence_score))"

SQL = {
    "ag1_section_counts": f"select upload_id, section, count(*) as total, count(*) filter (status = 'Satisfied') as satisfied, count(*) filter (status = 'Not Satisfied') as not_satisfied from {sql.MATCHES} group by all",
    "ag2_overall_status": f"select upload_id, case when count(*) filter (status = 'Not Satisfied') > 0 then 'Non-Compliant' else 'Compliant' end as overall from {sql.MATCHES} group by all",
    "ag3_engine_accuracy": f"select engine, coalesce(round(avg(quality_score) filter (confidence_score >= 0), 2), round(avg(quality_score), 2)) as accuracy from {sql.READS} group by 1",
    "ag4_quality_by_variant": f"select engine, selected_variant, count(*) as n, round(sum(quality_score), 2) as total, min(quality_score) as least, max(quality_score) as most from {sql.READS} group by all",
    "ag5_method_counts": f"select upload_id, coalesce(metadata.extraction_method, 'unknown') as method, count(*) as units from {sql.UNITS} group by all",
    "ag7_alias_counts": f"select alias, count(distinct brand_product) as brands from {ALIASES} group by 1",
    "ag9_mean_confidence": "select engine, round(avg(least(1.0, confidence_score)) filter (confidence_score >= 0), 4) as confidence, round(sum(quality_score * greatest(coalesce(text_length, 0), 1)) / sum(greatest(coalesce(text_length, 0), 1)) filter (quality_score is not null), 4) as weighted_quality from (select distinct on (ocr_id) * from ocr_results) group by 1",
    "ag14_upload_warnings": f"""
        with w as (select upload_id, ocr_id, unnest(warnings) as warning, generate_subscripts(warnings, 1) as pos from {sql.READS}),
        f as (select upload_id, warning, min((ocr_id, pos)) as first from w group by all)
        select upload_id, string_agg(warning, '; ' order by first, warning) as warnings from f group by 1""",
    "st22_source_locations": f"""
        select upload_id, string_agg(coalesce(source_type, '') || case when source_no <> 0 then ' ' || source_no else '' end, ', ' order by unit_id) as location
        from {sql.UNITS} group by 1""",
    "ag15_upload_texts": f"""
        with t as (select upload_id, unit_id, {sql.clean('text')} as t from {sql.UNITS})
        select upload_id, string_agg(t, chr(10) order by unit_id) as full_text from t where t <> '' group by 1""",
    "ag16_term_counts": f"select vec_id, term, n from {GRAMS}",
    "ag16_term_counts_120": f"select vec_id, term, n from {GRAMS} qualify row_number() over (partition by vec_id order by n desc, length(term) desc, term) <= 120",
    "j1_tfidf_matches": f"""
        with q as (select vec_id as item_id, {sql.content('checklist_description')} as w from checklist_items), c as (select vec_id, {sql.content('text')} as w from {sql.CHUNKS}),
        n as (select (select count(*) from q) + (select count(*) from c) as n),
        df as (select term, count(*) as df from (select unnest(list_distinct(w)) as term from q union all select unnest(list_distinct(w)) from c) group by 1),
        qt as (select item_id, term, count(*) as tf from (select item_id, unnest(w) as term from q) group by all), ct as (select vec_id, term, count(*) as tf from (select vec_id, unnest(w) as term from c) group by all),
        qw as (select item_id, term, tf * (ln((n + 1) / (df + 1)) + 1) as w from qt join df using (term), n), cw as (select vec_id, term, tf * (ln((n + 1) / (df + 1)) + 1) as w from ct join df using (term), n),
        qn as (select item_id, term, w / sqrt(sum(w * w) over (partition by item_id)) as w from qw), cn as (select vec_id, term, w / sqrt(sum(w * w) over (partition by vec_id)) as w from cw),
        s as (select item_id, vec_id, round(sum(qn.w * cn.w), 4) as score from qn join cn using (term) group by 1, 2)
        select item_id, vec_id, score, cast(row_number() over (partition by item_id order by score desc, vec_id) as int) as place from s where score >= 0.05 qualify place <= 3""",
    "j2_cosine_matches": f"""
        with good as (select vec_id, embedding as v from {sql.CHUNKS} where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        items as (select vec_id as item_id, checklist_embedding as v from checklist_items where len(checklist_embedding) = 64 and len(list_filter(checklist_embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(checklist_embedding, lambda x: x <> 0)) > 0),
        s as (select item_id, vec_id, round(list_cosine_similarity(cast(i.v as double[]), cast(g.v as double[])), 6) as score from items i, good g)
        select item_id, vec_id, score, cast(row_number() over (partition by item_id order by score desc, vec_id) as int) as place from s qualify place <= 3""",
    "j3_first_brands": f"""
        with a as (select distinct alias from {ALIASES}), u as (select unit_id, lower(coalesce(text, '')) as t from {sql.UNITS}),
        p as (select unit_id, alias, length(regexp_extract(' ' || t, '(?s)^(.*?[^a-z0-9])' || regexp_escape(alias) || '(?:[^a-z0-9]|$)', 1)) - 1 as position
            from u join a on contains(t, alias) where regexp_matches(' ' || t, '[^a-z0-9]' || regexp_escape(alias) || '(?:[^a-z0-9]|$)'))
        select unit_id, alias, cast(position as int) as position from p qualify row_number() over (partition by unit_id order by position, alias) = 1""",
    "j8_latest_analyses": f"select upload_id, analysis_id, file_name, file_type from {sql.ANALYSES} qualify row_number() over (partition by upload_id order by created_at desc nulls last, analysis_id desc) = 1",
    "j9_unreviewed_uploads": "select distinct upload_id from analysis_results where upload_id is not null and upload_id not in (select upload_id from matched_chunks where upload_id is not null)",
    "fp1_checklist": f"""select vec_id, item_code, lower({sql.clean('section_name')}) as section, checklist_version from checklist_items
        where checklist_version = (select arg_max(checklist_version, updated_date) from checklist_items) and lower({sql.clean('section_name')}) in {SECTIONS}""",
    "fp4_evidence": _EVIDENCE + "select match_id, hits, enough from d",
    "cq4_review_status": _EVIDENCE + "select upload_id, item_code, case when count(*) filter (enough and similarity_score >= 0.55 and not isnan(similarity_score)) > 0 then 'Satisfied' else 'Not Satisfied' end as status, count(*) as results from d group by all",
    "sk5_stored_checklist": """
        with o as (select * from checklist_items where checklist_version = 'v2' and item_code is not null qualify row_number() over (partition by item_code order by vec_id desc) = 1),
        n as (select * from checklist_items where checklist_version = 'v3' and item_code is not null qualify row_number() over (partition by item_code order by vec_id desc) = 1)
        select coalesce(n.item_code, o.item_code) as item_code, case when n.item_code is not null then n.section_name else o.section_name end as section_name,
            coalesce(n.checklist_version, o.checklist_version) as checklist_version, cast(epoch(coalesce(o.created_date, n.created_date)) as bigint) as created, coalesce(n.vec_id, o.vec_id) as vec_id
        from o full join n on o.item_code = n.item_code""",
    "st13_parsed_rows": rf"""
        with l as (select checklist_version as doc, vec_id * 2 as line_no, '# ' || {sql.clean('section_name')} as line from checklist_items where checklist_version is not null
            union all select checklist_version, vec_id * 2 + 1, concat_ws(' | ', item_code, checklist_description, reviewer_type, mandatory_status) from checklist_items where checklist_version is not null),
        o as (select *, case {" ".join(f"when contains(lower(line), '{v.lower()}') then '{v}'" for v in NUMBERED.values())} end as opens from (select doc, line_no, {sql.clean('line')} as line from l)),
        c as (select *, last_value(opens ignore nulls) over (partition by doc order by line_no rows between unbounded preceding and current row) as section from o),
        p as (select doc, line_no, section, list_filter(list_transform(string_split(line, '|'), lambda x: {sql.clean('x')}), lambda x: x <> '') as p from c where opens is null and section is not null and contains(line, '|')),
        r as (select doc, line_no, section, p[1] as item_code, case when len(p) >= 4 then array_to_string(p[2:len(p) - 2], ' | ') else p[2] end as description,
            case when len(p) >= 4 then p[len(p) - 1] else case {" ".join(f"when contains(lower(section), '{k}') then '{v}'" for k, v in REVIEWERS.items())} else '' end end as reviewer, p[len(p)] as mandatory
            from p where len(p) >= 3 and not (contains(lower(array_to_string(p, ' ')), 'check item') and regexp_matches(lower(array_to_string(p, ' ')), 'mandatory|owner|reviewer')))
        select * from r where regexp_matches(description, '[A-Za-z]')""",
    "cq10_new_work": f"""
        with k as (select created_at, sha256(upload_id || chr(31) || coalesce(file_type, chr(0)) || chr(31) || coalesce(target_language, chr(0)) || chr(31) || coalesce(cast(translated as varchar), chr(0))) as key
            from {sql.ANALYSES} where upload_id is not null)
        select distinct key from k where created_at >= timestamptz '2025-01-01' and key not in (select key from k where created_at < timestamptz '2025-01-01')""",
    "cq9_changed_message_files": """
        with r as (select record_id, source_file as path, min(received_at) as received_at from key_message_records group by all),
        a as (select path, epoch_us(max(received_at)) as modified, count(*) as size from r group by 1),
        b as (select path, epoch_us(max(received_at)) as modified, count(*) as size from r where received_at < timestamptz '2025-01-01' group by 1)
        select * from a except select * from b""",
    "sk1_message_tables": rf"""
        with m as (select * from ({RECORDS['p2_loaded']})), w as (select *, list_filter(list_transform({sql.words('key_message')}, lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: length(w) > 4) as w from m)
        select key_message_id || '::' || record_id as record_key, brand, key_message, coalesce(nullif(trim(key_words), ''),
            array_to_string(list_transform(list_filter(list_zip(range(1, len(w) + 1), w), lambda z: list_position(w, z[2]) = z[1]), lambda z: z[2])[1:6], ', ')) as key_words from w""",
    "sc2_file_types": rf"select lower(regexp_extract(coalesce(file_name, ''), '(\.[^./\\]+)$', 1)) as extension, count(*) as analyses from {sql.ANALYSES} group by 1",
    "tk4_newest_reviews": f"select match_id, upload_id, item_code from {sql.MATCHES} where created_date is not null order by created_date desc, match_id limit 200",
    "tk2_message_ranks": f"select upload_id, match_id, confidence_score from {_VALID} qualify confidence_score >= greatest(0.05, max(confidence_score) over (partition by upload_id) - 0.05)",
    "sm2_mapped_summary": f"""
        with r as (select *, row_number() over (partition by upload_id order by confidence_score desc, match_id) as r from {_VALID})
        select upload_id, string_agg(coalesce(brand_product, '') || ': ' || coalesce(key_message, ''), ' | ' order by r) as summary from r where r <= 3 group by 1""",
    "w4_section_carried": rf"""
        with u as (select unit_id, upload_id, trim(regexp_split_to_array(coalesce(text, ''), '\r?\n')[1]) as line from {sql.UNITS}),
        h as (select unit_id, upload_id, case when regexp_full_match(line, '[A-Z][A-Z ]{{4,60}}') then line end as heading from u)
        select unit_id, last_value(heading ignore nulls) over (partition by upload_id order by unit_id rows between unbounded preceding and current row) as heading from h""",
    "js1_reply_status": f"select match_id, case when status = 'Satisfied' then status else 'Not Satisfied' end as status from {sql.MATCHES}",
}
