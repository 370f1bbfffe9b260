"""Whole reports: analysis of an upload, checklist review, page quality and accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivener.functions import metrics, quality, text
from scrivener.operators.matching import first_reads
from scrivener.plans import mapping, sql
from scrivener.plans.reviews import GRAMS, judged_results
from scrivener.session import once, table

#: Texts of reports.
NO_IMAGE = "No clear image content description could be generated."
NO_FRAMES = "No clear frame-by-frame visual activity or readable visual content detected in the sampled video frames."
NO_SUMMARY = "No summary available."
NO_MATCH = "No matching evidence found."
NO_EVIDENCE = "No extracted evidence available"
NO_MAPPED = "No readable mapped evidence found in uploaded content."
#: Fixed values of a review: best chunks that are tried for an item, and the similarity that evidence needs.
TOP_MATCHES, SIMILAR = 3, 0.55
#: Candidates of an upload's ten key phrases.
MOST_TERMS = 40


def _units(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return once(table(spark, sf_dir, "source_chunks").select("unit_id", "upload_id", *cols), "unit_id")


# ---- analysis --------------------------------------------------------------------------------------------------


def unit_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report says of every unit: number, type, text, method, confidence, length, warnings and description."""
    t = text.clean_text(F.col("text"))
    return _units(spark, sf_dir, "source_no", "source_type", "text", "description_of_image_video", "metadata").select(
        "unit_id", "upload_id", F.col("source_no").alias("number"), F.col("source_type").alias("type"), t.alias("text"),
        "metadata.extraction_method", "metadata.confidence_score", F.coalesce("metadata.text_length", F.length(t)).alias("text_length"),
        F.array_join(F.coalesce("metadata.warnings", F.array().cast("array<string>")), "; ").alias("warnings"),
        F.col("description_of_image_video").alias("description"),
    )


def described(file_type: Column, description: Column) -> Column:
    """The visual description that a kind of file shows: none for texts, a sentence of excuse for images and videos without one."""
    some = F.when(text.clean_text(description) != "", text.clean_text(description))
    return F.when(file_type == "image", F.coalesce(some, F.lit(NO_IMAGE))).when(file_type == "video", F.coalesce(some, F.lit(NO_FRAMES))).when(
        file_type.isin("pdf", "ppt", "pptx"), some
    )


def _descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _units(spark, sf_dir, "description_of_image_video").where("description_of_image_video <> ''")
    # an upload's descriptions are short and few beside its texts
    listed = rows.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("unit_id", F.col("description_of_image_video").alias("d")))).alias("x"))
    return listed.select("upload_id", F.array_join(F.transform("x", lambda y: y["d"]), "\n").alias("description"))


def visual_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The description that the report of every upload shows."""
    docs = mapping.newest_analyses(spark, sf_dir, "file_type")
    rows = docs.join(_descriptions(spark, sf_dir), "upload_id", "left")
    return rows.select("upload_id", "file_type", described(F.col("file_type"), F.col("description")).alias("shown"))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten key phrases of every upload, counted over its units."""
    tokens = _units(spark, sf_dir, "text").where("upload_id is not null").select("upload_id", text.content_tokens(F.col("text")).alias("w"))
    counted = tokens.select("upload_id", F.explode(text.ngrams(F.col("w"), 2, 4)).alias("term")).groupBy("upload_id", "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("upload_id").orderBy(F.desc("n"), F.desc(F.length("term")), "term")
    top = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= MOST_TERMS)
    listed = top.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("r", "term"))).alias("x"))
    return listed.select("upload_id", text.distinct_keywords(F.transform("x", lambda y: y["term"]), 10).alias("keywords"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every upload: file, language labels, units, methods, warnings, description, summary, key phrases, matches.

    The units themselves are rows of ``unit_payload``, not an array in the report, as an upload may have any number.
    The summary of texts is that of their three best matches, else their first sentence; media have none.
    """
    docs = mapping.newest_analyses(spark, sf_dir, "file_name", "file_type", "detected_language", "target_language", "translated")
    units = _units(spark, sf_dir, "text", "metadata").where("upload_id is not null").select(
        "upload_id", "unit_id", text.clean_text(F.col("text")).alias("t"), F.coalesce("metadata.extraction_method", F.lit("unknown")).alias("method"), "metadata.warnings"
    )
    head = text.trim_to_word(text.first_sentence(F.col("t")), 320)
    counts = units.groupBy("upload_id").agg(
        F.count("*").alias("total_source_units"), F.sum(F.length("t")).alias("chars"), F.min(F.when(F.col("t") != "", F.struct("unit_id", head.alias("s"))))["s"].alias("first_sentence")
    )
    methods = units.groupBy("upload_id", "method").agg(F.count("*").alias("n")).groupBy("upload_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "method", F.col("n").cast("string")))), ", ").alias("methods")
    )
    warned = units.select("upload_id", "unit_id", F.posexplode("warnings").alias("at", "warning")).groupBy("upload_id", "warning").agg(F.min(F.struct("unit_id", "at")).alias("first"))
    warnings = warned.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("first", "warning"))).alias("w"))
    warnings = warnings.select("upload_id", F.array_join(F.transform("w", lambda x: x["warning"]), "; ").alias("warnings"))
    part = F.concat_ws(": ", "brand_product", F.regexp_replace(text.clean_text(F.col("key_message")), r"[ .;]+\z", ""))
    best = mapping.exact_mapping(spark, sf_dir).groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("place", part.alias("p"), "key_message_id", "confidence_score"))).alias("m"))
    full = docs.join(counts, "upload_id", "left").join(methods, "upload_id", "left").join(warnings, "upload_id", "left")
    full = full.join(_descriptions(spark, sf_dir), "upload_id", "left").join(_phrases(spark, sf_dir), "upload_id", "left").join(best, "upload_id", "left")
    media = F.col("file_type").isin("audio", "video")
    readable = F.coalesce(F.col("chars") > 0, F.lit(False))
    mapped = text.trim_to_word(F.array_join(F.transform(F.slice("m", 1, 3), lambda x: x["p"]), " | "), 320)
    summary = F.when(~media, F.coalesce(mapped, F.when(F.col("first_sentence") != "", F.col("first_sentence")), F.lit(NO_SUMMARY)))
    matches = F.coalesce(F.size("m"), F.lit(0))
    return full.select(
        "upload_id", "file_name", "file_type", "detected_language", "target_language", "translated",
        F.coalesce("total_source_units", F.lit(0)).alias("total_source_units"), F.coalesce("chars", F.lit(0)).alias("chars"), "methods", F.coalesce("warnings", F.lit("")).alias("warnings"),
        described(F.col("file_type"), F.col("description")).alias("description"), summary.alias("summary"),
        F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), "; ").alias("keywords"),
        F.when(readable, "Text Extracted").otherwise("No readable text extracted").alias("extraction_status"),
        F.when(~readable, "Mapping skipped - no readable text").when(matches > 0, "Mapping Completed").otherwise("Mapping Completed - no matches").alias("mapping_status"),
        F.greatest(matches, F.lit(0)).alias("matches"), F.get("m", F.lit(0))["key_message_id"].alias("best_message"), F.get("m", F.lit(0))["confidence_score"].alias("best_score"),
    )


# ---- review ----------------------------------------------------------------------------------------------------


def _best_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best results of every upload and item, numbered, with their evidence."""
    rows = judged_results(spark, sf_dir).where("similarity_score is not null and not isnan(similarity_score)")
    order = Window.partitionBy("upload_id", "item_code").orderBy(F.desc("similarity_score"), "match_id")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= TOP_MATCHES)


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every upload and item: a valid judgment, else the first of its best chunks that gives enough evidence.

    Judgments are the newest statuses; what is neither satisfied nor not satisfied is none. Items without judgment and
    evidence are not satisfied, with their best chunk's score.
    """
    best = _best_results(spark, sf_dir)
    good = F.col("enough") & (F.col("similarity_score") >= SIMILAR)
    chosen = best.groupBy("upload_id", "item_code").agg(
        F.min(F.when(F.coalesce(good, F.lit(False)), F.struct("r", "similarity_score", "vec_id"))).alias("proof"), F.min(F.struct("r", "similarity_score", "vec_id")).alias("top")
    )
    rows = once(table(spark, sf_dir, "matched_chunks").select("match_id", "upload_id", "item_code", "status", "created_date"), "match_id")
    judged = rows.groupBy("upload_id", "item_code").agg(F.max(F.struct("created_date", "match_id", "status"))["status"].alias("judgment"))
    valid = F.col("judgment").isin("Satisfied", "Not Satisfied")
    proof = F.col("proof").isNotNull()
    full = chosen.join(judged, ["upload_id", "item_code"], "left")
    status = F.when(valid, F.col("judgment")).when(proof, "Satisfied").otherwise("Not Satisfied")
    selected = F.when(~F.coalesce(valid, F.lit(False)) & proof, F.col("proof")).otherwise(F.col("top"))
    return full.select(
        "upload_id", "item_code", status.alias("status"), F.when(valid, "judgment").when(proof, "evidence").otherwise("none").alias("decided_by"),
        selected["similarity_score"].alias("similarity_score"), selected["vec_id"].alias("vec_id"),
    )


def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every upload's overall status and its satisfied and not satisfied items."""
    rows = review_items(spark, sf_dir)
    bad = F.count_if(F.col("status") == "Not Satisfied")
    return rows.groupBy("upload_id").agg(
        F.count("*").alias("items"), F.count_if(F.col("status") == "Satisfied").alias("satisfied"), bad.alias("not_satisfied"),
        F.when(bad > 0, "Non-Compliant").otherwise("Compliant").alias("overall"), F.round(F.avg("similarity_score"), 4).alias("mean_score"),
    )


def fallback_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and evidence of every upload and item by its best chunk alone, the evidence cut at 320 characters."""
    best = _best_results(spark, sf_dir).where("r = 1").select("upload_id", "item_code", "match_id", "vec_id", "criterion", "similarity_score")
    chunks = once(table(spark, sf_dir, "content_chunks").select("vec_id", "text"), "vec_id")
    shown = text.trim_to_word(text.clean_text(F.col("text")), 320)
    rows = best.join(chunks.select("vec_id", shown.alias("evidence")), "vec_id")
    enough = text.direct_evidence(F.col("criterion"), text.evidence_terms(F.col("evidence")))
    status = F.when((F.col("similarity_score") >= SIMILAR) & enough, "Satisfied").otherwise("Not Satisfied")
    return rows.select("match_id", status.alias("status"), F.when(F.col("evidence") == "", NO_MAPPED).otherwise(F.col("evidence")).alias("evidence"))


def empty_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of the newest checklist, not satisfied, for the uploads without any readable unit."""
    readable = _units(spark, sf_dir, "text").where(text.clean_text(F.col("text")) != "").select("upload_id").distinct()
    empty = table(spark, sf_dir, "analysis_results").where("upload_id is not null").select("upload_id").distinct().join(readable, "upload_id", "left_anti")
    items = table(spark, sf_dir, "checklist_items").where("item_code is not null")
    last = items.agg(F.max_by("checklist_version", "updated_date").alias("checklist_version"))
    items = items.join(F.broadcast(last), "checklist_version").select("checklist_version", "item_code", "section_name")  # last is one row
    named = empty.withColumn("checklist_version", F.lit(last.first()[0]))
    return named.join(items, "checklist_version").select("upload_id", "item_code", F.lower(text.clean_text(F.col("section_name"))).alias("section"), F.lit("Not Satisfied").alias("status"), F.lit(NO_EVIDENCE).alias("reasoning"))


def checklist_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every section and version of the checklists, with their codes in order."""
    rows = table(spark, sf_dir, "checklist_items").select("checklist_version", F.lower(text.clean_text(F.col("section_name"))).alias("section"), "item_code")
    return rows.groupBy("checklist_version", "section").agg(F.count("*").alias("items"), F.array_join(F.array_sort(F.collect_set("item_code")), ",").alias("codes"))


# ---- quality and accuracy --------------------------------------------------------------------------------------


def page_quality(t: Column, method: Column, confidence: Column, warnings: Column) -> Column:
    """0 to 99 of a page's cleaned text by how it was extracted: native, ocr (confidence in percent) or both; 0 without text.

    The steps are fixed values.
    """
    n, w = F.length(t), F.size(F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9][A-Za-z0-9%+./-]*"), F.lit(0)))
    noise, garbled, zero = quality.noise_ratio(t), quality.garbled_ratio(t), F.lit(0.0)
    native = (
        90.0 + F.when(n >= 2000, 4.0).when(n >= 800, 3.0).when(n >= 250, 1.5).otherwise(0.0) + F.when(w >= 250, 2.0).when(w >= 80, 1.0).otherwise(0.0)
        + F.when(noise <= 0.015, 1.5).otherwise(0.0) + F.when(garbled <= 0.01, 1.0).otherwise(0.0) - F.least(F.lit(8.0), warnings * 2.0)
        - F.least(F.lit(8.0), noise * 100.0) - F.least(F.lit(6.0), garbled * 80.0)
    )
    ocr = (
        F.greatest(F.lit(65.0), F.coalesce(F.least(F.lit(94.0), confidence), zero)) + F.when(n >= 1000, 5.0).when(n >= 250, 2.0).otherwise(0.0)
        - F.when(noise > 0.06, 8.0).otherwise(0.0) - F.when(garbled > 0.08, 8.0).otherwise(0.0) - F.least(F.lit(12.0), warnings * 3.0)
    )
    base = 84.0 + F.when(n >= 800, 4.0).otherwise(0.0)
    both = (
        F.when(confidence.isNotNull(), base * 0.65 + confidence * 0.35).otherwise(base) - F.least(F.lit(8.0), noise * 100.0)
        - F.least(F.lit(6.0), garbled * 80.0) - F.least(F.lit(10.0), warnings * 2.5)
    )
    score = F.when(method == "native", native).when(method == "ocr", ocr).otherwise(both)
    return F.when(t == "", 0.0).otherwise(quality.half_up(F.greatest(zero, F.least(F.lit(99.0), score)), 2))


def _method(c: Column) -> Column:
    return F.when(c == "ocr", "ocr").when(c.isin("pymupdf", "pdfplumber", "pypdf"), "native").otherwise("hybrid")


def page_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every page by its extraction method."""
    rows = _units(spark, sf_dir, "source_type", "text", "metadata").where("source_type = 'page'")
    rows = rows.select("unit_id", text.clean_text(F.col("text")).alias("t"), _method(F.col("metadata.extraction_method")).alias("method"),
        (F.when(F.col("metadata.confidence_score") >= 0, F.col("metadata.confidence_score")) * 100).alias("confidence"), F.coalesce(F.size("metadata.warnings"), F.lit(0)).alias("warnings"))
    rows = rows.withColumn("warnings", F.greatest("warnings", F.lit(0)))
    return rows.select("unit_id", "method", page_quality(F.col("t"), F.col("method"), F.col("confidence"), F.col("warnings")).alias("quality"))


def _unit_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of every machine-read unit: of pages with more than 50 characters of own text that of their first read
    against it, else the confidence; of sound the confidence."""
    reads = first_reads(once(table(spark, sf_dir, "ocr_results").select("ocr_id", "unit_id", "text", "confidence_score"), "ocr_id"))
    units = _units(spark, sf_dir, "source_no", "source_type", "text", "metadata").select(
        "unit_id", "upload_id", "source_type", F.col("text").alias("own"), F.col("metadata.extraction_method").alias("how"), F.col("metadata.confidence_score").alias("sure")
    )
    rows = units.join(reads.select("unit_id", F.col("text").alias("read"), F.col("confidence_score").alias("read_sure"), F.lit(True).alias("is_read")), "unit_id", "left")
    native = (F.col("source_type") == "page") & F.col("is_read") & (F.length(F.trim("own")) > 50)
    known = F.when(F.col("read_sure") >= 0, F.col("read_sure"))
    sound = F.col("source_type").isin("audio", "video")
    rows = rows.where(F.col("is_read") | sound)
    accuracy = F.when(native, (1 - metrics.cer(F.col("own"), F.col("read"))) * 100).when(sound, F.coalesce("sure", F.lit(0.0)) * 100).otherwise(F.coalesce(known, F.lit(0.0)) * 100)
    method = (
        F.when(native, "pdf_self_referential_cer").when(F.col("source_type") == "page", "confidence_only_scanned_pdf").when(sound, "whisper_confidence_only")
        .otherwise("confidence_only_no_ground_truth")
    )
    return rows.select("unit_id", "upload_id", "source_type", quality.half_up(accuracy, 2).alias("accuracy"), F.coalesce(native, F.lit(False)).alias("measured"), method.alias("method"))


def unit_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of every machine-read unit, whether it was measured, and how."""
    return _unit_accuracy(spark, sf_dir).drop("upload_id")


def upload_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean accuracy of every upload's pages, how many are low (under 70), and whether the last one was measured."""
    rows = _unit_accuracy(spark, sf_dir).where("source_type = 'page'")
    low = F.array_sort(F.collect_list(F.when(F.col("accuracy") < 70, F.col("unit_id"))))
    return rows.groupBy("upload_id").agg(
        F.count("*").alias("pages"), (F.floor(F.sum(F.round(F.col("accuracy") * 100).cast("long")) / F.count("*") + 0.5) / 100).alias("accuracy"), F.max_by("measured", "unit_id").alias("measured"),
        F.array_join(F.transform(low, lambda p: F.concat(F.lit("Page "), p.cast("string"), F.lit(" has low extraction quality"))), "; ").alias("warnings"),
    )


def estimated_quality(t: Column, description: Column, kind: Column, warnings: Column) -> Column:
    """Estimate of a unit from what it holds: readable text and its length, a description, warnings; 0 to 100."""
    has = text.clean_text(description) != ""
    n = F.length(t)
    base = F.when(n >= 500, 85.0).when(n >= 120, 80.0).when(n >= 30, 75.0).when(n > 0, 70.0).when(kind.isin("image", "video") & has, 55.0).otherwise(0.0)
    score = base + F.when(has & kind.isin("page", "pdf", "ppt", "slide", "image", "video"), 10.0).otherwise(0.0) - F.least(F.lit(30.0), warnings * 10.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated quality of every unit."""
    rows = _units(spark, sf_dir, "source_type", "text", "description_of_image_video", "metadata")
    warnings = F.greatest(F.coalesce(F.size("metadata.warnings"), F.lit(0)), F.lit(0))
    d = F.coalesce("description_of_image_video", F.lit(""))
    return rows.select("unit_id", estimated_quality(text.clean_text(F.col("text")), d, F.col("source_type"), warnings).alias("estimate"))


#: What a case is evaluated as, by its file's extension.
MODULES = {
    "pdf_text": ".pdf", "word_extraction": ".doc .docx .docm .dot .dotx .dotm .rtf", "ppt_extraction": ".ppt .pptx", "excel_extraction": ".xls .xlsx .csv",
    "image_ocr": ".avif .bmp .gif .heic .heif .jpg .jpeg .png .tif .tiff .webp", "audio_transcript": ".flac .m4a .mp3 .ogg .wav", "video_frame_ocr": ".avi .mkv .mov .mp4",
}


def module_of(extension: Column, task: Column) -> Column:
    """The module that evaluates a file, by its task and extension."""

    def of(module: str) -> Column:
        return extension.isin(*MODULES[module].split())

    ocr = task.contains("ocr")
    out = F.when(task.contains("description"), F.when(of("image_ocr"), "image_description").otherwise("video_frame_ocr")).when(ocr & of("pdf_text"), "scanned_pdf_ocr")
    out = out.when(task.contains("transcript") & of("video_frame_ocr"), "video_audio_transcript")
    for module in MODULES:
        out = out.when(of(module), module)
    return out.otherwise("text")


def metric_of_module(module: Column) -> Column:
    """The metric of a module."""
    return (
        F.when(module.isin("audio_transcript", "video_audio_transcript"), "wer_accuracy").when(module == "image_description", "manual_or_semantic")
        .when(module.contains("ocr") | module.isin("word_extraction", "ppt_extraction", "excel_extraction", "pdf_text"), "word_accuracy").otherwise("text_similarity")
    )


def case_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module and metric of every analysed file; a transcript makes the task."""
    rows = once(table(spark, sf_dir, "analysis_results").select("analysis_id", "file_name", "transcript_available"), "analysis_id")
    task = F.when(F.col("transcript_available"), "transcript").otherwise("")
    module = module_of(text.extension(F.coalesce("file_name", F.lit(""))), task)
    return rows.select("analysis_id", module.alias("module"), metric_of_module(module).alias("metric"))


def evaluated(pairs: DataFrame) -> DataFrame:
    """``module, case_id, metric, accuracy, error`` of cases ``case_id, module, expected, actual``.

    A case without expected text fails with a reason instead of a score. WER may exceed 100; its accuracy is at least 0.
    """
    rows = metrics.word_rates(pairs, metrics.evaluation_tokens(F.col("expected")), metrics.evaluation_tokens(F.col("actual")), "wer")
    rows = metrics.token_f1(rows, F.col("expected"), F.col("actual"), "f1").withColumn("metric", metric_of_module(F.col("module")))
    word = F.round(F.greatest(F.lit(0.0), 1 - F.col("wer")) * 100, 2)
    accuracy = F.when(F.col("metric").isin("wer_accuracy", "word_accuracy"), word).when(F.col("metric") == "manual_or_semantic", F.col("f1")).otherwise(
        metrics.text_similarity(F.col("expected"), F.col("actual"))
    )
    failed = F.col("expected").isNull()
    error = F.when(failed, F.concat(F.lit("Case for module '"), "module", F.lit("' needs expected text.")))
    return rows.select("module", "case_id", "metric", F.when(~failed, accuracy).alias("accuracy"), error.alias("error"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = once(table(spark, sf_dir, "ocr_results").select("ocr_id", "unit_id", "text", "engine"), "ocr_id")
    first = first_reads(reads).select("unit_id", F.col("text").alias("expected"), F.col("ocr_id").alias("first"))
    rest = reads.join(first, "unit_id").where("ocr_id <> first")
    module = F.when(F.col("engine") == "tesseract", "scanned_pdf_ocr").when(F.col("engine") == "easyocr", "image_ocr").otherwise("text")
    return rest.select(F.col("ocr_id").alias("case_id"), module.alias("module"), "expected", F.coalesce("text", F.lit("")).alias("actual"))


def evaluation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases, failures, mean, least and greatest accuracy of every module over second reads against first ones."""
    rows = evaluated(_cases(spark, sf_dir))
    return rows.groupBy("module").agg(
        F.count("accuracy").alias("cases"), F.count("error").alias("failures"), F.round(F.avg("accuracy"), 2).alias("mean"),
        F.round(F.min("accuracy"), 2).alias("least"), F.round(F.max("accuracy"), 2).alias("most"),
    )


def evaluation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that cannot be evaluated, and why."""
    rows = _cases(spark, sf_dir).where("expected is null")
    return rows.select("case_id", "module", F.concat(F.lit("Case for module '"), "module", F.lit("' needs expected text.")).alias("error"))


QUERIES = {
    "cq13_unit_payload": unit_payload, "cq12_visual_descriptions": visual_descriptions, "cq1_analyses": analyses, "cq4_review_items": review_items,
    "cq4_review_report": review_report, "cq6_fallback_judgments": fallback_judgments, "cq7_empty_reports": empty_reports, "ag6_checklist_sections": checklist_sections,
    "sf5_page_quality": page_qualities, "sf12_unit_accuracy": unit_accuracy, "ag12_upload_accuracy": upload_accuracy, "sf11_estimates": estimates,
    "sf10_case_modules": case_modules, "cq8_evaluation_results": evaluation_results, "cq8_failures": evaluation_failures,
}

_PAYLOAD = "(select distinct on (unit_id) * from source_chunks)"
_NEWEST = f"(select * from {sql.ANALYSES} where upload_id is not null qualify row_number() over (partition by upload_id order by created_at desc nulls last, analysis_id desc) = 1)"
_DESCRIBED = f"(select upload_id, string_agg(description_of_image_video, chr(10) order by unit_id) as d from {_PAYLOAD} where description_of_image_video <> '' group by 1)"


def _shown(kind: str, d: str) -> str:
    some = f"nullif({sql.clean(d)}, '')"
    return f"case when {kind} = 'image' then coalesce({some}, '{NO_IMAGE}') when {kind} = 'video' then coalesce({some}, '{NO_FRAMES}') when {kind} in ('pdf', 'ppt', 'pptx') then {some} end"


def distinct_terms(terms: str, most: int) -> str:
    """Of a list of key phrases in order: in common form, without general ones and those that hold or lie in one before."""
    form = rf"regexp_replace(regexp_replace(regexp_replace(lower(x), '[^a-z0-9+/\- ]', ' ', 'g'), ' +', ' ', 'g'), '^[ /-]+|[ /-]+$', '', 'g')"
    own = "list_filter(regexp_extract_all(x, '[a-z0-9]+'), lambda y: length(y) > 2)"
    generic = f"len({own}) > 0 and len(list_filter({own}, lambda y: not list_contains({sql.values(list(text.GENERIC_WORDS))}, y))) = 0"
    kept = f"list_filter(list_transform({terms}, lambda x: {form}), lambda x: x <> '' and not ({generic}))"
    clash = "len(list_filter(acc, lambda t: contains(t, x[1]) or contains(x[1], t))) > 0"
    return f"coalesce(list_reduce(list_transform({kept}, lambda x: [x]), lambda acc, x: case when len(acc) >= {most} or {clash} then acc else list_concat(acc, x) end, [])[1:{most}], [])"


_PHRASE_TERMS = f"""
    (select upload_id, term, count(*) as n from (select upload_id, unnest(flatten([
        case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')) else [] end,
        case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) else [] end,
        case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) else [] end])) as term
        from (select upload_id, {sql.content('text')} as w from {sql.UNITS} where upload_id is not null)) group by all)
"""


def _cut(x: str, n: int) -> str:
    return f"case when length({x}) <= {n} then {x} when instr(left({x}, {n}), ' ') > 0 then regexp_replace(left({x}, {n}), ' [^ ]*$', '') || '...' else left({x}, {n}) || '...' end"


_SENTENCE = rf"list_filter(list_transform(regexp_split_to_array(regexp_replace(t, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: {sql.strip('s')}), lambda s: s <> '')[1]"
_EVIDENCE = f"""
    i as (select distinct on (item_code, checklist_version) item_code, checklist_version, {sql.evidence('checklist_description')} as criterion from checklist_items where item_code is not null),
    c as (select vec_id, text, {sql.evidence('text')} as found from {sql.CHUNKS}),
    e as (select match_id, upload_id, item_code, similarity_score, vec_id, text, criterion, len(criterion) as n, len(list_intersect(criterion, found)) as hits
        from {sql.MATCHES} m join i using (item_code, checklist_version) join c using (vec_id) where similarity_score is not null and not isnan(similarity_score)),
    b as (select *, n > 0 and (hits >= least(2, n) or hits / n >= 0.45) as enough, row_number() over (partition by upload_id, item_code order by similarity_score desc, match_id) as r from e qualify r <= 3)
"""
_ITEMS = f"""
    with {_EVIDENCE}, ch as (select upload_id, item_code, min(r) filter (enough and similarity_score >= 0.55) as proof from b group by all),
    j as (select upload_id, item_code, status as judgment from {sql.MATCHES} qualify row_number() over (partition by upload_id, item_code order by created_date desc nulls last, match_id desc) = 1),
    f as (select ch.*, judgment, coalesce(judgment in ('Satisfied', 'Not Satisfied'), false) as valid from ch left join j on j.upload_id is not distinct from ch.upload_id and j.item_code is not distinct from ch.item_code),
    it as (select f.upload_id, f.item_code, case when valid then judgment when proof is not null then 'Satisfied' else 'Not Satisfied' end as status,
        case when valid then 'judgment' when proof is not null then 'evidence' else 'none' end as decided_by, b.similarity_score, b.vec_id
        from f join b on b.upload_id is not distinct from f.upload_id and b.item_code is not distinct from f.item_code and b.r = case when not valid and proof is not null then proof else 1 end)
"""
_ACC = f"""
    with r as (select unit_id, text as read, confidence_score as rs from {sql.READS} qualify row_number() over (partition by unit_id order by ocr_id) = 1),
    x as (select u.unit_id, upload_id, source_type, u.text as own, metadata.confidence_score as sure, r.unit_id is not null as is_read, read, rs from {sql.UNITS} u left join r using (unit_id)
        where r.unit_id is not null or source_type in ('audio', 'video')),
    y as (select *, coalesce(source_type = 'page' and is_read and length(trim(own)) > 50, false) as measured, {sql.metric('own')} as a, {sql.metric('read')} as b from x),
    z as (select unit_id, upload_id, source_type, measured, floor(case when measured then (1 - case when a = '' and b = '' then 0.0 when a = '' then 1.0 else least(1.0, levenshtein(a, b) / length(a)) end) * 100
        when source_type in ('audio', 'video') then coalesce(sure, 0) * 100 else coalesce(case when rs >= 0 then rs end, 0) * 100 end * 100.0 + 0.5) / 100.0 as accuracy,
        case when measured then 'pdf_self_referential_cer' when source_type = 'page' then 'confidence_only_scanned_pdf' when source_type in ('audio', 'video') then 'whisper_confidence_only'
        else 'confidence_only_no_ground_truth' end as method from y)
"""
_GARBLED = r"""list_filter(w, lambda x: len(regexp_extract_all(x, '[A-Za-z]')) >= 5 and (
    len(regexp_extract_all(x, '[AEIOUaeiou]')) / len(regexp_extract_all(x, '[A-Za-z]')) < 0.16 or regexp_matches(x, '(?i)[bcdfghjklmnpqrstvwxyz]{6,}')))"""


def _case(options: dict[str, str], x: str) -> str:
    return " ".join(f"when {x} in ({', '.join(repr(e) for e in v.split())}) then '{k}'" for k, v in options.items())


SQL = {
    "kw1_keywords": f"""
        select vec_id, array_to_string({distinct_terms("list(term order by n desc, length(term) desc, term)", 8)}, '; ') as keywords from {GRAMS} group by 1""",
    "cq13_unit_payload": f"""
        select unit_id, upload_id, source_no as number, source_type as type, {sql.clean('text')} as text, metadata.extraction_method as extraction_method, metadata.confidence_score as confidence_score,
            coalesce(metadata.text_length, length({sql.clean('text')})) as text_length, coalesce(array_to_string(metadata.warnings, '; '), '') as warnings, description_of_image_video as description from {_PAYLOAD}""",
    "cq12_visual_descriptions": f"select upload_id, file_type, {_shown('file_type', 'd')} as shown from {_NEWEST} left join {_DESCRIBED} using (upload_id)",
    "cq1_analyses": f"""
        with u as (select upload_id, unit_id, {sql.clean('text')} as t, coalesce(metadata.extraction_method, 'unknown') as method, metadata.warnings as warnings from {_PAYLOAD} where upload_id is not null),
        n as (select upload_id, count(*) as total_source_units, sum(length(t)) as chars from u group by 1),
        h as (select upload_id, {_SENTENCE} as s from u where t <> '' qualify row_number() over (partition by upload_id order by unit_id) = 1),
        m as (select upload_id, string_agg(method || ':' || k, ', ' order by method || ':' || k) as methods from (select upload_id, method, count(*) as k from u group by all) group by 1),
        w0 as (select upload_id, unit_id, unnest(warnings) as warning, generate_subscripts(warnings, 1) as pos from u),
        w as (select upload_id, string_agg(warning, '; ' order by first, warning) as warnings from (select upload_id, warning, min((unit_id, pos)) as first from w0 group by all) group by 1),
        p as (select upload_id, {distinct_terms("list(term order by r)", 10)} as keywords from (select upload_id, term, row_number() over (partition by upload_id order by n desc, length(term) desc, term) as r
            from {_PHRASE_TERMS} qualify r <= 40) group by 1),
        k as (select upload_id, place, brand_product || ': ' || regexp_replace({sql.clean('key_message')}, '[ .;]+$', '') as p, key_message_id, confidence_score from ({mapping.SQL['cq2_exact_mapping']})),
        b as (select upload_id, count(*) as matches, string_agg(p, ' | ' order by place) filter (place <= 3) as mapped, min(key_message_id) filter (place = 1) as best_message,
            min(confidence_score) filter (place = 1) as best_score from k group by 1)
        select upload_id, file_name, file_type, detected_language, target_language, translated, coalesce(total_source_units, 0) as total_source_units, coalesce(chars, 0) as chars, methods,
            coalesce(w.warnings, '') as warnings, {_shown('file_type', 'd')} as description,
            case when file_type in ('audio', 'video') then null else coalesce({_cut('mapped', 320)}, {_cut('h.s', 320)}, '{NO_SUMMARY}') end as summary,
            coalesce(array_to_string(keywords, '; '), '') as keywords, case when coalesce(chars, 0) > 0 then 'Text Extracted' else 'No readable text extracted' end as extraction_status,
            case when coalesce(chars, 0) = 0 then 'Mapping skipped - no readable text' when matches > 0 then 'Mapping Completed' else 'Mapping Completed - no matches' end as mapping_status,
            coalesce(matches, 0) as matches, best_message, best_score
        from {_NEWEST} a left join n using (upload_id) left join h using (upload_id) left join m using (upload_id) left join w using (upload_id) left join p using (upload_id) left join b using (upload_id)
            left join {_DESCRIBED} d using (upload_id)""",
    "cq4_review_items": _ITEMS + "select * from it",
    "cq4_review_report": _ITEMS + """select upload_id, count(*) as items, count(*) filter (status = 'Satisfied') as satisfied, count(*) filter (status = 'Not Satisfied') as not_satisfied,
        case when count(*) filter (status = 'Not Satisfied') > 0 then 'Non-Compliant' else 'Compliant' end as overall, round(avg(similarity_score), 4) as mean_score from it group by 1""",
    "cq6_fallback_judgments": f"""
        with {_EVIDENCE}, t as (select match_id, similarity_score, criterion, n, {_cut(sql.clean('text'), 320)} as evidence from b where r = 1),
        h as (select *, len(list_intersect(criterion, {sql.evidence('evidence')})) as k from t)
        select match_id, case when similarity_score >= 0.55 and n > 0 and (k >= least(2, n) or k / n >= 0.45) then 'Satisfied' else 'Not Satisfied' end as status,
            case when evidence = '' then '{NO_MAPPED}' else evidence end as evidence from h""",
    "cq7_empty_reports": f"""
        select upload_id, item_code, lower({sql.clean('section_name')}) as section, 'Not Satisfied' as status, '{NO_EVIDENCE}' as reasoning
        from (select distinct upload_id from analysis_results where upload_id is not null and upload_id not in (select upload_id from source_chunks where {sql.clean('text')} <> '' and upload_id is not null)),
        (select * from checklist_items where item_code is not null and checklist_version = (select arg_max(checklist_version, updated_date) from checklist_items where item_code is not null))""",
    "ag6_checklist_sections": f"""select checklist_version, lower({sql.clean('section_name')}) as section, count(*) as items, array_to_string(list_sort(list(distinct item_code)), ',') as codes
        from checklist_items group by 1, 2""",
    "sf5_page_quality": rf"""
        with u as (select unit_id, {sql.clean('text')} as t, case when metadata.extraction_method = 'ocr' then 'ocr' when metadata.extraction_method in ('pymupdf', 'pdfplumber', 'pypdf') then 'native' else 'hybrid' end as method,
            case when metadata.confidence_score >= 0 then metadata.confidence_score end * 100 as c, coalesce(len(metadata.warnings), 0) as k from {sql.UNITS} where source_type = 'page'),
        v as (select *, length(t) as n, len(regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9%+./-]*')) as w0, {sql.noise('t')} as noise, regexp_extract_all(t, '[A-Za-z][A-Za-z0-9\-]*') as w from u),
        g as (select *, case when len(w) = 0 then 1.0 else round(len({_GARBLED}) / len(w), 4) end as garbled from v),
        s as (select unit_id, method, t, case method
            when 'native' then 90.0 + case when n >= 2000 then 4.0 when n >= 800 then 3.0 when n >= 250 then 1.5 else 0.0 end + case when w0 >= 250 then 2.0 when w0 >= 80 then 1.0 else 0.0 end
                + case when noise <= 0.015 then 1.5 else 0.0 end + case when garbled <= 0.01 then 1.0 else 0.0 end - least(8.0, k * 2.0::double) - least(8.0, noise * 100.0::double) - least(6.0, garbled * 80.0::double)
            when 'ocr' then greatest(65.0::double, coalesce(least(94.0, c), 0.0)) + case when n >= 1000 then 5.0 when n >= 250 then 2.0 else 0.0 end - case when noise > 0.06 then 8.0 else 0.0 end
                - case when garbled > 0.08 then 8.0 else 0.0 end - least(12.0, k * 3.0::double)
            else case when c is not null then (84.0 + case when n >= 800 then 4.0 else 0.0 end) * 0.65::double + c * 0.35::double else 84.0::double + case when n >= 800 then 4.0 else 0.0 end end
                - least(8.0, noise * 100.0::double) - least(6.0, garbled * 80.0::double) - least(10.0, k * 2.5::double) end::double as s from g)
        select unit_id, method, case when t = '' then 0.0 else floor(greatest(0.0, least(99.0, s)) * 100.0 + 0.5) / 100.0 end as quality from s""",
    "sf12_unit_accuracy": _ACC + "select unit_id, source_type, measured, accuracy, method from z",
    "ag12_upload_accuracy": _ACC + """select upload_id, count(*) as pages, floor(sum(cast(round(accuracy * 100) as bigint)) / count(*) + 0.5) / 100 as accuracy, arg_max(measured, unit_id) as measured,
        coalesce(string_agg('Page ' || unit_id || ' has low extraction quality', '; ' order by unit_id) filter (accuracy < 70), '') as warnings from z where source_type = 'page' group by 1""",
    "sf11_estimates": f"""
        with u as (select unit_id, source_type as k, length({sql.clean('text')}) as n, {sql.clean('description_of_image_video')} <> '' as d, coalesce(len(metadata.warnings), 0) as w from {_PAYLOAD})
        select unit_id, greatest(0.0, least(100.0, case when n >= 500 then 85.0 when n >= 120 then 80.0 when n >= 30 then 75.0 when n > 0 then 70.0 when k in ('image', 'video') and d then 55.0 else 0.0 end
            + case when d and k in ('page', 'pdf', 'ppt', 'slide', 'image', 'video') then 10.0 else 0.0 end - least(30.0, w * 10.0)))::double as estimate from u""",
    "sf10_case_modules": rf"""
        with f as (select analysis_id, lower(regexp_extract(coalesce(file_name, ''), '(\.[^./\\]+)$', 1)) as x, coalesce(transcript_available, false) as t from {sql.ANALYSES}),
        m as (select analysis_id, case when t and x in ('.avi', '.mkv', '.mov', '.mp4') then 'video_audio_transcript' {_case(MODULES, 'x')} else 'text' end as module from f)
        select analysis_id, module, case when module in ('audio_transcript', 'video_audio_transcript') then 'wer_accuracy'
            when contains(module, 'ocr') or module in ('word_extraction', 'ppt_extraction', 'excel_extraction', 'pdf_text') then 'word_accuracy' else 'text_similarity' end as metric from m""",
    "cq8_failures": f"""
        with r as (select ocr_id, unit_id, text, engine, first_value(text) over (partition by unit_id order by ocr_id) as expected, row_number() over (partition by unit_id order by ocr_id) as r from {sql.READS})
        select ocr_id as case_id, case engine when 'tesseract' then 'scanned_pdf_ocr' when 'easyocr' then 'image_ocr' else 'text' end as module,
            'Case for module ''' || case engine when 'tesseract' then 'scanned_pdf_ocr' when 'easyocr' then 'image_ocr' else 'text' end || ''' needs expected text.' as error from r where r > 1 and expected is null""",
}
