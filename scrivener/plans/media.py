"""Transcripts, frames, captions, lines and the small shapes of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions import evidence, frames, media, quality, text
from scrivener.operators.dedup import distinct_parts
from scrivener.operators.mapping import possible_mentions
from scrivener.operators.tables import page_of
from scrivener.plans import mapping, sql
from scrivener.plans.reviews import judged_results
from scrivener.session import once, table
from scrivener.sources.files import KINDS, TEXT_EXTENSIONS, registry

#: Words and seconds of a stretch of speech.
STRETCH, SECONDS = 12, 4.8
TERMS = ("double-blind study", "placebo", "headache", "migraine")


def _units(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return once(table(spark, sf_dir, "source_chunks").select("unit_id", *cols), "unit_id")


def _reads(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return once(table(spark, sf_dir, "ocr_results").select("ocr_id", *cols), "ocr_id")


def _speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of media in stretches of twelve words, with times by their place and probabilities by the confidence."""
    rows = _units(spark, sf_dir, "upload_id", "source_type", "text", "metadata").where("source_type in ('audio', 'video')")
    rows = rows.select("unit_id", "upload_id", "source_type", "text", text.words(F.coalesce("text", F.lit(""))).alias("w"), F.greatest(F.coalesce("metadata.confidence_score", F.lit(0.0)), F.lit(0.0)).alias("c"))
    rows = rows.withColumn("parts", text.windows(F.col("w"), STRETCH, 0))

    def stretch(x: Column, i: Column) -> Column:
        return F.struct(
            (i * SECONDS - 1).alias("start"), (i * SECONDS + SECONDS).alias("end"), x.alias("text"), (F.col("c") - 1.0).alias("avg_logprob"),
            (1.0 - F.col("c")).alias("no_speech_prob"), (F.length(x) / F.size(F.array_distinct(F.split(x, " "))) / 4.0).alias("compression_ratio"),
        )

    return rows.select("unit_id", "upload_id", "source_type", "text", F.transform("parts", stretch).alias("segments"))


def transcript_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of speech with valid times and a confidence."""
    rows = _speech(spark, sf_dir).select("unit_id", F.posexplode(media.segments(F.col("segments"))).alias("no", "s"))
    return rows.select("unit_id", "no", F.round("s.start", 2).alias("start"), F.round("s.end", 2).alias("end"), "s.text", quality.half_up(F.col("s.confidence"), 2).alias("confidence"))


def usable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is usable of every transcript."""
    return _speech(spark, sf_dir).select("unit_id", media.usable_text(F.col("segments"), F.col("text")).alias("usable"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and mean confidence of every transcript."""
    return _speech(spark, sf_dir).select(
        "unit_id", F.round(media.duration(F.col("segments")), 2).alias("seconds"), F.round(media.speech_confidence(F.col("segments")), 4).alias("confidence")
    )


def video_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half speech and half pictures of every upload with video; speech alone where it has no machine reads."""
    sound = _speech(spark, sf_dir).where("source_type = 'video'").groupBy("upload_id").agg(F.avg(media.speech_confidence(F.col("segments"))).alias("a"))
    pictures = _reads(spark, sf_dir, "upload_id", "confidence_score").where("confidence_score >= 0").groupBy("upload_id").agg(F.avg("confidence_score").alias("f"))
    return sound.join(pictures, "upload_id", "left").select("upload_id", F.round(media.video_score(F.col("a"), F.col("f")), 4).alias("score"))


def chosen_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every upload whose vector changes the scene, four at most, none like one of the last five."""
    rows = once(table(spark, sf_dir, "content_chunks").select("vec_id", "upload_id", "embedding"), "vec_id").where("size(embedding) = 64 and upload_id is not null")
    signal = F.transform("embedding", lambda x: F.nanvl(x.cast("double"), F.lit(0.0)) * 100)
    return media.chosen_frames(rows.select("upload_id", "vec_id", signal.alias("signal")), "upload_id", "vec_id", "signal", scene=5.0, same=3.0)


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine reads cut at their page markers."""
    return media.page_texts(_reads(spark, sf_dir, "text"), "ocr_id", "text")


def caps_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line in capitals of every unit."""
    return _units(spark, sf_dir, "text").select("unit_id", text.first_caps_line(text.clean_text(F.col("text"))).alias("line")).where("line <> ''")


def possible_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and the brands that hold or are held by their first line in capitals."""
    brands = table(spark, sf_dir, "key_message_matches").select("brand_product").where("brand_product is not null").distinct()
    units = _units(spark, sf_dir, "text").select(F.col("unit_id").alias("doc"), F.col("unit_id").alias("unit"), text.clean_text(F.col("text")).alias("text"))
    return possible_mentions(units, brands).select(F.col("doc").alias("unit_id"), "brand_product")


def brand_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands of every upload's matches as a phrase."""
    rows = table(spark, sf_dir, "key_message_matches").where("brand_product is not null").groupBy("upload_id").agg(F.array_sort(F.collect_set("brand_product")).alias("b"))
    return rows.select("upload_id", text.listed(F.col("b")).alias("brands"))


def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first unit of an upload says of the best message matched with it."""
    best = once(table(spark, sf_dir, "key_message_matches").select("match_id", "upload_id", "brand_product", "key_message"), "match_id")
    units = _units(spark, sf_dir, "upload_id", "text").where(text.clean_text(F.col("text")) != "").groupBy("upload_id").agg(F.min_by("text", "unit_id").alias("text"))
    return evidence.evidence_lines(best.join(units, "upload_id"), "match_id", "text", "brand_product", "key_message")


def content_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and descriptions of every unit."""
    rows = _units(spark, sf_dir, "text").select("unit_id", F.posexplode(evidence.points(F.col("text"))).alias("no", "p"))
    return rows.select("unit_id", "no", "p.title", "p.description")


def units_with_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that hold any of some terms."""
    return _units(spark, sf_dir, "text").where(text.has_any(F.col("text"), list(TERMS))).select("unit_id")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reads(spark, sf_dir, "text").where("text is not null")
    return rows.select("ocr_id", F.posexplode(F.split("text", "\n")).alias("line_at", "line"))


def frame_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of every machine read would be noise in a frame."""
    return _lines(spark, sf_dir).groupBy("ocr_id").agg(F.count_if(frames.is_frame_noise(F.col("line"))).alias("noise"))


def product_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of machine reads that look like the name of a product."""
    return _lines(spark, sf_dir).where(frames.is_product_line(F.col("line"))).select("ocr_id", "line_at", "line")


def mapped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine reads as text for the mapping of frames."""
    return _reads(spark, sf_dir, "text").select("ocr_id", frames.mapping_lines(F.col("text")).alias("text"))


def weak_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which descriptions and texts of units say nothing or repeat themselves."""
    rows = _units(spark, sf_dir, "text", "description_of_image_video").where("description_of_image_video is not null")
    return rows.select("unit_id", frames.is_weak_caption(F.col("description_of_image_video")).alias("weak"), frames.is_repetitive(F.col("text")).alias("repetitive"))


def comments(spark: SparkSession, sf_dir: str, asset: str = "UPL-00-000001", version: str = "v3") -> DataFrame:
    """Review results of an asset or its copy, of one version, in order of time."""
    rows = once(table(spark, sf_dir, "matched_chunks").select("match_id", "upload_id", "checklist_version", "created_date"), "match_id")
    return rows.where((F.col("upload_id") == asset) & (F.col("checklist_version") == version)).orderBy("created_date", "match_id").select("match_id", F.unix_micros("created_date").alias("created"))


def plain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without vectors and texts."""
    return once(table(spark, sf_dir, "content_chunks").select("vec_id", "upload_id", "chunk_id", "location"), "vec_id")


def frame_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of videos with their description, else the signal of the frame with the same label."""
    rows = _units(spark, sf_dir, "upload_id", "source_type", "source_no", "text", "description_of_image_video").where("source_type = 'video' and source_no is not null")
    label = F.concat(F.lit("Frame "), F.col("source_no").cast("string"))
    rows = rows.select("unit_id", "upload_id", label.alias("label"), "text", "description_of_image_video")
    described = rows.where("description_of_image_video <> ''").select("unit_id", "upload_id", "label", F.col("description_of_image_video").alias("shown"), F.lit("description").alias("kind"))
    signal = text.trim_to_word(text.first_sentence(text.clean_text(F.col("text"))), 60)
    signals = rows.select("unit_id", "upload_id", "label", signal.alias("shown"), F.lit("signal").alias("kind")).join(described.select("upload_id", "label"), ["upload_id", "label"], "left_anti")
    return described.unionByName(signals.select(described.columns)).select("unit_id", "label", "shown", "kind")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every upload's newest analysis with its reference text, if it has one: that of its first machine read."""
    reads = _reads(spark, sf_dir, "upload_id", "text").where("text is not null").groupBy("upload_id").agg(F.min_by("text", "ocr_id").alias("reference"))
    return mapping.newest_analyses(spark, sf_dir, "file_type").join(reads, "upload_id", "left").select("upload_id", "file_type", F.length("reference").alias("reference_length"))


def word_lines(df: DataFrame, keys: list[str], word: str, confidence: str, order: str, least: float = 35.0) -> DataFrame:
    """``keys`` and ``line``: the words of each block, paragraph and line that are sure enough, in order."""
    rows = df.select(*keys, order, F.trim(word).alias("__w"), confidence).where((F.col("__w") != "") & (F.col(confidence) >= least))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "__w"))), lambda x: x["__w"]), " ").alias("line"))


def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of machine reads from their words: those of reads of 35 percent or more."""
    rows = _reads(spark, sf_dir, "text", "confidence_score").where("text is not null")
    lines = rows.select("ocr_id", (F.col("confidence_score") * 100).alias("sure"), F.posexplode(F.split("text", "\n")).alias("line_no", "l"))
    each = lines.select("ocr_id", F.floor(F.col("line_no") / 10).alias("block"), "line_no", "sure", F.posexplode(text.words(F.col("l"))).alias("word_no", "w"))
    return word_lines(each, ["ocr_id", "block", "line_no"], "w", "sure", "word_no")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity lines of machine reads, each once, timed ones first in order."""
    return _reads(spark, sf_dir, "text").select("ocr_id", frames.activity_lines(F.col("text")).alias("lines"))


def readable_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine reads without noise lines and repetitions."""
    rows = _reads(spark, sf_dir, "text").select("ocr_id", frames.readable_lines(F.col("text")).alias("parts"))
    return distinct_parts(rows, "parts", text.line_key).select("ocr_id", F.array_join("parts", "\n").alias("text"))


def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of machine reads that can be words."""
    found = F.regexp_extract_all(text.clean_text(F.col("text")), F.lit("[A-Za-z0-9%+.-]+"), F.lit(0))
    rows = _reads(spark, sf_dir, "text").select("ocr_id", F.filter(F.transform(found, frames.clean_token), lambda w: w != "").alias("w"))
    return rows.select("ocr_id", F.array_join("w", " ").alias("text"))


def material_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What text-heavy machine reads show."""
    return _reads(spark, sf_dir, "text").select("ocr_id", frames.material_description(F.col("text")).alias("description")).where("description <> ''")


def plain_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight different words of more than four letters of every chunk."""
    rows = once(table(spark, sf_dir, "content_chunks").select("vec_id", "text"), "vec_id")
    found = F.transform(text.words(F.coalesce("text", F.lit(""))), lambda w: F.lower(F.regexp_replace(w, r"^[.,:;()\[\]{}!?\"']+|[.,:;()\[\]{}!?\"']+\z", "")))
    return rows.select("vec_id", F.array_join(F.slice(F.array_distinct(F.filter(found, lambda w: F.length(w) > 4)), 1, 8), "; ").alias("keywords"))


def stored_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review results as JSON."""
    rows = once(table(spark, sf_dir, "matched_chunks").select("match_id", "upload_id", "item_code", "status"), "match_id")
    return rows.select("match_id", F.to_json(F.struct("match_id", "upload_id", "item_code", "status"), {"ignoreNullFields": "false"}).alias("json"))


def shown_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of analyses as they are shown, in ISO form and for file names, and read back."""
    rows = once(table(spark, sf_dir, "analysis_results").select("analysis_id", "created_at"), "analysis_id").where("created_at is not null")
    shown = F.date_format("created_at", "dd/MM/yyyy, HH:mm:ss")
    return rows.select(
        "analysis_id", shown.alias("shown"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("created_at", "yyyyMMdd_HHmmss").alias("file"),
        F.unix_timestamp(F.to_timestamp(shown, "dd/MM/yyyy, HH:mm:ss")).alias("seconds"),
    )


def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of media texts as a rounded and as a cut clock, and the first one read back."""
    rows = _units(spark, sf_dir, "source_type", "text").where("source_type in ('audio', 'video')")
    seconds = F.size(text.words(F.coalesce("text", F.lit("")))) * 0.4
    return rows.select("unit_id", text.clock(seconds).alias("rounded"), text.short_clock(seconds).alias("cut"), text.clock_parts(text.clock(seconds)).alias("seconds"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of every document: its publication and the beginning of its hash."""
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.concat("publication_no", F.lit(":"), F.substring(F.sha2("text", 256), 1, 16)).alias("version"))


def first_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur in several documents, with the one that came in first."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "ingested_at", F.sha2("text", 256).alias("h"))
    same = rows.groupBy("h").agg(F.min(F.struct(F.coalesce("ingested_at", F.lit("9999-12-31").cast("timestamp")).alias("t"), "doc_id"))["doc_id"].alias("first_doc"), F.count("*").alias("documents")).where("documents > 1")
    return same.select("first_doc", "documents")


def second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 21 to 40 of the newest analyses."""
    rows = once(table(spark, sf_dir, "analysis_results").select("analysis_id", "file_name", "created_at"), "analysis_id").where("created_at is not null")
    return page_of(rows, [F.desc("created_at"), F.asc("analysis_id")], 20, 20).select("analysis_id", "file_name")


def summary_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 120 words, 25 shared, of documents: the chunks of a text without units."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text.words(F.coalesce("text", F.lit(""))).alias("w"))
    parts = rows.select("doc_id", F.posexplode(text.windows(F.col("w"), 120, 25)).alias("at", "chunk"))
    return parts.select("doc_id", F.concat(F.lit("chunk-"), (F.col("at") + 1).cast("string")).alias("chunk_id"), F.length("chunk").alias("length"))


def unique_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored key phrases of analyses, each once whatever its case and signs."""
    rows = once(table(spark, sf_dir, "analysis_results").select("analysis_id", "extracted_keywords"), "analysis_id")
    return distinct_parts(rows, "extracted_keywords", text.line_key).select("analysis_id", F.array_join("extracted_keywords", "; ").alias("keywords"))


def term_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a criterion's words that its chunk holds."""
    rows = judged_results(spark, sf_dir)
    return rows.select("match_id", F.when(F.size("criterion") > 0, F.round(F.col("hits") / F.size("criterion"), 4)).otherwise(0.0).alias("ratio"))


def merged_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all reads of a unit, first occurrences in order."""
    rows = _reads(spark, sf_dir, "unit_id", "text").where("text is not null")
    lines = F.transform(F.split("text", "\r\n|\r|\n"), text.clean_text)
    listed = rows.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("ocr_id", lines.alias("l")))).alias("x"))
    parts = listed.select("unit_id", F.flatten(F.transform("x", lambda y: y["l"])).alias("parts"))
    return distinct_parts(parts, "parts", text.line_key).select("unit_id", F.array_join("parts", "\n").alias("text"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the file of every analysis is read, whether that is known, and whether it is text."""
    rows = once(table(spark, sf_dir, "analysis_results").select("analysis_id", "file_name"), "analysis_id")
    named = rows.select("analysis_id", text.extension(F.coalesce("file_name", F.lit(""))).alias("extension")).join(F.broadcast(registry(spark)), "extension", "left")  # settings
    return named.select("analysis_id", F.coalesce("kind", F.lit("fallback")).alias("kind"), F.col("kind").isNotNull().alias("known"), F.col("extension").isin(*sorted(TEXT_EXTENSIONS)).alias("is_text"))


def first_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of text, description and type of every unit that is not blank."""
    rows = _units(spark, sf_dir, "text", "description_of_image_video", "source_type")
    given = [F.when(text.clean_text(F.col(c)) != "", text.clean_text(F.col(c))) for c in ("text", "description_of_image_video", "source_type")]
    return rows.select("unit_id", F.coalesce(*given).alias("first"))


QUERIES = {
    "st15_segments": transcript_segments, "fp11_usable_texts": usable_texts, "ag8_durations": durations, "ag13_video_scores": video_scores, "w2_chosen_frames": chosen_frames,
    "st12_page_texts": page_texts, "st16_caps_lines": caps_lines, "j5_possible_brands": possible_brands, "st18_brand_lists": brand_lists, "kw5_evidence_lines": evidence_lines,
    "sm3_content_points": content_points, "fp3_units_with_terms": units_with_terms, "fp8_frame_noise": frame_noise, "fp18_product_lines": product_lines, "st20_mapped_frames": mapped_frames,
    "fp16_weak_captions": weak_captions, "fp14_comments": comments, "fp17_plain_chunks": plain_chunks, "j10_frame_descriptions": frame_descriptions, "j12_references": references,
    "ag17_recognised_lines": recognised_lines, "tk10_activities": activities, "st7_readable_fragments": readable_fragments, "st19_clean_tokens": clean_tokens,
    "cq11_material_descriptions": material_descriptions, "kw3_plain_keywords": plain_keywords, "js3_stored_json": stored_json, "dt1_shown_times": shown_times, "dt2_clocks": clocks,
    "hs1_versions": versions, "j11_first_publications": first_publications, "tk9_second_page": second_page, "st3_summary_windows": summary_windows, "st6_unique_keywords": unique_keywords,
    "so1_term_overlaps": term_overlaps, "so4_merged_reads": merged_reads, "sc1_routes": routes, "ar2_first_texts": first_texts,
}

_SPEECH = f"""
    with m as (select unit_id, upload_id, source_type, text, {sql.words("coalesce(text, '')")} as w, greatest(coalesce(metadata.confidence_score, 0.0), 0.0)::double as c from {sql.UNITS} where source_type in ('audio', 'video')),
    s as (select unit_id, upload_id, source_type, text, c, cast(a / 12 as int) as no, array_to_string(w[a + 1:a + 12], ' ') as x from (select *, unnest(range(0, len(w), 12)) as a from m)),
    g as (select *, (length(x) / len(list_distinct(string_split(x, ' '))) / 4.0)::double as z, {sql.clean('x')} as t from s)
"""
_LINES = f"(select ocr_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_at from {sql.READS} where text is not null)"
_BODY = r"trim(regexp_replace(X, '(?i)^(?:\d{2}:\d{2}\s+)?frame\s+\d+:\s*', ''))"
_HEX = r"(length(regexp_replace(lower(X), '\s+', '', 'g')) >= 24 and len(regexp_extract_all(regexp_replace(lower(X), '\s+', '', 'g'), '[0-9a-f]')) / length(regexp_replace(lower(X), '\s+', '', 'g')) > 0.85)"
_PRODUCT = rf"""len(w) between 1 and 7 and not list_contains({sql.values(list(frames.NOT_PRODUCTS))}, j) and (regexp_matches(j, '\b({'|'.join(f for f in frames.FORMS if f != '%')})\b')
    or (len(w) <= 3 and len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) > 0))"""
_NOISE_LINE = r"""(length(v) <= 1 or len(regexp_extract_all(v, '[A-Za-z]')) = 0 or len(regexp_extract_all(v, '[A-Za-z]')) / length(v) < 0.35 or len(regexp_extract_all(v, '[A-Za-z0-9%+.-]+')) = 0
    or len(list_filter(regexp_extract_all(v, '[A-Za-z0-9%+.-]+'), lambda x: length(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')) <= 1)) >= greatest(2, len(regexp_extract_all(v, '[A-Za-z0-9%+.-]+')) // 2 + 1))"""
_EDGES = r"regexp_replace(X, '^[ .,:;|\[\]{}()]+|[ .,:;|\[\]{}()]+$', '', 'g')"
_CAPS = rf"""trim(regexp_replace(lower(list_filter(list_transform(string_split({sql.clean('text')}, chr(10)), lambda s: trim(s)),
    lambda s: length(s) between 3 and 60 and regexp_full_match(s, '[A-Z][A-Z0-9\s\-/()]+'))[1]), '\(.*?\)', '', 'g'))"""


def _distinct_lines(key: str, rows: str) -> str:
    return f"""select {key}, coalesce(string_agg(part, chr(10) order by pos) filter (k <> '' and first), '') as text from (
        select *, row_number() over (partition by {key}, k order by pos) = 1 as first from (select *, {sql.key('part')} as k from {rows})) group by 1"""


SQL = {
    "st15_segments": _SPEECH + """select unit_id, no, round(greatest(0.0, no * 4.8::double - 1), 2) as start, round(greatest(greatest(0.0, no * 4.8::double - 1), no * 4.8::double + 4.8), 2) as "end", t as text,
        floor(round(greatest(0.0, least(1.0, c - 1 + 1)), 3) * 100.0 + 0.5) / 100.0 as confidence from g""",
    "fp11_usable_texts": _SPEECH + f""", ok as (select *, not {sql.garbage('t')} and not (1.0 - c >= 0.65 and c - 1.0 <= -0.8) and c - 1.0 > -1.2 and z < 2.8 as ok from g)
        select unit_id, case when bool_or(ok) then string_agg(t, ' ' order by no) filter (ok) else '' end as usable from ok group by 1
        union all select unit_id, {sql.clean('text')} from m where len(w) = 0""",
    "ag8_durations": _SPEECH + """select m.unit_id, coalesce(round(max(no * 4.8::double + 4.8), 2), 0.0) as seconds,
        coalesce(round(avg(greatest(0.0, least(1.0, m.c * least(1.0, exp(m.c - 1 + 1))))), 4), 0.0) as confidence from m left join g using (unit_id) group by 1""",
    "ag13_video_scores": _SPEECH + f""", a as (select upload_id, avg(a) as a from (select m.unit_id, m.upload_id, coalesce(avg(greatest(0.0, least(1.0, m.c * least(1.0, exp(m.c - 1 + 1))))) filter (g.unit_id is not null), 0.0) as a
            from m left join g using (unit_id) where m.source_type = 'video' group by all) group by 1),
        f as (select upload_id, avg(confidence_score) as f from {sql.READS} where confidence_score >= 0 group by 1)
        select upload_id, round(coalesce(a * 0.5 + f * 0.5, a, f), 4) as score from a left join f using (upload_id)""",
    "st12_page_texts": rf"""
        with l as (select ocr_id, unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]')) as line,
            generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]'), 1) as pos from {sql.READS}),
        m as (select *, regexp_extract(line, '(?i)^\s*page\s*(?:no\.?\s*)?:?\s*(\d{{1,6}})(?:\s*[-–:]\s*(.*?))?\s*$', ['no', 'title']) as m from l),
        g as (select *, sum(case when m.no <> '' then 1 else 0 end) over (partition by ocr_id order by pos) as part from m),
        p as (select ocr_id, part, coalesce(max(case when m.no <> '' then try_cast(m.no as int) end), 0) as page_no, max(case when m.no <> '' then nullif(m.title, '') end) as title,
            coalesce({sql.strip("string_agg(line, chr(10) order by pos) filter (m.no = '')")}, '') as text from g group by all)
        select ocr_id, page_no, title, text from p where page_no <> 0 or text <> ''""",
    "st16_caps_lines": f"select unit_id, line from (select unit_id, {_CAPS} as line from {sql.UNITS}) where line <> ''",
    "j5_possible_brands": f"""select distinct unit_id, brand_product from (select unit_id, {_CAPS} as line from {sql.UNITS}) join (select distinct brand_product from key_message_matches where brand_product is not null)
        on line <> '' and lower(brand_product) <> '' and (contains(line, lower(brand_product)) or contains(lower(brand_product), line))""",
    "st18_brand_lists": """with b as (select upload_id, list_sort(list(distinct brand_product)) as b from key_message_matches where brand_product is not null group by 1)
        select upload_id, case len(b) when 1 then b[1] when 2 then b[1] || ' and ' || b[2] else array_to_string(b[1:len(b) - 1], ', ') || ', and ' || b[len(b)] end as brands from b""",
    "kw5_evidence_lines": rf"""
        with u as (select upload_id, text from {sql.UNITS} where {sql.clean('text')} <> '' qualify row_number() over (partition by upload_id order by unit_id) = 1),
        r as (select match_id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(brand_product, '') || ' ' || coalesce(key_message, '')), '[a-z0-9]+'), lambda w: length(w) > 3)) as terms,
            string_split({sql.clean('text')}, chr(10)) as l from {sql.MESSAGES} join u using (upload_id)),
        p as (select match_id, terms, unnest(l) as line, generate_subscripts(l, 1) as pos from r), k as (select *, {sql.key('line')} as k from p),
        f as (select *, list_distinct(regexp_extract_all(lower(line), '[a-z0-9]+')) as own from k where k <> '' qualify row_number() over (partition by match_id, k order by pos) = 1),
        s as (select match_id, pos, line, len(list_intersect(own, terms)) as shared, len(list_intersect(own, {sql.values(list(evidence.ACTIONS))})) > 0 as acts from f),
        t as (select *, row_number() over (partition by match_id order by shared + case when acts then 2 else 0 end desc, pos) as r from s where acts or shared >= 2 qualify r <= 4),
        d as (select match_id, string_agg(trim(line), '; ' order by r) as d from t group by 1)
        select match_id, case when length(d) <= 320 then d when instr(left(d, 320), ' ') > 0 then regexp_replace(left(d, 320), ' [^ ]*$', '') || '...' else left(d, 320) || '...' end as description from d""",
    "fp3_units_with_terms": f"select unit_id from {sql.UNITS} where " + " or ".join(
        f"contains(lower(coalesce(text, '')), '{t}')" if " " in t else rf"regexp_matches(lower(coalesce(text, '')), '\b{t}\b')" for t in TERMS
    ),
    "fp8_frame_noise": rf"""
        with l as (select ocr_id, {sql.clean('line')} as t from {_LINES}), c as (select ocr_id, t, regexp_replace(lower(t), '\s+', '', 'g') as c from l)
        select ocr_id, count(*) filter (t = '' or {_HEX.replace('X', 't')} or regexp_matches(c, '{'|'.join(x + '{9,}' for x in 'abcdef0123456789')}') or (length(t) > 40 and not regexp_matches(t, '[a-zA-Z]{{2,}}'))) as noise
        from c group by 1""",
    "fp18_product_lines": f"""
        with w as (select ocr_id, line_at, line, regexp_extract_all(line, '[A-Za-z][A-Za-z0-9%.-]*') as w from {_LINES}), j as (select *, lower(array_to_string(w, ' ')) as j from w)
        select ocr_id, line_at, line from j where {_PRODUCT}""",
    "st20_mapped_frames": f"""
        select ocr_id, array_to_string(list_filter(list_transform(string_split({sql.clean('text')}, chr(10)), lambda y: {_BODY.replace('X', 'y')}), lambda y: y <> '' and not {_HEX.replace('X', 'y')}), chr(10)) as text
        from {sql.READS}""",
    "fp16_weak_captions": f"""
        with u as (select unit_id, {sql.key(sql.clean('description_of_image_video'))} as n, lower({sql.clean('text')}) as low, regexp_extract_all(lower({sql.clean('text')}), '[a-z0-9]+') as t
            from (select distinct on (unit_id) unit_id, text, description_of_image_video from source_chunks) where description_of_image_video is not null)
        select unit_id, length(n) <= 2 or list_contains({sql.values(list(frames.WEAK_ANSWERS + frames.WEAK_WORDS + frames.WEAK_PHRASES))}, n)
            or {' or '.join(f"contains(n, '{p}')" for p in frames.WEAK_PARTS)} as weak,
            contains(low, 'no idea') or contains(low, 'do not know') or contains(low, 'don''t know') or len(t) < 4 or (len(t) >= 8 and len(list_distinct(t)) / len(t) < 0.45)
            or coalesce(list_max(list_transform(list_distinct(t), lambda d: len(list_filter(t, lambda x: x = d)))), 0) >= 4 as repetitive from u""",
    "fp14_comments": f"select match_id, epoch_us(created_date) as created from {sql.MATCHES} where upload_id = 'UPL-00-000001' and checklist_version = 'v3'",
    "fp17_plain_chunks": f"select vec_id, upload_id, chunk_id, location from {sql.CHUNKS}",
    "j10_frame_descriptions": rf"""
        with v as (select unit_id, upload_id, 'Frame ' || source_no as label, {sql.clean('text')} as t, description_of_image_video as d from (select distinct on (unit_id) * from source_chunks) where source_type = 'video' and source_no is not null),
        s as (select *, coalesce(list_filter(list_transform(regexp_split_to_array(regexp_replace(t, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: {sql.strip('s')}), lambda s: s <> '')[1], '') as s from v)
        select unit_id, label, d as shown, 'description' as kind from s where d <> '' union all
        select unit_id, label, case when length(s) <= 60 then s when instr(left(s, 60), ' ') > 0 then regexp_replace(left(s, 60), ' [^ ]*$', '') || '...' else left(s, 60) || '...' end, 'signal' from s
        where not exists (select 1 from s x where x.d <> '' and x.upload_id = s.upload_id and x.label = s.label)""",
    "j12_references": f"""select upload_id, file_type, length(reference) as reference_length from (select * from {sql.ANALYSES} where upload_id is not null
        qualify row_number() over (partition by upload_id order by created_at desc nulls last, analysis_id desc) = 1) left join (select upload_id, arg_min(text, ocr_id) as reference from {sql.READS} where text is not null group by 1) using (upload_id)""",
    "ag17_recognised_lines": f"""
        with l as (select r.ocr_id, confidence_score * 100 as sure, line_at as line_no, {sql.words('line')} as w from {_LINES} l join {sql.READS} r using (ocr_id))
        select ocr_id, cast(floor(line_no / 10) as bigint) as block, cast(line_no as int) as line_no, array_to_string(w, ' ') as line from l where sure >= 35 and len(w) > 0""",
    "tk10_activities": rf"""
        with p as (select ocr_id, unnest(string_split({sql.clean('text')}, chr(10))) as l, generate_subscripts(string_split({sql.clean('text')}, chr(10)), 1) as i from {sql.READS}),
        k as (select ocr_id, i, trim(l) as s, {sql.key(_BODY.replace('X', 'trim(l)'))} as k from p),
        f as (select *, coalesce(try_cast(regexp_extract(s, '^(\d{{2}}):(\d{{2}})', 1) as int) * 60 + try_cast(regexp_extract(s, '^(\d{{2}}):(\d{{2}})', 2) as int), 999999) as t,
            list_contains({sql.values(list(frames.WEAK_ACTIVITIES))}, k) as weak from k where k <> '' qualify row_number() over (partition by ocr_id, k order by i) = 1),
        g as (select *, bool_or(not weak) over (partition by ocr_id) as strong from f)
        select ocr_id, coalesce(string_agg(s, chr(10) order by t, i) filter (not (strong and weak)), '') as lines from {sql.READS} left join g using (ocr_id) group by 1""",
    "st7_readable_fragments": _distinct_lines("ocr_id", f"""(select ocr_id, v as part, pos from (select ocr_id, pos, {_EDGES.replace('X', sql.clean('line'))} as part0, {_EDGES.replace('X', _EDGES.replace('X', sql.clean('line')))} as v
        from (select ocr_id, unnest(string_split({sql.clean('text')}, chr(10))) as line, generate_subscripts(string_split({sql.clean('text')}, chr(10)), 1) as pos from {sql.READS})) where not {_NOISE_LINE}
        union all select ocr_id, '', -1 from {sql.READS})"""),
    "st19_clean_tokens": rf"""
        select ocr_id, array_to_string(list_filter(list_transform(regexp_extract_all({sql.clean('text')}, '[A-Za-z0-9%+.-]+'), lambda x: case
            when length({_EDGES.replace('X', 'x')}) <= 1 and not regexp_matches(x, '\d') then ''
            when len(regexp_extract_all(x, '[A-Za-z]')) = 0 then case when regexp_matches(x, '\d') then {_EDGES.replace('X', 'x')} else '' end
            when len(regexp_extract_all(x, '[A-Za-z]')) >= 4 and regexp_matches(x, '(?i)[bcdfghjklmnpqrstvwxyz]{{4,}}') then ''
            when len(regexp_extract_all(x, '[A-Za-z]')) >= 4 and len(regexp_extract_all(x, '[AEIOUaeiou]')) / len(regexp_extract_all(x, '[A-Za-z]')) < 0.30 and not regexp_matches(x, '[\d%+]') then ''
            when len(regexp_extract_all(x, '[A-Za-z]')) <= 3 and not regexp_matches(x, '[\d%+]') and upper({_EDGES.replace('X', 'x')}) <> {_EDGES.replace('X', 'x')} then ''
            when regexp_matches({_EDGES.replace('X', 'x')}, '[A-Za-z]{{2,}}-[A-Za-z]{{1,2}}$') and not regexp_matches(x, '\d') then '' else {_EDGES.replace('X', 'x')} end), lambda x: x <> ''), ' ') as text
        from {sql.READS}""",
    "cq11_material_descriptions": rf"""
        with l as (select ocr_id, v as line, pos from (select ocr_id, pos, {_EDGES.replace('X', sql.clean('line'))} as v from (select ocr_id, unnest(string_split({sql.clean('text')}, chr(10))) as line,
            generate_subscripts(string_split({sql.clean('text')}, chr(10)), 1) as pos from {sql.READS})) where not {_NOISE_LINE}),
        n as (select ocr_id, line, row_number() over (partition by ocr_id order by pos) as i, regexp_extract_all(line, '[A-Za-z][A-Za-z0-9%.-]*') as w from l),
        j as (select *, lower(array_to_string(w, ' ')) as j from n), t as (select ocr_id, arg_min(line, i) as title from j where i <= 14 and {_PRODUCT} group by 1),
        o as (select ocr_id, count(*) as n, lower(string_agg(line, ' ' order by i)) as low from n group by 1 having count(*) >= 6),
        p as (select ocr_id, list_filter([{', '.join(f"case when {' or '.join(f'''contains(low, '{w}')''' for w in words)} then '{name}' end" + (", case when n >= 10 then 'product claims' end" if k == 1 else "") for k, (name, words) in enumerate(frames.PARTS))}], lambda x: x is not null) as p from o)
        select ocr_id, 'Text-heavy promotional/clinical material' || case when title is not null then ' for ' || title else '' end || ', showing ' || case when len(p) = 0 then 'promotional content' else array_to_string(p[1:3], ', ') end || '.' as description
        from p left join t using (ocr_id)""",
    "kw3_plain_keywords": rf"""
        with w as (select vec_id, list_filter(list_transform({sql.words("coalesce(text, '')")}, lambda w: lower(regexp_replace(w, '^[.,:;()\[\]{{}}!?"'']+|[.,:;()\[\]{{}}!?"'']+$', '', 'g'))), lambda w: length(w) > 4) as w from {sql.CHUNKS})
        select vec_id, array_to_string(list_transform(list_filter(list_zip(range(1, len(w) + 1), w), lambda z: list_position(w, z[2]) = z[1]), lambda z: z[2])[1:8], '; ') as keywords from w""",
    "js3_stored_json": f"select match_id, to_json({{'match_id': match_id, 'upload_id': upload_id, 'item_code': item_code, 'status': status}})::varchar as json from {sql.MATCHES}",
    "dt1_shown_times": f"""select analysis_id, strftime(created_at, '%d/%m/%Y, %H:%M:%S') as shown, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as iso, strftime(created_at, '%Y%m%d_%H%M%S') as file,
        cast(floor(epoch(created_at)) as bigint) as seconds from {sql.ANALYSES} where created_at is not null""",
    "dt2_clocks": f"""
        with s as (select unit_id, len({sql.words("coalesce(text, '')")}) * 0.4::double as x from {sql.UNITS} where source_type in ('audio', 'video')), r as (select unit_id, cast(floor(x + 0.5) as int) as r, cast(floor(x) as int) as c from s)
        select unit_id, lpad(cast(r // 60 as varchar), 2, '0') || ':' || lpad(cast(r % 60 as varchar), 2, '0') as rounded, (c // 60) || ':' || lpad(cast(c % 60 as varchar), 2, '0') as cut, r as seconds from r""",
    "hs1_versions": "select doc_id, publication_no || ':' || left(sha256(text), 16) as version from documents where text is not null",
    "j11_first_publications": """select first_doc, documents from (select sha256(text) as h, arg_min(doc_id, (coalesce(ingested_at, timestamptz '9999-12-31'), doc_id)) as first_doc, count(*) as documents
        from documents where text is not null group by 1 having count(*) > 1)""",
    "tk9_second_page": f"select analysis_id, file_name from {sql.ANALYSES} where created_at is not null order by created_at desc, analysis_id limit 20 offset 20",
    "st3_summary_windows": f"""
        with w as (select doc_id, {sql.words("coalesce(text, '')")} as w from documents), s as (select doc_id, w, unnest(range(0, len(w), 95)) as a from w)
        select doc_id, 'chunk-' || cast(a / 95 as int) + 1 as chunk_id, length(array_to_string(w[a + 1:a + 120], ' ')) as length from s""",
    "st6_unique_keywords": f"""
        with p as (select analysis_id, unnest(extracted_keywords) as part, generate_subscripts(extracted_keywords, 1) as pos from {sql.ANALYSES}),
        f as (select * from (select *, {sql.key('part')} as k from p) where k <> '' qualify row_number() over (partition by analysis_id, k order by pos) = 1)
        select analysis_id, coalesce(string_agg(part, '; ' order by pos), '') as keywords from {sql.ANALYSES} left join f using (analysis_id) group by 1""",
    "so1_term_overlaps": f"""
        with i as (select distinct on (item_code, checklist_version) item_code, checklist_version, {sql.evidence('checklist_description')} as criterion from checklist_items where item_code is not null),
        c as (select vec_id, {sql.evidence('text')} as found from {sql.CHUNKS})
        select match_id, case when len(criterion) > 0 then round(len(list_intersect(criterion, found)) / len(criterion), 4) else 0.0 end as ratio from {sql.MATCHES} join i using (item_code, checklist_version) join c using (vec_id)""",
    "so4_merged_reads": _distinct_lines("unit_id", rf"""(select unit_id, part, row_number() over (partition by unit_id order by ocr_id, pos) as pos from (
        select unit_id, ocr_id, unnest(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda s: {sql.clean('s')})) as part, generate_subscripts(regexp_split_to_array(text, '\r\n|\r|\n'), 1) as pos
        from {sql.READS} where text is not null))"""),
    "sc1_routes": rf"""
        with f as (select analysis_id, lower(regexp_extract(coalesce(file_name, ''), '(\.[^./\\]+)$', 1)) as x from {sql.ANALYSES}),
        k as (select analysis_id, x, case {" ".join(f"when list_contains({sql.values(v.split())}, x) then '{k}'" for k, v in KINDS.items())} end as kind from f)
        select analysis_id, coalesce(kind, 'fallback') as kind, kind is not null as known, list_contains({sql.values(sorted(TEXT_EXTENSIONS))}, x) as is_text from k""",
    "ar2_first_texts": f"""select unit_id, coalesce(nullif({sql.clean('text')}, ''), nullif({sql.clean('description_of_image_video')}, ''), nullif({sql.clean('source_type')}, '')) as first
        from (select distinct on (unit_id) * from source_chunks)""",
}
