"""Cleaning, windows, repetition, quality and error rates of units and machine reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivener.functions import metrics, quality, text
from scrivener.operators.dedup import distinct_parts
from scrivener.plans import sql
from scrivener.session import once, table

_WINDOW = (160, 30)


def _units(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return once(table(spark, sf_dir, "source_chunks").select("unit_id", *cols), "unit_id")


def _reads(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return once(table(spark, sf_dir, "ocr_results").select("ocr_id", *cols), "ocr_id")


def clean_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned text of every unit."""
    return _units(spark, sf_dir, "text").select("unit_id", text.clean_text(F.col("text")).alias("cleaned"))


def unit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping word windows of every unit."""
    words = _units(spark, sf_dir, "text").select("unit_id", text.words(F.coalesce("text", F.lit(""))).alias("w"))
    rows = words.select("unit_id", F.posexplode(text.windows(F.col("w"), *_WINDOW)).alias("no", "part"))
    return rows.select("unit_id", (F.col("no") + 1).cast("int").alias("window_no"), F.col("part").alias("window"))


def unrepeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit without sentences that it said before."""
    rows = _units(spark, sf_dir, "text").select("unit_id", text.sentences(text.clean_text(F.col("text"))).alias("parts"))
    return distinct_parts(rows, "parts", text.line_key).select("unit_id", F.array_join("parts", "\n").alias("text"))


def unrepeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every machine read without lines that it had before."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n"), text.clean_text)
    rows = _reads(spark, sf_dir, "text").select("ocr_id", lines.alias("parts"))
    return distinct_parts(rows, "parts", text.line_key).select("ocr_id", F.array_join("parts", "\n").alias("text"))


def metric_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form of every unit in which error rates are measured."""
    return _units(spark, sf_dir, "text").select("unit_id", text.metric_text(F.col("text")).alias("normal"))


def read_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality, noise and weakness of every machine read."""
    t = F.col("text")
    return _reads(spark, sf_dir, "text").select(
        "ocr_id", quality.text_quality(t).alias("quality"), quality.noise_ratio(t).alias("noise"), quality.is_weak(t).alias("weak")
    )


def garbled_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of garbled words of every unit."""
    return _units(spark, sf_dir, "text").select("unit_id", quality.garbled_ratio(F.col("text")).alias("garbled"))


def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of every machine read are noise."""
    rows = _reads(spark, sf_dir, "text").where("text is not null").select("ocr_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.groupBy("ocr_id").agg(F.count("*").alias("lines"), F.count_if(quality.is_noise_line(F.col("line"))).alias("noise"))


def garbage_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which transcripts of audio and video hold no words."""
    rows = _units(spark, sf_dir, "source_type", "text").where("source_type in ('audio', 'video')")
    return rows.select("unit_id", quality.is_garbage_transcript(F.col("text")).alias("garbage"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reads of one unit: the one of smaller ocr_id is the reference."""
    w = Window.partitionBy("unit_id").orderBy("ocr_id")
    rows = _reads(spark, sf_dir, "unit_id", "text").withColumn("r", F.row_number().over(w)).where("r <= 2")
    a, b = rows.where("r = 1").select("unit_id", F.col("text").alias("a")), rows.where("r = 2").select("unit_id", F.col("text").alias("b"))
    return a.join(b, "unit_id")


def read_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate between two reads of a unit."""
    return _pairs(spark, sf_dir).select("unit_id", F.round(metrics.cer(F.col("a"), F.col("b")), 4).alias("cer"))


def read_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rates between two reads of a unit."""
    pairs = _pairs(spark, sf_dir)
    rates = metrics.word_rates(pairs, metrics.metric_words(F.col("a")), metrics.metric_words(F.col("b")), "wer")
    rates = metrics.word_rates(rates, metrics.evaluation_tokens(F.col("a")), metrics.evaluation_tokens(F.col("b")), "percent")
    return rates.select("unit_id", F.round(F.least(F.lit(1.0), F.col("wer")), 4).alias("wer"), F.round(F.col("percent") * 100, 2).alias("wer_percent"))


def read_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of common words between two reads of a unit."""
    return metrics.token_f1(_pairs(spark, sf_dir), F.col("a"), F.col("b"), "f1").select("unit_id", "f1")


def best_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read of every unit with the highest selection score; of equal ones the first."""
    rows = _reads(spark, sf_dir, "unit_id", "text", "confidence_score").where(text.clean_text(F.col("text")) != "")
    rows = rows.withColumn("score", F.round(quality.selection_score(F.col("text"), F.col("confidence_score")), 6))
    best = rows.groupBy("unit_id").agg(F.max(F.struct("score", (-F.col("ocr_id")).alias("id"))).alias("best"))
    return best.select("unit_id", (-F.col("best.id")).alias("ocr_id"), F.col("best.score").alias("score"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of every document, at most 320 characters."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text.first_sentence(text.clean_text(F.col("text"))).alias("s")).where("s <> ''")
    return rows.select("doc_id", text.trim_to_word(F.col("s"), 320).alias("summary"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur in several documents: their version key, the first document and how many there are."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    same = rows.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("documents")).where("documents > 1")
    return same.select(F.substring("h", 1, 16).alias("version"), "first_doc", "documents")


QUERIES = {
    "st1_clean_units": clean_units, "st2_unit_windows": unit_windows, "st4_unrepeated_units": unrepeated_units, "st5_unrepeated_lines": unrepeated_lines,
    "st8_metric_units": metric_units, "sf4_read_quality": read_quality, "sf6_garbled_units": garbled_units, "fp7_noise_lines": noise_lines,
    "fp9_garbage_transcripts": garbage_transcripts, "sf1_read_cer": read_cer, "sf2_read_wer": read_wer, "sf3_read_f1": read_f1,
    "tk6_best_read": best_read, "sm1_summaries": summaries, "hs1_content_hashes": content_hashes,
}

_U = sql.UNITS
_SENTENCES = rf"list_filter(list_transform(regexp_split_to_array(regexp_replace({sql.clean('text')}, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: {sql.strip('s')}), lambda s: s <> '')"
_PAIRS = f"""(select unit_id, max(text) filter (r = 1) as a, max(text) filter (r = 2) as b from (
    select unit_id, text, row_number() over (partition by unit_id order by ocr_id) as r from {sql.READS}) where r <= 2 group by 1 having count(*) = 2)"""
_GARBLED = r"""list_filter(w, lambda x: len(regexp_extract_all(x, '[A-Za-z]')) >= 5 and (
    len(regexp_extract_all(x, '[AEIOUaeiou]')) / len(regexp_extract_all(x, '[A-Za-z]')) < 0.16 or regexp_matches(x, '(?i)[bcdfghjklmnpqrstvwxyz]{6,}')))"""


def _unrepeated(key_name: str, rows: str, parts: str) -> str:
    return f"""
        with p as (select {key_name}, unnest({parts}) as part, generate_subscripts({parts}, 1) as pos from {rows}),
        k as (select *, {sql.key('part')} as key from p),
        f as (select * from k where key <> '' qualify row_number() over (partition by {key_name}, key order by pos) = 1)
        select {key_name}, coalesce(string_agg(part, chr(10) order by pos), '') as text from {rows} left join f using ({key_name}) group by 1
    """.replace(f"select {key_name}, coalesce", f"select r.{key_name}, coalesce").replace(f"from {rows} left join f using ({key_name})", f"from {rows} r left join f using ({key_name})")


SQL = {
    "st1_clean_units": f"select unit_id, {sql.clean('text')} as cleaned from {_U}",
    "st2_unit_windows": f"""
        with w as (select unit_id, {sql.words("coalesce(text, '')")} as w from {_U}), s as (select unit_id, w, unnest(range(0, len(w), 130)) as a from w)
        select unit_id, cast(a / 130 as int) + 1 as window_no, array_to_string(w[a + 1:a + 160], ' ') as "window" from s""",
    "st4_unrepeated_units": _unrepeated("unit_id", _U, _SENTENCES),
    "st5_unrepeated_lines": _unrepeated("ocr_id", sql.READS, rf"list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n'), lambda s: {sql.clean('s')})"),
    "st8_metric_units": f"select unit_id, {sql.metric('text')} as normal from {_U}",
    "sf4_read_quality": f"""select ocr_id, {sql.quality('t')} as quality, {sql.noise('t')} as noise, length(t) < 30 or {sql.quality('t')} < 35 as weak
        from (select ocr_id, {sql.clean('text')} as t from {sql.READS})""",
    "sf6_garbled_units": rf"""select unit_id, case when len(w) = 0 then 1.0 else round(len({_GARBLED}) / len(w), 4) end as garbled
        from (select unit_id, regexp_extract_all({sql.clean('text')}, '[A-Za-z][A-Za-z0-9\-]*') as w from {_U})""",
    "fp7_noise_lines": rf"""
        with l as (select ocr_id, unnest(string_split(text, chr(10))) as line from {sql.READS} where text is not null),
        v as (select ocr_id, regexp_replace({sql.clean('line')}, '^[ .,:;|\[\]{{}}()]+|[ .,:;|\[\]{{}}()]+$', '', 'g') as v from l),
        w as (select *, len(regexp_extract_all(v, '[A-Za-z]')) as letters, regexp_extract_all(v, '[A-Za-z0-9%+.-]+') as w from v),
        n as (select *, len(list_filter(w, lambda x: length(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')) <= 1)) as single from w)
        select ocr_id, count(*) as lines, count(*) filter (length(v) <= 1 or letters = 0 or letters / length(v) < 0.35 or len(w) = 0
            or single >= greatest(2, len(w) // 2 + 1)) as noise from n group by 1""",
    "fp9_garbage_transcripts": f"select unit_id, {sql.garbage('t')} as garbage from (select unit_id, {sql.clean('text')} as t from {_U} where source_type in ('audio', 'video'))",
    "sf1_read_cer": f"""select unit_id, round(case when a = '' and b = '' then 0.0 when a = '' then 1.0 else least(1.0, levenshtein(a, b) / length(a)) end, 4) as cer
        from (select unit_id, {sql.metric('a')} as a, {sql.metric('b')} as b from {_PAIRS})""",
    "sf3_read_f1": rf"""
        with t as (select unit_id, regexp_extract_all(lower({sql.clean('a')}), '[a-z0-9]+(?:''[a-z0-9]+)?') as a,
            regexp_extract_all(lower({sql.clean('b')}), '[a-z0-9]+(?:''[a-z0-9]+)?') as b from {_PAIRS}),
        x as (select unit_id, w, count(*) as n from (select unit_id, unnest(a) as w from t) group by all),
        y as (select unit_id, w, count(*) as n from (select unit_id, unnest(b) as w from t) group by all),
        o as (select unit_id, sum(least(x.n, y.n)) as common from x join y using (unit_id, w) group by 1)
        select unit_id, case when len(a) = 0 and len(b) = 0 then 100.0 when len(a) = 0 or len(b) = 0 or common is null then 0.0
            else round(2 * common / (len(a) + len(b)) * 100, 2) end as f1 from t left join o using (unit_id)""",
    "tk6_best_read": rf"""
        with t as (select ocr_id, unit_id, confidence_score, {sql.clean('text')} as t from {sql.READS}),
        s as (select unit_id, ocr_id, round(coalesce(case when confidence_score >= 0 then confidence_score end, 45.0) * 0.45 + least(30.0, length(t) / 12.0)
            + least(20.0, len(regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9%+./-]*')) * 1.5) + {sql.quality('t')} * 0.35, 6) as score from t where t <> '')
        select unit_id, ocr_id, score from s qualify row_number() over (partition by unit_id order by score desc, ocr_id) = 1""",
    "sm1_summaries": rf"""
        select doc_id, case when length(s) <= 320 then s when instr(left(s, 320), ' ') > 0 then regexp_replace(left(s, 320), ' [^ ]*$', '') || '...'
            else left(s, 320) || '...' end as summary
        from (select doc_id, ({_SENTENCES})[1] as s from documents) where s is not null""",
    "hs1_content_hashes": "select left(sha256(text), 16) as version, min(doc_id) as first_doc, count(*) as documents from documents where text is not null group by sha256(text) having count(*) > 1",
}
