"""Corrected texts, dictionaries and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions import text
from scrivener.functions.correction import join_dosage
from scrivener.operators.correction import DEFAULT_RULES, RECOGNISED, all_terms, corrected, default_rules, rule_corrected
from scrivener.operators.tables import missing, soft_delete
from scrivener.plans import sql
from scrivener.session import once, table

UNITS = ("mg", "ml", "mcg", "g", "iu")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "ocr_results").select("ocr_id", "text"), "ocr_id")


def dosages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every machine read with numbers and units of dosage joined."""
    return _reads(spark, sf_dir).select("ocr_id", join_dosage(F.coalesce("text", F.lit("")), UNITS).alias("joined"))


def rule_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every machine read after the default rules and dosages, and how many of its words changed."""
    return rule_corrected(_reads(spark, sf_dir), "ocr_id", "text", DEFAULT_RULES, UNITS)


def dictionaries(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three dictionaries with an activity mark: brands, words of criteria (of all versions but the first) and key words."""
    brands = table(spark, sf_dir, "key_message_matches").select(F.col("brand_product").alias("term"), F.lit(True).alias("active")).distinct()
    items = table(spark, sf_dir, "checklist_items").select(F.explode(text.evidence_terms(F.col("checklist_description"))).alias("term"), "checklist_version")
    items = soft_delete(items.withColumn("active", F.lit(True)), F.col("checklist_version") == "v1").select("term", "active")
    stored = table(spark, sf_dir, "key_message_matches").select(F.explode(F.split("key_words", r"[,;|]\s*")).alias("term"), F.lit(True).alias("active"))
    return [brands, items, stored]


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct active terms of all dictionaries."""
    return all_terms(*dictionaries(spark, sf_dir))


def active_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria that are still active after the first version was marked as deleted."""
    items = table(spark, sf_dir, "checklist_items").select("vec_id", "item_code", "checklist_version").withColumn("active", F.lit(True))
    return soft_delete(items, F.col("checklist_version") == "v1").where("active").drop("active")


def new_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored key phrases of analyses that no dictionary has yet."""
    found = table(spark, sf_dir, "analysis_results").select(F.explode("extracted_keywords").alias("k")).select(F.lower(F.trim("k")).alias("term")).where("term <> ''")
    return missing(found.distinct(), terms(spark, sf_dir), "term")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a new installation."""
    return default_rules(spark)


def corrected_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every machine read after rules, dosages and the words of the dictionaries."""
    return corrected(_reads(spark, sf_dir), "ocr_id", "text", terms(spark, sf_dir), DEFAULT_RULES, UNITS)


def corrected_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit with its corrected text and length: recognised kinds after rules and dosages, others as they are."""
    units = once(table(spark, sf_dir, "source_chunks").select("unit_id", "source_type", "text"), "unit_id")
    seen = units.where(F.col("source_type").isin(*RECOGNISED) & (text.clean_text(F.col("text")) != ""))
    rest = units.where(~F.coalesce(F.col("source_type").isin(*RECOGNISED) & (text.clean_text(F.col("text")) != ""), F.lit(False)))
    new = rule_corrected(seen, "unit_id", "text", DEFAULT_RULES, UNITS)
    old = rest.select("unit_id", F.col("text").alias("corrected"), F.lit(0).cast("long").alias("corrections"))
    return new.unionByName(old).withColumn("text_length", F.length("corrected"))


QUERIES = {
    "cr2_dosages": dosages, "cr4_rule_corrections": rule_corrections, "so3_terms": terms, "fp13_active_items": active_items, "sk8_new_terms": new_terms,
    "sc24_default_rules": rules, "cr3_corrected_reads": corrected_reads, "cr5_corrected_units": corrected_units,
}


def _dosage(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)(\d+\.?\d*)\s+({'|'.join(sorted(UNITS, key=len, reverse=True))})([^\p{{L}}\p{{N}}_]|$)', '\1\2\3', 'g')"


def _ruled(x: str) -> str:
    """The default rules on an engine without looking around: twice where matches may share a letter."""
    vowels = "[aeiouAEIOU]"
    for _ in range(2):
        x = rf"regexp_replace({x}, '({vowels})rn({vowels})', '\1m\2', 'g')"
    word = r"[\p{L}\p{M}\p{N}_]"
    for a, b in (("0", "o"), ("1", "l")):
        parts = rf"regexp_extract_all({x}, '{word}+|[^{word[1:]}+')"
        x = rf"array_to_string(list_transform({parts}, lambda w: case when regexp_full_match(w, '{word}+') and not regexp_full_match(w, '\p{{Nd}}+') then replace(w, '{a}', '{b}') else w end), '')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])5([A-Za-z])', '\1S\2', 'g')"
    return x


_CHANGES = "len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] is distinct from b[i]))"
_TERMS = f"""
    (select distinct lower(trim(term)) as term from (select distinct brand_product as term from key_message_matches
        union all select unnest({sql.evidence('checklist_description')}) from checklist_items where checklist_version <> 'v1' or checklist_version is null
        union all select unnest(regexp_split_to_array(key_words, '[,;|]\\s*')) from key_message_matches) where trim(term) <> '')
"""

SQL = {
    "cr2_dosages": f"""select ocr_id, {_dosage("coalesce(text, '')")} as joined from {sql.READS}""",
    "cr4_rule_corrections": f"""
        with t as (select ocr_id, coalesce(text, '') as t, {_dosage(_ruled("coalesce(text, '')"))} as corrected from {sql.READS}),
        w as (select ocr_id, corrected, {sql.words('t')} as a, {sql.words('corrected')} as b from t) select ocr_id, corrected, {_CHANGES} as corrections from w""",
    "so3_terms": f"select term from {_TERMS}",
    "fp13_active_items": "select vec_id, item_code, checklist_version from checklist_items where checklist_version is null or checklist_version <> 'v1'",
    "sk8_new_terms": f"""select distinct lower(trim(k)) as term from (select unnest(extracted_keywords) as k from analysis_results) where trim(k) <> '' and lower(trim(k)) not in (select term from {_TERMS})""",
    "sc24_default_rules": "select * from (values " + ", ".join(f"('{p}', '{r}', '{c}', true, 'default')" for p, r, c in DEFAULT_RULES) + ") as t(pattern, replacement, context, active, source)",
    "cr5_corrected_units": f"""
        with u as (select unit_id, text, coalesce(source_type in ('image', 'page') and {sql.clean('text')} <> '', false) as seen, coalesce(text, '') as t from {sql.UNITS}),
        c as (select unit_id, seen, t, case when seen then {_dosage(_ruled("t"))} else text end as corrected from u),
        w as (select *, {sql.words('t')} as a, {sql.words("coalesce(corrected, '')")} as b from c)
        select unit_id, corrected, case when seen then {_CHANGES} else 0 end as corrections, length(corrected) as text_length from w""",
}
