"""Correction of recognised texts as a chain: rules, dosages, words of a dictionary, and how much was changed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions.correction import apply_rules, join_dosage
from scrivener.functions.text import words
from scrivener.operators.matching import correct_words

#: Rules of a new installation, as (pattern, replacement, context).
DEFAULT_RULES = (("rn", "m", "between_vowels"), ("0", "o", "word_only"), ("1", "l", "word_only"), ("|", "l", "word_only"), ("5", "S", "word_start"))
#: Kinds of units whose text was recognised and is corrected.
RECOGNISED = ("image", "page")


def default_rules(spark: SparkSession, existing: DataFrame | None = None) -> DataFrame:
    """``pattern, replacement, context, active, source``: the existing rules, or the default ones if there are none."""
    if existing is not None and existing.limit(1).count():
        return existing
    return spark.createDataFrame([(*r, True, "default") for r in DEFAULT_RULES], "pattern string, replacement string, context string, active boolean, source string")


def all_terms(*dictionaries: DataFrame) -> DataFrame:
    """``term``: the distinct active terms of all dictionaries, trimmed and in lower case."""
    out = None
    for d in dictionaries:
        some = d.where("active").select(F.lower(F.trim("term")).alias("term")).where("term <> ''")
        out = some if out is None else out.unionByName(some)
    return out.distinct()


def changes(before: Column, after: Column) -> Column:
    """Words of ``after`` that differ from the word at the same place of ``before``; both arrays, columns of their own."""
    return F.size(F.filter(F.zip_with(F.slice(before, F.lit(1), F.size(after)), F.slice(after, F.lit(1), F.size(before)), lambda a, b: ~a.eqNullSafe(b)), lambda x: x))


def rule_corrected(df: DataFrame, key: str, text: str, rules: Iterable[tuple[str, str, str]] = DEFAULT_RULES, units: Iterable[str] = ()) -> DataFrame:
    """``key, corrected, corrections``: texts after rules and dosages; corrections are words changed at their place."""
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("__old"))
    rows = rows.withColumn("corrected", join_dosage(apply_rules(F.col("__old"), rules), units))
    rows = rows.withColumns({"__a": words(F.col("__old")), "__b": words(F.col("corrected"))})
    return rows.select(key, "corrected", changes(F.col("__a"), F.col("__b")).cast("long").alias("corrections"))


_CORE = r"^([^\p{L}\p{N}_]*)([\p{L}\p{N}_-]+)([^\p{L}\p{N}_]*)\z"


def corrected(df: DataFrame, key: str, text: str, dictionary: DataFrame, rules: Iterable[tuple[str, str, str]] = DEFAULT_RULES, units: Iterable[str] = (), least: float = 85.0) -> DataFrame:
    """As ``rule_corrected``, with words replaced by the term of ``dictionary`` (column ``term``) that explains them.

    A word of four or more characters without digits keeps the signs around it and its first capital. White space
    becomes single blanks. Each distinct word is compared once; a text gets the few replacements of its own words.
    An empty dictionary leaves the words as they are. ``key`` must be unique.
    """
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("__old"))
    rows = rows.withColumn("__b", words(join_dosage(apply_rules(F.col("__old"), rules), units)))
    core = F.lower(F.regexp_extract("w", _CORE, 2))
    seen = rows.select(key, F.explode(F.array_distinct("__b")).alias("w")).select(key, core.alias("core")).where(F.length("core") >= 4).distinct()
    best = correct_words(seen.select(F.col("core").alias("word")).distinct(), dictionary, least).select(F.col("word").alias("core"), "best")
    own = seen.join(best, "core").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("core", "best"))).alias("__best"))
    full = rows.join(own, key, "left")

    def mend(w: Column) -> Column:
        inner = F.regexp_extract(w, _CORE, 2)
        new = F.try_element_at("__best", F.lower(inner))
        first = F.substring(inner, 1, 1)
        cased = F.when(first != F.lower(first), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)
        return F.when(new.isNotNull(), F.concat(F.regexp_extract(w, _CORE, 1), cased, F.regexp_extract(w, _CORE, 3))).otherwise(w)

    full = full.withColumns({"__new": F.when(F.col("__best").isNotNull(), F.transform("__b", mend)).otherwise(F.col("__b")), "__a": words(F.col("__old"))})
    more = F.greatest(F.size("__new") - F.size("__a"), F.lit(0))
    return full.select(key, F.array_join("__new", " ").alias("corrected"), (changes(F.col("__a"), F.col("__new")) + more).cast("long").alias("corrections"))
