"""Scores of how readable an extracted text is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivener.functions.text import clean_text

_WORD = r"[A-Za-z0-9][A-Za-z0-9%+./-]*"


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def half_up(c: Column, digits: int) -> Column:
    """Rounded half up by plain arithmetic, which every engine does alike; ``round`` is decided by decimal digits in some."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def text_quality(c: Column) -> Column:
    """0 to 100 from the shares of letters, of different words and of longer words, and the length; 5 without words."""
    t = clean_text(c)
    w = _all(t, _WORD)
    letters, n = F.regexp_count(t, F.lit("[A-Za-z]")), F.size(w)
    different = F.size(F.array_distinct(F.transform(w, F.lower)))
    longer = F.size(F.filter(w, lambda x: F.length(x) >= 3))
    score = letters / F.length(t) * 35.0 + different / n * 25.0 + longer / n * 20.0 + F.least(F.lit(20.0), F.length(t) / 30.0)
    return F.when(t == "", 0.0).when((n == 0) | (letters == 0), 5.0).otherwise(half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2))


def is_weak(c: Column, least_chars: int = 30, least_quality: float = 35.0) -> Column:
    """Too short or of too low quality to be used."""
    return (F.length(clean_text(c)) < least_chars) | (text_quality(c) < least_quality)


def noise_ratio(c: Column) -> Column:
    """Share of unusual characters; 1 for an empty text."""
    t = clean_text(c)
    usual = F.regexp_count(t, F.lit(r"[A-Za-z0-9\s.,;:!?%/()+\-–—~®™•'’]"))
    return F.when(t == "", 1.0).otherwise(half_up(F.greatest(F.lit(0.0), 1.0 - usual / F.length(t)), 4))


def garbled_ratio(c: Column) -> Column:
    """Share of words of five or more letters with hardly a vowel or six consonants in a row; 1 without words."""
    w = _all(clean_text(c), r"[A-Za-z][A-Za-z0-9\-]*")

    def bad(x: Column) -> Column:
        letters, vowels = F.regexp_count(x, F.lit("[A-Za-z]")), F.regexp_count(x, F.lit("[AEIOUaeiou]"))
        return (letters >= 5) & ((vowels / letters < 0.16) | x.rlike("(?i)[bcdfghjklmnpqrstvwxyz]{6,}"))

    return F.when(F.size(w) == 0, 1.0).otherwise(F.round(F.size(F.filter(w, bad)) / F.size(w), 4))


def is_noise_line(line: Column) -> Column:
    """No text: too short, without letters or with few, or made of single characters."""
    v = F.regexp_replace(clean_text(line), r"^[ .,:;|\[\]{}()]+|[ .,:;|\[\]{}()]+\z", "")
    letters = F.regexp_count(v, F.lit("[A-Za-z]"))
    w = _all(v, "[A-Za-z0-9%+.-]+")
    single = F.size(F.filter(w, lambda x: F.length(F.regexp_replace(x, "[^A-Za-z0-9]", "")) <= 1))
    return (
        (F.length(v) <= 1) | (letters == 0) | (letters / F.length(v) < 0.35) | (F.size(w) == 0)
        | (single >= F.greatest(F.lit(2), F.floor(F.size(w) / 2) + 1))
    )


def is_garbage_transcript(c: Column) -> Column:
    """Speech recognition that made no words: too short, numbers only, hardly vowels, or repetitions."""
    t = clean_text(c)
    tokens = _all(t, "[A-Za-z0-9]+")
    alpha = F.size(F.filter(tokens, lambda x: x.rlike("[A-Za-z]")))
    short = F.size(F.filter(tokens, lambda x: (F.length(x) <= 2) | x.rlike(r"^(\d+|[A-Za-z]\d+|\d+[A-Za-z])\z")))
    letters, vowels = F.regexp_count(t, F.lit("[A-Za-z]")), F.regexp_count(t, F.lit("[AEIOUaeiou]"))
    n = F.size(tokens)
    return (
        (alpha == 0) | ((F.length(t) < 8) & (alpha <= 1)) | ((n >= 4) & (short / F.greatest(n, F.lit(1)) > 0.7))
        | ((letters >= 12) & (vowels / F.greatest(letters, F.lit(1)) < 0.18))
        | t.rlike(r"(?i)\b([a-z0-9])(?:\s+\1\b){4,}") | t.rlike(r"([A-Za-z0-9])\1{5,}")
    )


def is_usable_segment(text: Column, no_speech: Column, log_probability: Column, compression: Column) -> Column:
    """A transcript segment worth keeping; numbers that cannot be read count as 0."""
    quiet, sure, dense = (F.coalesce(x.try_cast("double"), F.lit(0.0)) for x in (no_speech, log_probability, compression))
    return ~is_garbage_transcript(text) & ~((quiet >= 0.65) & (sure <= -0.8)) & (sure > -1.2) & (dense < 2.8)


def selection_score(text: Column, confidence: Column) -> Column:
    """Rank of a machine read among others of its unit: confidence (45 if unknown), length, words and quality."""
    t = clean_text(text)
    n = F.size(_all(t, _WORD))
    known = F.when(confidence.isNotNull() & (confidence >= 0), confidence)
    return (
        F.coalesce(known, F.lit(45.0)) * 0.45 + F.least(F.lit(30.0), F.length(t) / 12.0) + F.least(F.lit(20.0), n * 1.5)
        + text_quality(text) * 0.35
    )


def completeness(extracted: Column, total: Column) -> Column:
    """Percent of a document's elements or a workbook's cells that were extracted, 0 without any; and a warning under 90."""
    score = F.when(total > 0, half_up(extracted / total * 100, 2)).otherwise(0.0)
    return F.struct(score.alias("accuracy"), F.when(score < 90, "Some elements failed to extract").alias("warning"))
