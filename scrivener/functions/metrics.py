"""Error rates and similarities of texts and vectors."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.functions.text import clean_text, metric_text


def cer(reference: Column, read: Column) -> Column:
    """Characters to change per character of the reference, 0 to 1; 1 if only the reference is empty."""
    a, b = metric_text(reference), metric_text(read)
    rate = F.levenshtein(a, b) / F.length(a)
    return F.when((a == "") & (b == ""), 0.0).when(a == "", 1.0).otherwise(F.least(F.lit(1.0), rate))


#: Different words of a pair that have an own character; with more, the words are compared in Python.
MOST_WORDS = 30_000


def word_distance(a: Sequence[str], b: Sequence[str]) -> int:
    """Words to insert, delete or replace, row by row over numbers that stand for the words."""
    number = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([number[w] for w in b], np.int64)
    at = np.arange(len(y) + 1)
    row = at.copy()
    for i, w in enumerate(a, 1):
        new = np.r_[i, np.minimum(row[1:] + 1, row[:-1] + (y != number[w]))]
        row = np.minimum.accumulate(new - at) + at
    return int(row[-1])


@F.pandas_udf(T.LongType())
def _long_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else word_distance(x, y) for x, y in zip(a, b)], dtype="Int64")


def metric_words(c: Column) -> Column:
    """Words of the form in which error rates are measured."""
    return F.filter(F.split(metric_text(c), " "), lambda w: w != "")


def evaluation_tokens(c: Column) -> Column:
    """Words in lower case, with an inner apostrophe."""
    return F.regexp_extract_all(F.lower(clean_text(c)), F.lit("[a-z0-9]+(?:'[a-z0-9]+)?"), F.lit(0))


def word_rates(df: DataFrame, expected: Column, actual: Column, out: str) -> DataFrame:
    """Adds ``out``: words to insert, delete or replace per expected word; 1 if only the expected text has none.

    Each different word of the pair stands for one character, so that the built-in edit distance counts words; pairs of
    more than ``MOST_WORDS`` different words go to ``word_distance``, with the same result. May be above 1.
    """
    # columns of their own, as expressions within the lambda would be computed for every word
    rows = df.withColumns({"__a": expected, "__b": actual})
    rows = rows.withColumn("__known", F.array_distinct(F.concat("__a", "__b")))

    def letters(x: str) -> Column:
        codes = F.transform(x, lambda w: F.lpad(F.hex(F.array_position(F.col("__known"), w) + 0x4E00), 4, "0"))
        return F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")

    few = F.size("__known") <= MOST_WORDS
    rows = rows.withColumn("__far", _long_distance(F.when(~few, F.col("__a")), F.when(~few, F.col("__b"))))
    distance = F.when(few, F.levenshtein(letters("__a"), letters("__b"))).otherwise(F.col("__far"))
    rate = F.when(F.size("__known") == 0, 0.0).when(F.size("__a") == 0, 1.0).otherwise(distance / F.size("__a"))
    return rows.withColumn(out, rate).drop("__a", "__b", "__known", "__far")


def token_f1(df: DataFrame, expected: Column, actual: Column, out: str) -> DataFrame:
    """Adds ``out``: harmonic mean, in percent, of the shares of common words; a word counts as often as both have it."""
    rows = df.withColumns({"__a": F.array_sort(evaluation_tokens(expected)), "__b": F.array_sort(evaluation_tokens(actual))})

    def numbered(x: str) -> Column:
        """Words with the number of their occurrence: sets whose intersection is that of the multisets."""
        c = F.col(x)
        return F.when(F.size(c) > 0, F.transform(c, lambda w, i: F.concat_ws("#", w, (i - F.array_position(F.col(x), w)).cast("string"))))

    common = F.size(F.array_intersect(numbered("__a"), numbered("__b")))
    a, b = F.size("__a"), F.size("__b")
    f1 = F.when((a == 0) & (b == 0), 100.0).when((a == 0) | (b == 0) | (common == 0), 0.0).otherwise(F.round(2 * common / (a + b) * 100, 2))
    return rows.withColumn(out, f1).drop("__a", "__b")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 for vectors that are null, empty, of other lengths or all zero."""
    zero = F.lit(0.0)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), zero, lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(F.coalesce(fits & (norm > 0), F.lit(False)), dot(a, b) / norm).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def text_similarity(expected: Column, actual: Column) -> Column:
    """Likeness in percent of two texts in lower case by their longest common stretches; 100 for two empty ones."""
    a, b = F.lower(clean_text(expected)), F.lower(clean_text(actual))
    return F.when((a == "") & (b == ""), 100.0).otherwise(F.round(_likeness(a, b) * 100, 2))
