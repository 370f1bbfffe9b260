"""Correction of recognised text by rules and dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


_WORD = r"[\p{L}\p{M}\p{N}_]"


def apply_rules(c: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """Replace patterns in order. context: between_vowels, word_start, word_only (within words that are no numbers) or any."""
    out = F.coalesce(c, F.lit(""))
    for pattern, replacement, context in rules:
        if not pattern:
            continue
        p, r = re.escape(pattern), replacement.replace("\\", "\\\\").replace("$", "\\$")
        if context == "between_vowels":
            out = F.regexp_replace(out, f"(?<=[aeiouAEIOU]){p}(?=[aeiouAEIOU])", r)
        elif context == "word_start":
            out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}_]){p}(?=[A-Za-z])", r)
        elif context == "word_only":
            parts = F.regexp_extract_all(out, F.lit(f"{_WORD}+|[^{_WORD[1:]}+"), F.lit(0))
            plain, new = F.lit(pattern), F.lit(replacement)
            mended = F.transform(parts, lambda w: F.when(w.rlike(rf"^{_WORD}+\z") & ~w.rlike(r"^\p{Nd}+\z"), F.replace(w, plain, new)).otherwise(w))
            out = F.array_join(mended, "")
        else:
            out = F.replace(out, F.lit(pattern), F.lit(replacement))
    return out


def join_dosage(c: Column, units: Iterable[str]) -> Column:
    """``10 mg`` as ``10mg`` for the given units."""
    names = "|".join(re.escape(u) for u in sorted(units, key=len, reverse=True) if u)
    return F.regexp_replace(c, rf"(?i)(\d+\.?\d*)\s+({names})(?![\p{{L}}\p{{N}}_])", "$1$2") if names else c


def indel_ratio(a: str, b: str) -> float:
    """Similarity in percent by the longest common subsequence."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def indel_similarity(a: Column, b: Column) -> Column:
    """``indel_ratio`` of two columns, in Arrow batches; null where either is null."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else indel_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)
