"""Operations on stored tables: newest version, upsert, insert of what is missing, soft deletion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest values of ``order``, nulls last; partial aggregation keeps hot keys cheap."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    best = df.groupBy(*keys).agg(F.max(by).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of ``old`` replaced by those of ``new`` with the same key, others added. Columns in ``keep`` keep old values.

    ``new`` must have one row for each key (see ``newest``). Null keys are equal to each other.
    """
    a, b = old.alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.join(b, on, "full_outer")

    def value(c: str) -> Column:
        was_new = F.col("b.__new").isNotNull()
        if c in keep:
            return F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
        return F.when(was_new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)

    return both.select(*[value(c) for c in old.columns])


def missing(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Distinct rows of ``new`` whose key ``old`` lacks."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


def soft_delete(df: DataFrame, which: Column) -> DataFrame:
    """Mark rows as inactive instead of removing them."""
    return df.withColumn("active", F.when(which, F.lit(False)).otherwise(F.col("active")))


def page_of(df: DataFrame, order: Sequence[Column], start: int, count: int) -> DataFrame:
    """Rows ``start`` to ``start + count`` of an order, as a page of a preview; sorted once, without a window."""
    return df.orderBy(*order).offset(start).limit(count)


def content_key(*parts: Column) -> Column:
    """One key for what a result depends on: content hashes, parameters and versions; null counts as a part of its own."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def unprocessed(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key no earlier run has in ``done``; each key once."""
    return missing(new, done, key)


def changed_files(files: DataFrame, loaded: DataFrame) -> DataFrame:
    """Files ``path, modified, size`` that were not loaded in this state."""
    return files.join(loaded.select("path", "modified", "size"), ["path", "modified", "size"], "left_anti")


def patch(df: DataFrame, changes: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """Rows with the values of ``changes`` (one row for each key) that are not null, in the allowed columns only."""
    named = changes.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in allowed if c in changes.columns])
    full = df.join(named, key, "left")
    return full.select(*[F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in full.columns else F.col(c) for c in df.columns])


def page_size(wanted: int, most: int) -> int:
    """A number of rows between 1 and ``most``."""
    return max(1, min(wanted, most))
