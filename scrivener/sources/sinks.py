"""Result tables as Parquet folders: append, replacement as a whole, update by key."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions.text import words
from scrivener.operators.tables import newest, upsert


def append(df: DataFrame, path: str) -> None:
    """Add rows to a history."""
    df.write.mode("append").parquet(path)


def report_name(key: Column) -> Column:
    """A safe name of at most 80 characters for a report; ``material`` if nothing is left of the key."""
    plain = F.regexp_replace(F.coalesce(key.cast("string"), F.lit("")), r"[^A-Za-z0-9._-]+", "_")
    name = F.substring(F.regexp_replace(plain, r"^[._-]+|[._-]+\z", ""), 1, 80)
    return F.when(name == "", "material").otherwise(name)


def write_reports(df: DataFrame, path: str, key: str) -> None:
    """Add each row as JSON, with its nulls, to the folder ``report=accuracy_<time>_<name of its key>``."""
    time = F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss_SSSSSS")
    named = df.withColumn("report", F.concat(F.lit("accuracy_"), time, F.lit("_"), report_name(F.col(key))))
    named.write.mode("append").option("ignoreNullFields", False).partitionBy("report").json(path)


def with_record_key(df: DataFrame, key: str, own: str) -> DataFrame:
    """``record_key`` of old rows that lack it or whose is null: ``key::own``; others keep theirs."""
    made = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("::"), F.col(own).cast("string"))
    return df.withColumn("record_key", F.coalesce("record_key", made) if "record_key" in df.columns else made)


def _paths(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target = hadoop(path.rstrip("/"))
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop, path.rstrip("/")


def recover(spark: SparkSession, path: str) -> None:
    """Bring back the table that a crash within ``replace`` has left under its other name."""
    fs, hadoop, base = _paths(spark, path)
    if not fs.exists(hadoop(base)) and fs.exists(hadoop(f"{base}.before")):
        fs.rename(hadoop(f"{base}.before"), hadoop(base))


def replace(df: DataFrame, path: str) -> None:
    """Write the new table beside the old one and swap them, so that the plan may read the old one.

    The old table keeps another name until the new one has its place; see ``recover``.
    """
    spark = df.sparkSession
    fs, hadoop, base = _paths(spark, path)
    beside, before = f"{base}.{uuid.uuid4().hex}", f"{base}.before"
    df.write.parquet(beside)
    if fs.exists(hadoop(base)):
        fs.delete(hadoop(before), True)
        if not fs.rename(hadoop(base), hadoop(before)):
            raise OSError(f"cannot move {base}")
    if not fs.rename(hadoop(beside), hadoop(base)):
        raise OSError(f"cannot rename {beside} to {base}")
    fs.delete(hadoop(before), True)


def merge(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] = ()) -> None:
    """Update the table by key; of several new rows of a key that of greatest ``order`` holds."""
    spark = df.sparkSession
    recover(spark, path)
    old = spark.read.parquet(path)
    replace(upsert(old, newest(df, keys, order).select(*old.columns), keys, keep), path)


def message_table(messages: DataFrame, order: str) -> DataFrame:
    """Key messages as they replace a stored table: blank ids left out, a ``record_key`` of id and place, key words made where missing."""
    long = F.filter(F.transform(words(F.col("key_message")), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", "")), lambda w: F.length(w) > 4)
    made = F.array_join(F.slice(F.array_distinct(long), 1, 6), ", ")
    rows = messages.where(F.trim("key_message_id") != "")
    key = F.concat(F.col("key_message_id"), F.lit("::"), F.col(order).cast("string"))
    return rows.withColumns({"record_key": key, "key_words": F.coalesce(F.when(F.trim("key_words") != "", F.col("key_words")), made)})
