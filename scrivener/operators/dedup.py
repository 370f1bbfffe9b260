"""Removal of repeated parts within a row, first occurrence kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_parts(df: DataFrame, parts: str, key: Callable[[Column], Column]) -> DataFrame:
    """The array ``parts`` without those whose key occurred before or is empty, in order; null becomes empty.

    Sorting by key and place finds the first occurrences in n log n steps, within the row and without a shuffle.
    """
    empty = F.array().cast("array<string>")
    keyed = F.transform(F.coalesce(F.col(parts), empty), lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    # the sorted array is a column of its own, as an expression within the lambda would be sorted for every element
    rows = df.withColumn("__sorted", F.array_sort(keyed))
    first = F.filter(
        "__sorted", lambda e, i: (e["k"] != "") & ((i == 0) | (F.get(F.col("__sorted"), i - 1)["k"] != e["k"]))
    )
    back = F.array_sort(F.transform(first, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
    return rows.withColumn(parts, F.transform(back, lambda e: e["x"])).drop("__sorted")
