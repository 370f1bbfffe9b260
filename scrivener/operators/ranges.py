"""Ordered computations over groups of any size: a group is cut into ranges, and what crosses a border is carried over.

A window over a whole group sorts it in one task. Here a task sorts one range of ``size`` identifiers; a second, short
window runs over one row for each range. Identifiers are whole numbers, unique within the group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Identifiers of one range, and so rows at most of one task's window.
RANGE = 65_536


def _ranges(df: DataFrame, order: str, size: int) -> DataFrame:
    return df.withColumn("__range", F.floor(F.col(order) / size))


def _join_ranges(rows: DataFrame, ends: DataFrame, group: str) -> DataFrame:
    other = ends.select(F.col(group).alias("__group"), F.col("__range").alias("__at"), "__before")
    on = rows[group].eqNullSafe(other["__group"]) & (rows["__range"] == other["__at"])
    return rows.join(other, on).drop("__group", "__at", "__range")


def sum_before(df: DataFrame, group: str, order: str, value: str, out: str, size: int = RANGE) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows that stand before a row in its group; 0 for the first."""
    rows = _ranges(df, order, size)
    inside = Window.partitionBy(group, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(group, "__range").agg(F.sum(value).alias("s"))
    earlier = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("__before", F.coalesce(F.sum("s").over(earlier), F.lit(0)))
    rows = rows.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return _join_ranges(rows, ends, group).withColumn(out, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def last_known(df: DataFrame, group: str, order: str, value: str, out: str, size: int = RANGE) -> DataFrame:
    """Adds ``out``: the last ``value`` that is not null, of the row itself or of a row before it in its group."""
    rows = _ranges(df, order, size)
    inside = Window.partitionBy(group, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    given = F.col(value).isNotNull()
    lasts = rows.groupBy(group, "__range").agg(F.max_by(F.when(given, F.col(value)), F.when(given, F.col(order))).alias("v"))
    earlier = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = lasts.withColumn("__before", F.last("v", ignorenulls=True).over(earlier))
    rows = rows.withColumn("__inside", F.last(value, ignorenulls=True).over(inside))
    return _join_ranges(rows, ends, group).withColumn(out, F.coalesce("__inside", "__before")).drop("__before", "__inside")


def framed(
    df: DataFrame, group: str, order: str, reach: int, value: Callable[[Window], Column], out: str, size: int = RANGE
) -> DataFrame:
    """Adds ``out``: ``value`` over the rows at most ``reach`` places before and after a row in its group.

    Rows are numbered first (see ``sum_before``); a range holds ``size`` places, and the rows near a border belong to
    both ranges for the computation and to one for the result.
    """
    numbered = sum_before(df.withColumn("__one", F.lit(1)), group, order, "__one", "__place", size).drop("__one")
    own = F.floor(F.col("__place") / size)
    near = F.array_distinct(F.array(F.floor((F.col("__place") - reach) / size), own, F.floor((F.col("__place") + reach) / size)))
    rows = numbered.withColumn("__own", own).withColumn("__part", F.explode(near))
    around = Window.partitionBy(group, "__part").orderBy("__place").rowsBetween(-reach, reach)
    return rows.withColumn(out, value(around)).where("__part = __own").drop("__place", "__own", "__part")
