"""Top N rows of every group by two-stage salted ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: Sequence[str], score: str, tie: str, n: int, salts: int = 16) -> DataFrame:
    """The ``n`` rows of highest ``score`` within each group of ``keys``, with their ``place`` (int, from 1).

    Stage one hashes each group into ``salts`` subgroups by the identifier ``tie`` and keeps the ``n`` best of each;
    Spark puts a rank limit before the exchange as well, so a task sends at most ``n`` rows of a subgroup.
    Stage two ranks the survivors, at most ``n * salts`` rows of a group whatever its size.

    Higher scores come first; of equal scores the smaller ``tie``. Rows whose score is null or NaN or whose ``tie`` is
    null have no place. -0.0 equals 0.0. A null key is a group of its own. A row delivered again (same ``tie`` and
    score) counts once; should one ``tie`` come with several scores, its best place is kept. A group with fewer rows
    gives all of them; an empty table or ``n`` below 1 gives no row. Only the named columns are carried.
    """
    if len({*keys, score, tie}) != len(keys) + 2:
        raise ValueError("keys, score and tie must be different columns")
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(
        *[df[k].alias(a) for k, a in zip(keys, names)], (df[score] + F.lit(0.0)).alias("s"), df[tie].alias("t")
    ).where("s is not null and not isnan(s) and t is not null")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(salts)).cast("int"))
    order = [F.desc("s"), F.asc("t")]
    first = Window.partitionBy(*names, "salt").orderBy(*order)
    kept = rows.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= n).drop("r", "salt")
    second = Window.partitionBy(*names).orderBy(*order)
    ranked = kept.withColumn("place", F.dense_rank().over(second)).withColumn("before", F.lag("t").over(second))
    once = ranked.where((F.col("place") <= n) & (F.col("before").isNull() | (F.col("before") != F.col("t"))))
    out = once.select(*[F.col(a).alias(k) for k, a in zip(keys, names)], F.col("s").alias(score), F.col("t").alias(tie), "place")
    return out
