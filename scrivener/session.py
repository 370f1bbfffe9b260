"""Session helpers shared by all operators: reading tables, cutting lineage, sizing partitions."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; columns are pruned and filters pushed down by the reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only a local test session that names none gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="scrivener-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Re-delivered keys at most that go to every task; with more of them the rows themselves are shuffled.
MOST_REPEATED = 1_000_000


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Count re-delivered rows once: one row for each key. Rows of one key have the same content.

    Rows of files are told apart by their place in the file: only keys and places are shuffled, not texts. The few keys
    that occur again, if at most ``MOST_REPEATED``, go to every task with the place of the row that stays. Rows from
    elsewhere, rows without texts and rows with more repeated keys are shuffled as they are. Null keys are one key.
    """
    narrow = all(not isinstance(f.dataType, (T.StringType, T.ArrayType, T.StructType, T.MapType, T.BinaryType)) for f in df.schema if f.name not in keys)
    if narrow or df._jdf.queryExecution().analyzed().metadataOutput().size() != 1:
        return df.dropDuplicates(list(keys))
    placed = df.withColumn("__place", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    again = placed.groupBy(*keys).agg(F.min("__place").alias("__stays"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = cut(again.select(*[F.col(k).alias(f"__{k}") for k in keys], "__stays"))
    if again.count() > MOST_REPEATED:
        return df.dropDuplicates(list(keys))
    same = [placed[k].eqNullSafe(again[f"__{k}"]) for k in keys]
    rows = placed.join(F.broadcast(again), same, "left")  # at most MOST_REPEATED rows
    return rows.where("__stays is null or __stays = __place").select(*df.columns)
