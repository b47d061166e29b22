"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_GROUPS = 100_000  # rows of group statistics up to which they are broadcast


def shared_folder(spark: SparkSession) -> str:
    """A folder that every executor reaches: ``spark.checkpoint.dir``, or where that is unset one in the warehouse."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are computed once and read back from the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_statistics(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join one row per group to its rows without dealing the rows out by a handful of keys.

    The statistics are stored and counted first; up to :data:`BROADCAST_GROUPS` groups are broadcast, more are joined by key.
    """
    stats = cut_lineage(stats)
    if stats.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        stats = F.broadcast(stats)
    return df.join(stats, keys, how)


def join_groups(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """The same without a job of its own: nothing runs before an action.

    The plan is a join by key; adaptive planning broadcasts the statistics once their size is known, and else splits the
    partitions of hot groups.
    """
    return df.join(stats, keys, how)
