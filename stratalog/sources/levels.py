"""Version logs stored by level and tier, so that a read opens only the folders and files that may hold its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_levels(log: DataFrame, path: str, nvm_levels: int = 4) -> None:
    """log (user_key, seq, vtype, value, level, file_no) in folders tier=/level=, sorted by key within files: the folders
    prune by level, and the files' own statistics by key."""
    tier = F.when(F.col("level") < nvm_levels, "NVM").otherwise("SSD")
    placed = log.withColumn("tier", tier).repartitionByRange("level", "user_key").sortWithinPartitions("level", "user_key", F.desc("seq"))
    placed.write.mode("errorifexists").partitionBy("tier", "level").parquet(path)


def read_level(spark: SparkSession, path: str, level: int | None = None, tier: str | None = None, start=None, limit=None) -> DataFrame:
    """The rows of one level or tier, or of all, in [start, limit): conditions on folders and on row groups, all pushed down."""
    rows = spark.read.parquet(path)
    for name, value in (("level", level), ("tier", tier)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    rows = rows if start is None else rows.where(F.col("user_key") >= F.lit(start))
    return rows if limit is None else rows.where(F.col("user_key") < F.lit(limit))
