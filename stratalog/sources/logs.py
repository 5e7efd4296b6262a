"""Version logs and their file metadata, built from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_BYTES = 24  # key, tag and value of the logs below, 8 bytes each


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def version_log(df: DataFrame, key, seq, tombstone, value) -> DataFrame:
    """(user_key, seq, vtype, value): one row a version; vtype 0 is a deletion marker."""
    return df.select(key.alias("user_key"), seq.alias("seq"), F.when(tombstone, 0).otherwise(1).alias("vtype"), value.alias("value"))


def with_levels(log: DataFrame) -> DataFrame:
    """Adds level (older half 2, next three tenths 1, newest 0) and file_no (a hundred sequence numbers a file)."""
    n = log.agg((F.max("seq") + 1).alias("_n"))  # one row
    level = F.when(F.col("seq") < 0.5 * F.col("_n"), 2).when(F.col("seq") < 0.8 * F.col("_n"), 1).otherwise(0)
    return log.join(F.broadcast(n)).withColumn("level", level).withColumn("file_no", F.floor(F.col("seq") / 100).cast("long")).drop("_n")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_log(table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id"), F.col("event_type") == "error", F.col("value"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_log(table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderstatus") == "F", F.col("o_totalprice"))


def key_trace(spark: SparkSession, path: str, value_bytes: int = 1000) -> DataFrame:
    """Puts of a text file's keys, one a line, each with a value of value_bytes."""
    rows = spark.read.text(path).select(F.col("value").cast("binary").alias("user_key"))
    return rows.select("user_key", F.lit(1).alias("vtype"), F.lit("x" * value_bytes).cast("binary").alias("value"))


def file_metadata(log: DataFrame, nvm_levels: int = 4) -> DataFrame:
    """One row per (level, file_no): key bounds in internal order, size, tier, allowance of seeks, time of installation."""
    size = (F.count(F.lit(1)) * RECORD_BYTES).alias("file_size")
    low, high = F.min(F.struct("user_key", (-F.col("seq")).alias("s"))), F.max(F.struct("user_key", (-F.col("seq")).alias("s")))
    rows = log.groupBy("level", "file_no").agg(size, low.alias("_lo"), high.alias("_hi"), F.min("seq").alias("installed_at"))
    return rows.select(
        "level", "file_no", "file_size", F.col("_lo.user_key").alias("smallest_key"), (-F.col("_lo.s")).alias("smallest_seq"), F.col("_hi.user_key").alias("largest_key"), (-F.col("_hi.s")).alias("largest_seq"),
        F.when(F.col("level") < nvm_levels, "NVM").otherwise("SSD").alias("tier"), "installed_at", F.greatest(F.lit(100).cast("long"), F.floor(F.col("file_size") / 16384)).alias("allowed_seeks"),
    )
