"""A stream of log rows to current state: a lower seq that comes late never overwrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of log files as a stream; files_per_trigger is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def current_state(stream: DataFrame) -> DataFrame:
    """The newest version of each key so far, kept in the state store; run it in update or complete mode, drop markers after."""
    return stream.groupBy("user_key").agg(F.max_by(F.struct("seq", "vtype", "value"), F.struct("seq", "vtype")).alias("v")).select("user_key", "v.*")


def to_memory(state: DataFrame, name: str, checkpoint: str):
    """All that is there, then stop: the state as an in-memory table."""
    return state.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
