"""Writes: batches, upserts and deletes as rows appended to a log."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_batches(batches: DataFrame) -> DataFrame:
    """(base_seq, ops array<struct<vtype, user_key, value>>) to log rows: op i of a batch has seq base_seq + i, so that of
    several operations on a key the last wins, and a batch is visible as a whole from its last seq on."""
    return batches.select("base_seq", F.posexplode("ops").alias("op_idx", "op")).select("op.user_key", (F.col("base_seq") + F.col("op_idx")).alias("seq"), "op.vtype", "op.value")


def batch_problems(batches: DataFrame) -> DataFrame:
    """Batches that replay would refuse: a wrong count, an unknown kind, a missing key."""
    bad = F.when(F.col("count") != F.size("ops"), "WRONG_COUNT").when(F.exists("ops", lambda o: ~o["vtype"].isin(0, 1)), "UNKNOWN_TAG").when(F.exists("ops", lambda o: o["user_key"].isNull()), "MALFORMED")
    return batches.withColumn("problem", bad).where("problem is not null")


def append_batches(target: DataFrame, source: DataFrame, key: str = "batch_id") -> DataFrame:
    """target and source (batch_id, op_idx, vtype, user_key, value) as one batch for each id: the source's operations come
    after the target's, their op_idx moved on by as many as the target has, so that they win where both write a key. A batch
    that only one side has stays as it is. Clearing a batch is taking an empty one as target."""
    n = target.groupBy(key).agg((F.max("op_idx") + 1).alias("_n"))
    moved = source.join(n, key, "left").withColumn("op_idx", (F.col("op_idx") + F.coalesce("_n", F.lit(0))).cast(dict(source.dtypes)["op_idx"]))
    return target.unionByName(moved.drop("_n").select(*target.columns))


def approximate_batch_size(ops: DataFrame, key: str = "batch_id") -> DataFrame:
    """(batch_id, bytes) of each batch as it is written: a header of 12 bytes, and for each operation its kind, its key and,
    unless it deletes, its value, each after its length as a variable-length integer."""
    part = lambda c: F.when(F.octet_length(c) < 128, 1).when(F.octet_length(c) < 1 << 14, 2).when(F.octet_length(c) < 1 << 21, 3).otherwise(4) + F.octet_length(c)
    size = 1 + part("user_key") + F.when(F.col("vtype") == 1, part("value")).otherwise(0)
    return ops.groupBy(key).agg((F.sum(size) + 12).cast("long").alias("bytes"))


def append(log: DataFrame, rows: DataFrame) -> DataFrame:
    return log.unionByName(rows)


def put(keys: DataFrame, first_seq: int) -> DataFrame:
    """Log rows for keys (user_key, value, op_idx)."""
    return keys.select("user_key", (F.lit(first_seq) + F.col("op_idx")).alias("seq"), F.lit(1).alias("vtype"), "value")


def delete(keys: DataFrame, first_seq: int, value_type: str = "double") -> DataFrame:
    """Deletion markers for keys (user_key, op_idx); a key that does not exist may be deleted."""
    return keys.select("user_key", (F.lit(first_seq) + F.col("op_idx")).alias("seq"), F.lit(0).alias("vtype"), F.lit(None).cast(value_type).alias("value"))


def read_modify_write(state: DataFrame, updates: DataFrame, fields: list[str]) -> DataFrame:
    """state with the fields that updates (user_key, fields) give; keys that do not exist are not made."""
    new = updates.select("user_key", *[F.col(f).alias(f"_{f}") for f in fields])
    return state.join(new, "user_key", "left").select("user_key", *[F.coalesce(f"_{f}", f).alias(f) if f in fields else f for f in state.columns if f != "user_key"])


def group_commit(writes: DataFrame, most: int = 1 << 20, extra: int = 128 << 10) -> DataFrame:
    """(queue, op_idx, size, sync) with the group that a leader commits each write in: writers join in order while the group
    stays within `most` bytes (a small leader: its size and `extra`), and a sync write never joins a leader that is not."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("op_idx", ignore_index=True)
        group, total, limit, leader_sync, out = -1, 0, -1, False, []
        for size, sync in zip(pdf["size"], pdf["sync"], strict=True):
            if group < 0 or total + size > limit or (sync and not leader_sync):
                group, total, leader_sync = group + 1, 0, bool(sync)
                limit = size + extra if size <= extra else most
            total += size
            out.append(group)
        return pdf.assign(commit_group=pd.Series(out, dtype="int64"))

    return writes.groupBy("queue").applyInPandas(fold, "queue long, op_idx long, size long, sync boolean, commit_group long")
