"""Compaction: which versions may go, which files to compact, where results and hot keys live."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .files import overlap_bytes
from .ordered import sweep

# Triggers and sizes of levels.
L0_TRIGGER, L0_SLOWDOWN, L0_STOP = 8, 16, 30
BASE_BYTES, MULTIPLE = 5 * 1024 * 1024, 4
GRANDPARENT_FILES, EXPAND_FILES = 6, 25


def smallest_snapshot(snapshots: DataFrame, last_seq: int) -> int:
    """The oldest live snapshot, or the last sequence number if there is none."""
    return snapshots.agg(F.coalesce(F.min("seq"), F.lit(last_seq))).first()[0]


def drop_shadowed(log: DataFrame, oldest: int) -> DataFrame:
    """Versions that stay: those with no newer version of their key at or below the oldest snapshot. These are all above it
    and each key's newest one up to it, which needs no order among a hot key's versions."""
    from .resolve import newest_by_max

    below = newest_by_max(log.where(F.col("seq") <= oldest))
    return log.where(F.col("seq") > oldest).unionByName(below)


def drop_markers(log: DataFrame, oldest: int, deeper: DataFrame) -> DataFrame:
    """Deletion markers go too if they are at or below the oldest snapshot and no deeper file (smallest_key, largest_key)
    covers their key: in the order of keys, whether any file that began before or at the marker's key ends at or after it."""
    gone = (F.col("vtype") == 0) & (F.col("seq") <= oldest)
    markers, rest = log.where(gone), log.where(~gone)
    begun = deeper.select(F.col("smallest_key").alias("user_key"), F.col("largest_key").alias("_end"), F.lit(0).alias("_tie"))
    both = markers.withColumn("_end", F.lit(None).cast(begun.schema["_end"].dataType)).withColumn("_tie", F.lit(1)).unionByName(begun, allowMissingColumns=True)
    kept = sweep(both, ["user_key", "_tie", "seq"], {"_reach": ("max", F.col("_end"))}, "markers").where("_tie = 1 and _reach >= user_key")
    return rest.unionByName(kept.select(*log.columns))


def max_bytes(level):
    return F.lit(float(BASE_BYTES)) * F.pow(F.lit(float(MULTIPLE)), F.greatest(level - 1, F.lit(0)))


def scores(files: DataFrame, base: int = BASE_BYTES) -> DataFrame:
    """Per level: files over the trigger at level 0, bytes over the level's limit below; a score of 1 or more asks for work."""
    by = files.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))
    limit = max_bytes(F.col("level")) * (base / BASE_BYTES)
    return by.select("level", F.when(F.col("level") == 0, F.col("n") / L0_TRIGGER).otherwise(F.col("bytes") / limit).alias("score"))


def back_pressure(files: DataFrame) -> DataFrame:
    n = F.sum(F.when(F.col("level") == 0, 1).otherwise(0))
    return files.agg(F.coalesce(n, F.lit(0)).alias("l0_files")).withColumn("action", F.when(F.col("l0_files") >= L0_STOP, "STOP").when(F.col("l0_files") >= L0_SLOWDOWN, "DELAY").otherwise("GO"))


def trivial_moves(files: DataFrame, most_grandparents: int) -> DataFrame:
    """Files that may move down unchanged: nothing overlaps one level down, and not too many bytes two levels down."""
    alone = files.where("level >= 1").join(overlap_bytes(files, 1), ["level", "file_no"], "left_anti")
    return alone.join(overlap_bytes(files, 2), ["level", "file_no"], "left").where(F.coalesce("bytes", F.lit(0)) <= most_grandparents).select("level", "file_no")


def seek_candidates(files: DataFrame, misses: DataFrame) -> DataFrame:
    """Files whose first misses (file_no) have used up their allowance of seeks."""
    n = misses.groupBy("file_no").agg(F.count(F.lit(1)).alias("misses"))
    return files.join(n, "file_no").where("misses >= allowed_seeks").select("level", "file_no", "misses")


def split_by_size(rows: DataFrame, key: str, order: str, size: str, most: int, overlap: str | None = None, most_overlap: int = 0) -> DataFrame:
    """Outputs of one compaction: a new file once `most` bytes are full, or once the bytes of grandparents met since the file
    began (column `overlap`) pass most_overlap. A fold with reset, in order, per compaction (column key)."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        out, n, full, met = [], 0, 0, 0
        for i in range(len(pdf)):
            s = int(pdf[size].iloc[i])
            met += int(pdf[overlap].iloc[i]) if overlap else 0
            if full and (full >= most or (overlap and met > most_overlap)):
                n, full, met = n + 1, 0, 0
            full += s
            out.append(n)
        return pdf.assign(output=pd.Series(out, dtype="int64"))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(key).applyInPandas(fold, f"{shape}, output long")


def grandparent_bytes(rows: DataFrame, grandparents: DataFrame, key: str, order: str) -> DataFrame:
    """rows with `overlap`: the bytes of the grandparents (key, largest_key, file_size) that lie wholly before the row's key
    and not before the previous row's, which is what a compaction's walk adds at this row, the first row adding none. Both
    sides are put in one order by key, so that no row meets all files; split_by_size() cuts by the column."""
    ends = grandparents.select(key, F.col("largest_key").alias(order), F.col("file_size").alias("_bytes"), F.lit(0).alias("_side"))
    own = rows.withColumn("_bytes", F.lit(None).cast("long")).withColumn("_side", F.lit(1)).withColumn("_order", F.col(order))
    both = own.unionByName(ends.withColumn("_order", F.col(order)), allowMissingColumns=True)
    # a file ends before a row whose key is greater, not equal: rows come first at equal keys
    w = W.partitionBy(key).orderBy(F.col("_order"), F.desc("_side"))
    passed = both.withColumn("_passed", F.coalesce(F.sum("_bytes").over(w), F.lit(0))).where("_side = 1")
    before = F.lag("_passed").over(W.partitionBy(key).orderBy("_order"))
    return passed.withColumn("overlap", F.coalesce(F.col("_passed") - before, F.lit(0))).drop("_bytes", "_side", "_order", "_passed")


def promotion_due(buffers: DataFrame, most_keys: float, thresholds: tuple[int, ...] = (0, 0, 0, 0, 0, 1, 1)) -> DataFrame:
    """buffers (level, file_no, file_size, buffered, hotness) with `promote`: whether a file's hot keys are to be merged upward,
    because its buffer holds more than most_keys for each KB of the file, or it is hotter than its level's threshold."""
    limits = F.array(*[F.lit(t) for t in thresholds])
    hot = F.col("hotness") > F.get(limits, F.col("level").cast("int"))
    full = F.col("buffered") > most_keys * F.col("file_size") / 1024
    return buffers.withColumn("promote", full | F.coalesce(hot, F.lit(False)))


def hot_keys(reads: DataFrame, threshold: int = 1) -> DataFrame:
    """(user_key, reads): keys read more than threshold times."""
    return reads.groupBy("user_key").agg(F.count(F.lit(1)).alias("reads")).where(F.col("reads") > threshold)


def read_cache(reads: DataFrame, hot: int = 1) -> DataFrame:
    """reads (op_id, file_no, user_key) with the number of reads of the key in its file so far, and whether the hot buffer
    serves it: from the read after the one that made it hot."""
    so_far = F.row_number().over(W.partitionBy("file_no", "user_key").orderBy("op_id"))
    return reads.withColumn("nth", so_far).withColumn("served", F.col("nth") > hot + 1)


def reads_served(reads: DataFrame, hot: int = 1) -> DataFrame:
    """(file_no, user_key, reads, served): how many of a key's reads the hot buffer of its file serves: all after the one that
    made it hot. Counts are combined before the shuffle, so a very hot key sends one row a task."""
    n = reads.groupBy("file_no", "user_key").agg(F.count(F.lit(1)).alias("reads"))
    return n.withColumn("served", F.greatest(F.col("reads") - hot - 1, F.lit(0)))


def promote(inputs: DataFrame, hot: DataFrame) -> DataFrame:
    """A level's rewrite with hot rows from below: union, one row per (user_key, seq), key and value kept together."""
    return inputs.unionByName(hot).dropDuplicates(["user_key", "seq"])


def retain(inputs: DataFrame, hot: DataFrame) -> DataFrame:
    """inputs with the level each row is written to: hot keys stay in the upper level, the rest goes one down."""
    marked = inputs.join(hot.select("user_key").withColumn("_hot", F.lit(True)), "user_key", "left")
    return marked.withColumn("to_level", F.when(F.coalesce("_hot", F.lit(False)), F.col("level")).otherwise(F.col("level") + 1)).drop("_hot")


def reclaimable(nodes: DataFrame, readers: DataFrame) -> DataFrame:
    """Nodes (born, dead) that no reader (t) can still see."""
    oldest = readers.agg(F.min("t").alias("_t"))
    return nodes.join(F.broadcast(oldest)).where(F.col("_t").isNull() | (F.col("dead") < F.col("_t"))).drop("_t")


def pick(files: DataFrame, pointers: dict[int, object], seeks: DataFrame | None = None, base: int = BASE_BYTES) -> dict | None:
    """What to compact next: the level with the highest score of 1 or more, from the first file after its pointer, round
    robin; else a file that has used up its seeks. One row a level, then one file, reach the driver."""
    best = scores(files, base).where("score >= 1").orderBy(F.desc("score"), "level").first()
    if best:
        at = pointers.get(best["level"])
        own = files.where(F.col("level") == best["level"]).orderBy("smallest_key", "file_no")
        first = (own.where(F.col("largest_key") > F.lit(at)).first() if at is not None else None) or own.first()
        return {"reason": "size", "level": best["level"], "file_no": first["file_no"]}
    hit = seek_candidates(files, seeks).orderBy(F.desc("misses"), "file_no").first() if seeks is not None else None
    return {"reason": "seek", "level": hit["level"], "file_no": hit["file_no"]} if hit else None


def other_inputs(files: DataFrame, level: int, chosen: list[int], limit: int) -> tuple[list[int], list[int]]:
    """The inputs of a level and of the next: files below that the chosen meet, then more files of the level if these meet no
    more files below and all stay within `limit` bytes. Only file numbers and bounds reach the driver."""
    def met(lvl: int, low, high) -> list:
        return files.where((F.col("level") == lvl) & (F.col("largest_key") >= F.lit(low)) & (F.col("smallest_key") <= F.lit(high))).orderBy("smallest_key", "file_no").select("file_no", "file_size", "smallest_key", "largest_key").collect()

    def ends(nos: list[int], lvl: int):
        return files.where((F.col("level") == lvl) & F.col("file_no").isin(nos)).agg(F.min("smallest_key"), F.max("largest_key")).first()

    below = met(level + 1, *ends(chosen, level))
    bounds = [*ends(chosen, level)]
    for f in below:
        bounds = [min(bounds[0], f["smallest_key"]), max(bounds[1], f["largest_key"])]
    more = met(level, *bounds)
    if len(more) > len(chosen) and sum(f["file_size"] for f in [*more, *below]) < limit:
        wider = [f["file_no"] for f in more]
        again = met(level + 1, *ends(wider, level))
        if len(again) == len(below):
            return wider, [f["file_no"] for f in again]
    return sorted(chosen), [f["file_no"] for f in below]
