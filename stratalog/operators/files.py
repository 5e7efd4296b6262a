"""File metadata: pruning by key ranges, sizes, versions as folds of edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import at_or_after, overlap_pairs


def overlaps(low, high, start, limit):
    """Whether [low, high] meets [start, limit], null bounds being open."""
    return (start.isNull() | (high >= start)) & (limit.isNull() | (low <= limit))


def overlapping(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, level, file_no) of the files that meet each range (range_id, start, limit)."""
    met = overlap_pairs(files.select("level", "file_no", "smallest_key", "largest_key"), ranges.select("range_id", "start", "limit"))
    return met.select("r.range_id", "f.level", "f.file_no")


def find_file(files: DataFrame, keys: DataFrame) -> DataFrame:
    """(user_key, file_no): of sorted, disjoint files the first whose largest key is at or after the key; null past the end.
    Files and keys are put in one order, so that no key meets all files."""
    marks = files.select(F.col("largest_key").alias("at"), F.struct("largest_key", "file_no").alias("row"))
    hit = at_or_after(keys.select(F.col("user_key").alias("at")).distinct(), marks, "find-file")
    return hit.select(F.col("at").alias("user_key"), "hit.file_no")


def expand_overlapping(files: DataFrame, start, limit, level: int = 0) -> DataFrame:
    """Files of a level whose files may overlap, meeting a range that grows with each file found, to a fixed point. The loop
    keeps two numbers on the driver."""
    own = files.where(F.col("level") == level)
    while True:
        hit = own.where(overlaps(F.col("smallest_key"), F.col("largest_key"), F.lit(start), F.lit(limit)))
        low, high = hit.agg(F.min("smallest_key"), F.max("largest_key")).first()
        if low is None or (low >= start and high <= limit):
            return hit
        start, limit = min(start, low), max(limit, high)


def boundary_inputs(files: DataFrame, chosen: list[int], level: int = 1) -> list[int]:
    """chosen and the files that must come with them: whose smallest entry has the user key of the chosen files' largest
    entry and is older, again and again. One row a step reaches the driver."""
    own, out = files.where(F.col("level") == level), list(chosen)
    while True:
        last = own.where(F.col("file_no").isin(out)).orderBy(F.desc("largest_key"), F.asc("largest_seq")).select("largest_key", "largest_seq").first()
        more = last and own.where((F.col("smallest_key") == last[0]) & (F.col("smallest_seq") < last[1]) & ~F.col("file_no").isin(out)).orderBy(F.desc("smallest_seq")).select("file_no").first()
        if not more:
            return out
        out.append(more[0])


def approximate_sizes(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, bytes) within [start, limit): whole files count in full, files cut by a bound by the share of their key span.
    A range without a bound has no bytes."""
    low, high, start, limit = F.col("f.smallest_key"), F.col("f.largest_key"), F.col("r.start"), F.col("r.limit")
    part = F.least(limit, high + 1) - F.greatest(start, low)
    size = F.floor(F.col("f.file_size") * F.greatest(part, F.lit(0)) / F.greatest(high - low + 1, F.lit(1)))
    bounded = ranges.select("range_id", "start", "limit").where("start is not null and limit is not null")
    met = overlap_pairs(files.select("file_size", "smallest_key", "largest_key"), bounded).groupBy("r.range_id").agg(F.sum(size).alias("bytes"))
    return ranges.select("range_id").distinct().join(met, "range_id", "left").select("range_id", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count(F.lit(1)).alias("n_files"), (F.sum("file_size") / 1048576.0).alias("mb"))


def tier_sizes(files: DataFrame) -> DataFrame:
    """Bytes by tier; a file that is in both counts in each."""
    on = lambda t: F.coalesce(F.sum(F.when(F.col("tier").isin(t, "BOTH"), F.col("file_size"))), F.lit(0)).cast("long")
    return files.agg(on("SSD").alias("ssd_bytes"), on("NVM").alias("nvm_bytes"))


def listing(files: DataFrame) -> DataFrame:
    """A line per level with its files by smallest key."""
    entry = F.format_string("%d:%d[%d..%d]", "file_no", "file_size", "smallest_key", "largest_key")
    rows = files.groupBy("level").agg(F.array_sort(F.collect_list(F.struct("smallest_key", "file_no", entry.alias("entry")))).alias("rows"))
    return rows.select("level", F.array_join(F.transform("rows", lambda r: r["entry"]), " ").alias("files"))


def overlap_bytes(files: DataFrame, depth: int) -> DataFrame:
    """(level, file_no, bytes, met) of the files that meet some file `depth` levels down: these files' bytes and number."""
    own = files.select("level", "file_no", F.col("smallest_key").alias("start"), F.col("largest_key").alias("limit"))
    below = files.select((F.col("level") - depth).alias("level"), "smallest_key", "largest_key", "file_size")
    return overlap_pairs(below, own, "level").groupBy("r.level", "r.file_no").agg(F.sum("f.file_size").alias("bytes"), F.count(F.lit(1)).alias("met"))


def next_level_overlap(files: DataFrame) -> DataFrame:
    """For each file at level 1 or deeper, the bytes of the files one level down that its range meets; 0 if there are none."""
    met = overlap_bytes(files.where("level >= 1"), 1)
    return files.where("level >= 1").select("level", "file_no").join(met, ["level", "file_no"], "left").select("level", "file_no", F.coalesce("bytes", F.lit(0)).cast("long").alias("overlap_bytes"))


def fold_edits(edits: DataFrame) -> DataFrame:
    """The live files after all edits (edit_no, kind, level, file_no, file_size): the last edit of a file decides."""
    last = F.max_by(F.struct("kind", "file_size"), "edit_no").alias("e")
    return edits.groupBy("level", "file_no").agg(last).where("e.kind = 'add'").select("level", "file_no", "e.file_size")


def live_files(versions: list[DataFrame]) -> DataFrame:
    out = versions[0].select("level", "file_no")
    for v in versions[1:]:
        out = out.union(v.select("level", "file_no"))
    return out.distinct()


def without(left: DataFrame, right: DataFrame) -> DataFrame:
    """Expected but not found, or on disk but not live: left's files that right does not have."""
    return left.join(right.select("file_no").distinct(), "file_no", "left_anti")


def evict_oldest(files: DataFrame, need: int) -> DataFrame:
    """The fast tier's files that make `need` bytes of room, oldest installed first. The running sum is over file metadata."""
    from pyspark.sql import Window as W

    before = F.sum("file_size").over(W.orderBy("installed_at", "file_no").rowsBetween(W.unboundedPreceding, -1))
    return files.where("tier = 'NVM'").withColumn("freed_before", F.coalesce(before, F.lit(0))).where(F.col("freed_before") < need)


def rebuild(log: DataFrame) -> DataFrame:
    """Repair: metadata of all files rebuilt from their rows, all at level 0."""
    from ..sources.logs import file_metadata

    return file_metadata(log.withColumn("level", F.lit(0)))


def recover(edits: DataFrame) -> DataFrame:
    """The counters after all edits (comparator, log_number, next_file, last_seq may be null in an edit), and what is wrong:
    a comparator that is not the bytewise one, or a counter that no edit has."""
    last = edits.agg(F.max("comparator").alias("comparator"), F.max_by("log_number", F.when(F.col("log_number").isNotNull(), F.col("edit_no"))).alias("log_number"), F.max("next_file").alias("next_file"), F.max("last_seq").alias("last_seq"))
    wrong = F.when(F.col("comparator") != "bytewise", "INVALID_ARGUMENT").when(F.col("next_file").isNull() | F.col("log_number").isNull() | F.col("last_seq").isNull(), "CORRUPTION").otherwise("OK")
    return last.withColumn("status", wrong)


def as_one_edit(live: DataFrame) -> DataFrame:
    """The whole state as additions of one edit."""
    return live.select(F.lit(0).cast("long").alias("edit_no"), F.lit("add").alias("kind"), "level", "file_no", "file_size")
