"""Ordered scans, seeks and ranges over live state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import at_or_after
from .resolve import live


def forward(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return live(log, snapshot).orderBy("user_key")


def by_comparator(log: DataFrame, sort_key, snapshot: int | None = None) -> DataFrame:
    """Live state in a caller's order: sort_key, a function of the key column, gives what is compared; keys that compare
    equal are one key, whose newest version counts, as a comparator that calls them equal would have it."""
    from .resolve import visible

    rest = [c for c in log.columns]
    newest = visible(log, snapshot).groupBy(sort_key(F.col("user_key")).alias("_by")).agg(F.max_by(F.struct(*rest), F.struct("seq", "vtype")).alias("_v"))
    return newest.where("_v.vtype = 1").orderBy("_by").select("_v.*")


def reverse(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return live(log, snapshot).orderBy(F.desc("user_key"))


def seek(log: DataFrame, target, snapshot: int | None = None) -> DataFrame:
    """The first live key at or after target; the range reaches the scan below the resolution."""
    return live(log.where(F.col("user_key") >= target), snapshot).orderBy("user_key").limit(1)


def scan(log: DataFrame, start, n: int, snapshot: int | None = None) -> DataFrame:
    return live(log.where(F.col("user_key") >= start), snapshot).orderBy("user_key").limit(n)


def half_open(log: DataFrame, start, limit, snapshot: int | None = None) -> DataFrame:
    return live(log.where((F.col("user_key") >= start) & (F.col("user_key") < limit)), snapshot)


def ends(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return live(log, snapshot).agg(F.min("user_key").alias("first_key"), F.max("user_key").alias("last_key"))


def seek_many(probes: DataFrame, log: DataFrame, width: int) -> DataFrame:
    """(probe_id, target, found): the first live key at or after each probe's target, keys being integers.

    Keys are summed up by ranges of `width`: a probe looks in its own range, and else takes the smallest key of the next
    range that has one. Both are equi-joins; no probe meets all keys.
    """
    keys = live(log).select("user_key", F.floor(F.col("user_key") / width).alias("cell"))
    cells = keys.groupBy("cell").agg(F.min("user_key").alias("low"))
    # the first key after a cell is the smallest of the next cell that has one
    wanted = probes.select(F.floor(F.col("target") / width).alias("at")).distinct()
    after = at_or_after(wanted, cells.select(F.col("cell").alias("at"), F.struct("cell", "low").alias("row")), "seek", strict=True)
    after = after.select(F.col("at").alias("cell"), F.col("hit.low").alias("next"))
    p = probes.withColumn("cell", F.floor(F.col("target") / width))
    own = p.join(keys, "cell").where("user_key >= target").groupBy("probe_id").agg(F.min("user_key").alias("own"))
    return p.join(own, "probe_id", "left").join(after, "cell", "left").select("probe_id", "target", F.coalesce("own", "next").alias("found"))


def range_sorted(df: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Parallel sample sort: sampled boundaries, range partitions, a sort in each."""
    placed = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return placed.sortWithinPartitions(*keys)
