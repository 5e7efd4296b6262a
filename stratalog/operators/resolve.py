"""Newest-visible-version resolution. Key predicates may go before it; predicates on value or vtype must come after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return log if snapshot is None else log.where(F.col("seq") <= snapshot)


def newest_by_rank(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest visible version of each key, deletion markers included; at equal seq a value beats a deletion."""
    order = W.partitionBy("user_key").orderBy(F.desc("seq"), F.desc("vtype"))
    return visible(log, snapshot).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def newest_by_max(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The same by aggregation, which combines before the shuffle: a key with very many versions sends one row a task."""
    rest = [c for c in log.columns if c != "user_key"]
    top = F.max_by(F.struct(*rest), F.struct("seq", "vtype")).alias("_v")
    return visible(log, snapshot).groupBy("user_key").agg(top).select("user_key", "_v.*")


def newest_by_level(log: DataFrame) -> DataFrame:
    """The version that the source with priority holds: lower level, then newer file, then higher seq."""
    rest = [c for c in log.columns if c != "user_key"]
    top = F.min_by(F.struct(*rest), F.struct("level", -F.col("file_no"), -F.col("seq"), -F.col("vtype"))).alias("_v")
    return log.groupBy("user_key").agg(top).select("user_key", "_v.*")


def live(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Live keys and values as of a snapshot."""
    return newest_by_max(log, snapshot).where("vtype = 1")


#: Snapshots that one pass over a log answers, and how many of them a version is compared with at a time.
SNAPSHOTS, RUN = 4096, 64


def at_snapshots(log: DataFrame, snapshots: DataFrame, most: int = SNAPSHOTS) -> DataFrame:
    """(snap_id, user_key, value): the live state at each of many snapshots (snap_id, seq).

    Up to `most` snapshots become one sorted array, which is all that is broadcast; more are dealt, in order, to passes of that
    many. Each version falls between two of them, found in a run of RUN snapshots after a search among the runs' ends, and of a
    key's versions in one gap only the newest counts: an aggregation that combines before the shuffle, so a hot key leaves one
    row a gap. A row then holds from its gap to the key's next one.
    """
    # as many bounds reach the driver as there are passes
    n = snapshots.count()
    cuts = []
    if n > most:
        shares = [i / -(-n // most) for i in range(1, -(-n // most))]
        cuts = sorted(set(snapshots.agg(F.percentile("seq", F.array(*map(F.lit, shares)))).first()[0]))
    out = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        own = snapshots
        if low is not None:
            own = own.where(F.col("seq") > low)
        if high is not None:
            own = own.where(F.col("seq") <= high)
        part = _at_array(log, own)
        out = part if out is None else out.unionByName(part)
    return out


def _at_array(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    sorted_ = F.array_sort(F.collect_list(F.struct("seq", "snap_id")))
    order = snapshots.agg(sorted_.alias("_s"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_s") - 1) / RUN)), lambda i: F.slice("_s", (i * RUN + 1).cast("int"), RUN)["seq"])
    order = order.where(F.size("_s") > 0).withColumn("_runs", runs)
    full = F.size(F.filter("_runs", lambda r: F.element_at(r, -1) < F.col("seq")))
    within = F.coalesce(F.size(F.filter(F.get("_runs", full), lambda s: s < F.col("seq"))), F.lit(0))
    gap = F.least(full * RUN, F.size("_s")) + F.greatest(within, F.lit(0))
    placed = log.join(F.broadcast(order)).withColumn("_gap", gap)
    newest = placed.groupBy("user_key", "_gap").agg(F.max_by(F.struct("vtype", "value"), F.struct("seq", "vtype")).alias("_v"))
    until = F.lead("_gap").over(W.partitionBy("user_key").orderBy("_gap"))  # as many rows a key as there are snapshots, at most
    spans = newest.withColumn("_until", until).where("_v.vtype = 1").join(F.broadcast(order.select("_s")))
    seen = F.slice("_s", F.col("_gap") + 1, F.coalesce("_until", F.size("_s")) - F.col("_gap"))
    return spans.select("user_key", "_v.value", F.explode(seen).alias("_at")).select("_at.snap_id", "user_key", "value")


def lookup(keys: DataFrame, log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """keys with their value and status: FOUND, DELETED, or NOT_FOUND for a key that never existed."""
    state = newest_by_max(log, snapshot).select("user_key", "vtype", "value")
    status = F.when(F.col("vtype").isNull(), "NOT_FOUND").when(F.col("vtype") == 0, "DELETED").otherwise("FOUND")
    return keys.join(state, "user_key", "left").select(*keys.columns, F.when(F.col("vtype") == 1, F.col("value")).alias("value"), status.alias("status"))


def missing(keys: DataFrame, log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return keys.join(live(log, snapshot).select("user_key"), "user_key", "left_anti")


def alive_at(nodes: DataFrame, time: int) -> DataFrame:
    """Nodes (born, dead) that a reader at `time` sees."""
    return nodes.where(F.lit(time).between(F.col("born"), F.col("dead")))
