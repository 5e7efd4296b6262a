"""Running aggregates in one total order, and joins of intervals by them, without a task that sees all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
#: Matches that one row expands to at a time.
STEP = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset in a local session, as in tests. On
    a cluster without it this is an error, as no folder of one machine can serve the others."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="stratalog-")
    return _OWN_DIR[app]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratalog/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def sweep(rows: DataFrame, order: list, folds: dict[str, tuple[str, Column]], tag: str) -> DataFrame:
    """rows with, for each fold (sum, min or max of a column), its value over all rows up to and with this one in the order.

    Rows go to range partitions, written once so that later reads see the same ones. Each partition folds its own rows, and
    takes what the partitions before it come to from a table of one row a partition, which alone is broadcast.
    """
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
    placed = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), tag)
    fold = {n: (getattr(F, how), join[how], c) for n, (how, c) in folds.items()}
    before, upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = placed.groupBy("_part").agg(*[f(c).alias(n) for n, (f, _, c) in fold.items()])
    carried = totals.select("_part", *[f(n).over(before).alias(f"_c_{n}") for n, (f, _, _) in fold.items()])
    out = placed.join(F.broadcast(carried), "_part")
    return out.select(*rows.columns, *[j(f(c).over(upto), F.col(f"_c_{n}")).alias(n) for n, (f, j, c) in fold.items()])


def at_or_after(points: DataFrame, marks: DataFrame, tag: str, strict: bool = False) -> DataFrame:
    """points (at) with `hit`, the least row of marks (at, row: a struct that begins with at) at or after each point, or null;
    strictly after it, if so asked."""
    both = points.select("at", F.lit(None).cast(marks.schema["row"].dataType).alias("row"), F.lit(0 if strict else 2).alias("_tie")).unionByName(marks.select("at", "row", F.lit(1).alias("_tie")))
    return sweep(both, [F.desc("at"), F.asc("_tie")], {"hit": ("min", F.col("row"))}, tag).where("_tie <> 1").select("at", "hit")


def _expand(rows: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """A row for each number after low up to high, in steps, so that no array grows with the matches of one row."""
    steps = rows.where(F.col(low) < F.col(high)).withColumn("_at", F.explode(F.sequence(F.col(low) + 1, F.col(high), F.lit(STEP).cast("long"))))
    return steps.withColumn(name, F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + STEP - 1, F.col(high))))).drop("_at")


def overlap_pairs(files: DataFrame, ranges: DataFrame, by: str | None = None) -> DataFrame:
    """(f, r), rows as structs, for each file [smallest_key, largest_key] that meets a range [start, limit], null bounds of
    ranges being open; with `by`, only where both have the same value in that column.

    Either the file begins within the range or the range begins within the file. So all bounds are put in one order and
    counted: a range's files are then a stretch of the files by their beginning, a file's ranges a stretch of the ranges by
    theirs, and equi-joins on these places give every pair once. Work grows with bounds and matches, not with their product.
    Repeated rows pair each.
    """
    group = lambda side: F.col(f"{side}.{by}") if by else F.lit(0)

    def bounds(df: DataFrame, side: str, first: str, last: str, tie: int) -> DataFrame:
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(side)).withColumn("_id", F.monotonically_increasing_id())
        one = lambda c, t: F.struct(F.col(f"{side}.{c}").alias("_at"), F.lit(t).alias("_tie"))
        rows = rows.select(side, "_id", group(side).alias("_by"), F.explode(F.array(one(first, tie), one(last, 2))).alias("_e"))
        return rows.select(side, "_id", "_by", "_e.*", (F.col("_e._tie").eqNullSafe(2) & F.col("_e._at").isNull()).alias("_open"))

    # at equal keys ranges begin, then files begin, then either ends
    both = bounds(files, "f", "smallest_key", "largest_key", 1).unionByName(bounds(ranges, "r", "start", "limit", 0), allowMissingColumns=True)
    count = lambda t: ("sum", F.when(F.col("_tie") == t, 1).otherwise(0))
    placed = sweep(both, ["_by", "_open", "_at", "_tie", "_id"], {"_files": count(1), "_ranges": count(0)}, "overlap")

    def spans(side: str, tie: int, own: str, other: str, place: str) -> DataFrame:
        at = lambda t, c: F.max(F.when(F.col("_tie") == t, F.col(c)))
        rows = placed.where(F.col(side).isNotNull()).groupBy("_id")
        return rows.agg(F.first(side).alias(side), at(tie, own).alias(place), at(tie, other).alias("_low"), at(2, other).alias("_high")).drop("_id")

    f, r = spans("f", 1, "_files", "_ranges", "_fp"), spans("r", 0, "_ranges", "_files", "_rp")
    begun = _expand(r.select("_rp", "_low", "_high"), "_low", "_high", "_fp").select("_fp", "_rp")
    within = _expand(f.select("_fp", "_low", "_high"), "_low", "_high", "_rp").select("_fp", "_rp")
    met = begun.unionByName(within).join(f.select("f", "_fp"), "_fp").join(r.select("r", "_rp"), "_rp").select("f", "r")
    low, high = F.col("f.smallest_key"), F.col("f.largest_key")
    # bounds in the wrong order may bring pairs that do not meet
    return met.where((F.col("r.start").isNull() | (high >= F.col("r.start"))) & (F.col("r.limit").isNull() | (low <= F.col("r.limit"))))
