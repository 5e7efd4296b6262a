"""Helpers that the operators share: tables in the cluster's shared folder, distributed ranks, connected components."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


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


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def global_rank(df: DataFrame, order: list, tag: str, name: str = "rank") -> DataFrame:
    """Each row's rank from 0 in the total order, by range partitions and one offset a partition: no window over all rows."""
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), tag)
    placed_p = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = placed_p.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row a partition: the window and the broadcast are bounded by the number of partitions
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = placed_p.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_before")
    out._stored_at = placed._stored_at
    return out


#: A class with more than this share of all rows is hot; there are fewer of them than its inverse.
HOT_SHARE = 1000


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: Column, total: int, take: list[str]) -> DataFrame:
    """rows left-joined with classes (one row a key, with `size` rows each) on keys, which may be null, adding `take`.

    Classes that hold more than a thousandth of all rows, of which there are less than a thousand, go to every task; the rest
    are joined by shuffle, where no key has more rows than that. So no task gathers a hot class."""
    hot = size * HOT_SHARE > F.lit(total)
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    side = classes.select(*[F.col(k).alias(n) for k, n in names.items()], *take, hot.alias("_hot"))
    met = lambda right: functools.reduce(lambda a, b: a & b, [rows[k].eqNullSafe(right[n]) for k, n in names.items()])
    drop = [*names.values(), "_hot"]
    if side.where("_hot").isEmpty():
        return rows.join(side, met(side), "left").drop(*drop)
    few, rest = F.broadcast(side.where("_hot")), side.where("not _hot")
    cold = rows.join(few, met(few), "left_anti")
    return rows.join(few, met(few)).drop(*drop).unionByName(cold.join(rest, met(rest), "left").drop(*drop))


def connected_components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, component) for all nodes of edges (a, b): the smallest node reachable.

    Alternating large and small stars; every step is a minimum by node (combined before the shuffle) and an equi-join that
    adaptive execution may split, so a hub with very many neighbours never has to fit in one task.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(low, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-cc")
    seen = mark(cur)
    while True:
        wide = star(cur, True).where("a <> b").distinct()
        nxt = materialize(star(wide, False).where("a <> b").distinct(), f"{tag}-cc")
        now = mark(nxt)
        release(cur)
        cur = nxt
        if now == seen:
            break
        seen = now
    # converged: every edge leads from a node to its component's smallest node
    nodes = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())
    out._stored_at = cur._stored_at
    return out


def whole_groups(batches, key: str):
    """Regroup pandas batches of rows that are contiguous by key into frames that hold each key whole."""
    import numpy as np
    import pandas as pd

    carry = None
    for pdf in batches:
        if carry is not None:
            pdf = pd.concat([carry, pdf], ignore_index=True)
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        other = np.flatnonzero(k != k[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
        carry = pdf.iloc[cut:]
    if carry is not None and len(carry):
        yield carry.reset_index(drop=True)


def pairs_within(key):
    """All pairs of places with equal keys, equal keys being contiguous, in arrays (i, i + d) for d = 1, 2, ..."""
    import numpy as np

    i, d = np.arange(len(key)), 0
    while True:
        d += 1
        i = i[i + d < len(key)]
        i = i[key[i + d] == key[i]]
        if not len(i):
            return
        yield i, i + d


def block_pairs(df: DataFrame, key: list[str], row_id: str, limit: int, tag: str, main: Column | None = None) -> DataFrame:
    """Adds `pair`, a hash of the key and of two blocks of it, so that all rows of a key meet pair by pair in groups of about
    twice `limit` rows at most: a key with m rows has ceil(m / limit) blocks and each row goes to every pair that has its block.
    Also adds `block` and the pair's `bi` <= `bj`.

    With `main`, rows of a key of more than `limit` rows for which it is true need not meet each other, as they are known to
    belong together: they have blocks of their own, below zero, which only the other rows' blocks meet. If all rows of such a
    key are main rows, none is left."""
    main = F.lit(False) if main is None else F.coalesce(main, F.lit(False))
    df = df.withColumn("_main", main)
    parts = lambda here: F.ceil(F.sum(here.cast("long")) / limit).cast("int")
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_m"), parts(F.col("_main")).alias("_ml"), parts(~F.col("_main")).alias("_nb")).where(F.col("_m") > limit)
    out = df.join(sizes.drop("_m"), key, "left").withColumn("_nb", F.coalesce("_nb", F.lit(1))).withColumn("_main", F.col("_main") & F.col("_ml").isNotNull()).withColumn("_ml", F.coalesce("_ml", F.lit(0)))
    at = lambda n: F.pmod(F.xxhash64(row_id), F.greatest(n, F.lit(1))).cast("int")
    out = out.withColumn("block", F.when(F.col("_main"), -1 - at(F.col("_ml"))).otherwise(at(F.col("_nb"))))
    first = F.when(F.col("_main"), F.lit(0)).otherwise(-F.col("_ml"))
    out = out.where("_nb > 0").withColumn("_other", F.explode(F.sequence(first, F.col("_nb") - 1)))
    return out.withColumn("bi", F.least("block", "_other")).withColumn("bj", F.greatest("block", "_other")).withColumn("pair", F.xxhash64(*key, "bi", "bj")).drop("_nb", "_ml", "_main", "_other")
