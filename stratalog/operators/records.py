"""Records of named fields over keys, and the workloads that read and write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Workload mixes (read, update, insert, scan, read-modify-write) and the skew of the key chooser.
MIXES = {
    "a": {"read": 0.5, "update": 0.5},
    "b": {"read": 0.95, "update": 0.05},
    "c": {"read": 1.0},
    "d": {"read": 0.95, "insert": 0.05},
    "e": {"scan": 0.95, "insert": 0.05},
    "f": {"read": 0.5, "rmw": 0.5},
}
THETA = 0.99
SCRAMBLED_ITEMS, SCRAMBLED_ZETA = 10_000_000_000, 26.46902820178302


def rows_to_records(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Row-major: (key, field, value) to one row a key."""
    return rows.groupBy("key").pivot("field", fields).agg(F.first("value"))


def rows_to_columns(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Column-major: one row a field with the values of the given keys."""
    return rows.groupBy("field").pivot("key", keys).agg(F.first("value"))


def field_columns(rows: DataFrame, records: int = 4096) -> DataFrame:
    """Column-major over all keys: (field, part, first_key, values) with each field's values in key order, in parts of about
    `records` keys by range, so that no row grows with the table. part is in key order too; a missing value is left out."""
    placed = rows.repartitionByRange("key").withColumn("part", F.spark_partition_id())
    placed = placed.withColumn("part", F.struct(F.col("part"), F.floor(F.dense_rank().over(W.partitionBy("part").orderBy("key")) / records).alias("at")))
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    gathered = placed.where("value is not null").groupBy("field", "part").agg(F.min("key").alias("first_key"), pairs.alias("_p"))
    return gathered.select("field", "part", "first_key", F.transform("_p", lambda p: p["value"]).alias("values"))


def project(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.where(F.col("field").isin(fields))


def scan_records(rows: DataFrame, start: str, n: int) -> DataFrame:
    """All fields of the first n records from start on; the keys are found first, by a top-n."""
    keys = rows.where(F.col("key") >= start).select("key").distinct().orderBy("key").limit(n)
    return rows.join(keys, "key", "left_semi")


def delete_record(rows: DataFrame, key: str) -> DataFrame:
    """One deletion marker per field of the record."""
    return rows.where(F.col("key") == key).select(F.concat_ws(":", "key", "field").alias("user_key"), F.lit(0).alias("vtype"))


def choose(u: Column, mix: dict[str, float]) -> Column:
    """The operation that u in [0, 1) falls on, by cumulative weights."""
    total, at, out = sum(mix.values()), 0.0, None
    names = list(mix)
    for name in names[:-1]:
        at += mix[name] / total
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def zeta(n: int, theta: float = THETA) -> float:
    return float(sum(1.0 / i**theta for i in range(1, n + 1)))


def zipf_rank(u: Column, n: int, zeta_n: float | None = None, theta: float = THETA) -> Column:
    """The rank in [0, n) that u in [0, 1) gives under a Zipf law, in closed form."""
    z = zeta(n, theta) if zeta_n is None else zeta_n
    eta = (1 - (2.0 / n) ** (1 - theta)) / (1 - zeta(2, theta) / z)
    uz = u * z
    return F.when(uz < 1, 0).when(uz < 1 + 0.5**theta, 1).otherwise(F.floor(n * F.pow(eta * u - eta + 1, F.lit(1 / (1 - theta))))).cast("long")


def scrambled(u: Column, n: int) -> Column:
    """Zipf ranks spread over [0, n) by a hash, read as unsigned."""
    from ..functions.scalar import fnv64_of, unsigned

    rank = zipf_rank(u, SCRAMBLED_ITEMS, SCRAMBLED_ZETA)
    return F.transform(F.array(rank), lambda r: F.pmod(unsigned(fnv64_of(r)), F.lit(n).cast("decimal(20,0)")))[0]


def uniform(u: Column, low: int, high: int) -> Column:
    """An integer in [low, high] that u in [0, 1) gives."""
    return (F.lit(low) + F.floor(u * (high - low + 1))).cast("long")


def counter(at: Column, start: int = 0) -> Column:
    """Consecutive numbers from start, at being a row's place from 0."""
    return (F.lit(start) + at).cast("long")


def random_bytes(ident: Column, size: int, seed: int = 0) -> Column:
    """`size` printable characters that follow from an id: digests of it and of a block number, end to end."""
    blocks = [F.sha2(F.concat_ws(":", ident.cast("string"), F.lit(f"{seed}:{i}")), 256) for i in range(-(-size // 64))]
    return F.substring(F.concat(*blocks), 1, size) if blocks else F.lit("")


def resampled(draws: DataFrame, last_ack: DataFrame) -> DataFrame:
    """(op_id, key): the first of an operation's draws (op_id, draw_no, key) whose key has been inserted, that is at or below
    the last acknowledged one (last_ack, one row); null if none of them is."""
    seen = draws.join(F.broadcast(last_ack)).withColumn("_ok", F.when(F.col("key") <= F.col("last_ack"), F.col("draw_no")))
    return seen.groupBy("op_id").agg(F.min_by("key", "_ok").alias("key"))


def skewed_latest(u: Column, last: int) -> Column:
    return F.lit(last) - zipf_rank(u, last + 1)


def acknowledged(ids: DataFrame, first: int = 0) -> DataFrame:
    """(last_ack): the end of the run of acknowledged ids that starts at `first`; first - 1 if it is not there.

    An id closes the run if the next is not there: a self-join on id + 1, and the least such id from first on."""
    have = ids.select("id").distinct()
    nxt = have.select((F.col("id") - 1).alias("id"))
    ends = have.join(nxt, "id", "left_anti").where(F.col("id") >= first).agg(F.min("id").alias("last_end"))
    starts = have.agg(F.max(F.col("id") == first).alias("begun"))
    return ends.join(F.broadcast(starts)).select(F.when(F.coalesce("begun", F.lit(False)), F.col("last_end")).otherwise(F.lit(first - 1)).alias("last_ack"))


def echo(ops: DataFrame) -> DataFrame:
    """The line that a store without storage prints for each operation."""
    return ops.select("op_id", F.concat_ws(" ", F.upper("op"), F.lit("usertable"), "key").alias("line"))


def settings(*layers: dict[str, str]) -> dict[str, str]:
    """Settings of several layers, later ones overriding earlier."""
    out: dict[str, str] = {}
    for layer in layers:
        out |= layer
    return out


def first_reads(ops: DataFrame) -> DataFrame:
    """The first operation on each key."""
    rest = [c for c in ops.columns if c != "key"]
    return ops.groupBy("key").agg(F.min_by(F.struct(*rest), "op_id").alias("_o")).select("key", "_o.*").select(*ops.columns)


def fill(spark, n: int, kind: str, entries: int = 1, seed: int = 301) -> DataFrame:
    """Put batches (batch_id, op_idx, id): fillseq and fillbatch in order, fillrandom and overwrite over [0, n) by hash,
    hotwrite over the first hundredth of the keys. entries: operations in a batch (1000 for fillbatch)."""
    i = F.col("id")
    drawn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    key = {"fillseq": i, "fillbatch": i, "fillrandom": drawn, "overwrite": drawn, "hotwrite": F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, (n + 99) // 100)))}[kind]
    return spark.range(n).select(F.floor(i / entries).alias("batch_id"), (i % entries).cast("int").alias("op_idx"), key.alias("id"))
