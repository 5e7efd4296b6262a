"""Histograms with fixed bounds, percentiles interpolated in their buckets, latency and hit counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Steps within a decade of the histogram's bounds; 154 bounds in all, the last one catches the rest.
_STEPS = (10, 12, 14, 16, 18, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90)
BOUNDS = [float(i) for i in range(1, 10)] + [float(s * 10**d) for d in range(9) for s in _STEPS] + [1e200]


def buckets(values: DataFrame, col: str = "v") -> DataFrame:
    """(bucket, n, total): values by the first bound above them; a value equal to a bound goes to the next bucket."""
    place = F.size(F.filter(F.array(*[F.lit(b) for b in BOUNDS[:-1]]), lambda b: b <= F.col(col)))
    return values.groupBy(place.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(col).alias("total"))


def merge(*histograms: DataFrame) -> DataFrame:
    out = histograms[0]
    for h in histograms[1:]:
        out = out.unionByName(h)
    return out.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def percentile(values: DataFrame, ps: list[float], col: str = "v") -> DataFrame:
    """(p, value): linear within the bucket that reaches p percent of the count, clamped to the least and greatest value."""
    spark = values.sparkSession
    low = F.element_at(F.array(F.lit(0.0), *[F.lit(b) for b in BOUNDS[:-1]]), F.col("bucket") + 1)
    high = F.element_at(F.array(*[F.lit(b) for b in BOUNDS]), F.col("bucket") + 1)
    # at most 154 rows
    h = buckets(values, col).select(F.sum("n").over(W.orderBy("bucket")).alias("upto"), "n", low.alias("low"), high.alias("high"))
    ends = values.agg(F.count(F.lit(1)).alias("all"), F.min(col).alias("least"), F.max(col).alias("most"))
    asked = spark.createDataFrame([(float(p),) for p in ps], "p double")
    met = asked.join(F.broadcast(ends)).withColumn("need", F.col("all") * F.col("p") / 100).join(F.broadcast(h), F.col("upto") >= F.col("need"))
    best = met.groupBy("p", "need", "least", "most").agg(F.min_by(F.struct("low", "high", "upto", "n"), "upto").alias("b"))
    inside = F.col("b.low") + (F.col("b.high") - F.col("b.low")) * (F.col("need") - (F.col("b.upto") - F.col("b.n"))) / F.col("b.n")
    return best.select("p", F.greatest("least", F.least("most", inside)).alias("value"))


def summary(values: DataFrame, col: str = "v") -> DataFrame:
    return values.agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("least"), F.max(col).alias("most"), F.avg(col).alias("average"), F.stddev_pop(col).alias("deviation"))


def lines(values: DataFrame, col: str = "v") -> DataFrame:
    """A row per bucket with its percentage, the running percentage and a bar of up to 20 marks."""
    h, w = buckets(values, col), W.orderBy("bucket")
    total = F.sum("n").over(W.partitionBy())
    share = 100.0 * F.col("n") / total
    return h.select("bucket", "n", share.alias("share"), (100.0 * F.sum("n").over(w) / total).alias("upto"), F.expr("repeat('#', cast(20.0 * n / sum(n) over () + 0.5 as int))").alias("bar"))


def latency(ops: DataFrame) -> DataFrame:
    """Per operation: count, least, most and average microseconds of latency_ns."""
    us = F.col("latency_ns") / 1000.0
    return ops.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.min(us).alias("min_us"), F.max(us).alias("max_us"), F.avg(us).alias("avg_us"))


def report(ops: DataFrame) -> DataFrame:
    """(op, n, micros_per_op, mb_per_s) over operations (op, thread, start_us, finish_us, bytes) of any number of threads: time
    per operation by the threads' own seconds, throughput by the time from the first start to the last finish."""
    spent = F.sum(F.col("finish_us") - F.col("start_us"))
    wall = (F.max("finish_us") - F.min("start_us")) / 1e6
    rate = F.when(wall > 0, F.sum("bytes") / 1048576.0 / wall)
    return ops.groupBy("op").agg(F.count(F.lit(1)).alias("n"), (spent / F.count(F.lit(1))).alias("micros_per_op"), rate.alias("mb_per_s"))


def entry_bytes(rows: DataFrame) -> DataFrame:
    """(bytes) that the entries of rows (user_key, value) take in a memory table: the key with its eight-byte tag and the
    value, each after its length as a variable-length integer. A deletion marker has an empty value."""
    key, value = F.octet_length("user_key") + 8, F.coalesce(F.octet_length("value"), F.lit(0))
    size = lambda n: F.when(n < 128, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5)
    return rows.agg(F.coalesce(F.sum(size(key) + key + size(value) + value), F.lit(0)).cast("long").alias("bytes"))


def hits_by_level(state: DataFrame, keys: DataFrame) -> DataFrame:
    """Which level answered each looked-up key."""
    return keys.join(state.select("user_key", "level"), "user_key").groupBy("level").agg(F.count(F.lit(1)).alias("hits"))
