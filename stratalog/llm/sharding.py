"""Sharding by balanced label propagation, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_rank, join_classes, materialize, release


def _quotas(demand: dict, sizes: list[int], cap: int) -> dict:
    """How many rows may move from shard s to t: swaps first, then what is free in t. demand, sizes: at most shards squared numbers."""
    allowed, n = {}, len(sizes)
    for s in range(n):
        for t in range(n):
            if s != t and demand.get((s, t)):
                allowed[s, t] = min(demand[s, t], demand.get((t, s), 0))
    free = [cap - x for x in sizes]
    for t in range(n):
        want = {s: demand.get((s, t), 0) - allowed.get((s, t), 0) for s in range(n) if s != t}
        total = sum(want.values())
        if total > 0 and free[t] > 0:
            for s, x in want.items():
                if x:
                    allowed[s, t] = allowed.get((s, t), 0) + x * min(1.0, free[t] / total)
    return {k: x for k, x in allowed.items() if x > 0}


def balanced_label_propagation(votes: DataFrame, total: int, n_shards: int, rounds: int = 6, slack: float = 1.25) -> DataFrame:
    """Where the members of each link go: (link, shard, n), members with one link being alike.

    votes (link, shard, n) counts the members of every link by the shard they start in; total counts all rows, those that
    nothing links too, which give way later. In each round the fullest shard of a link is its target: a join tells every
    (link, shard) its target, and its members move there as far as the quota between the two shards allows, whole links by
    chance, those larger than the quota in part. A round works on these counts, at most links times shards rows; no row of
    the documents takes part. All that reaches the driver is a shards by shards table. No move takes a shard's linked rows
    past `slack` times an equal share of all rows. Links that are still apart after the last round, but would fit a shard,
    gather at their target: the final quotas cut one link a bound at most, wherever links are whole.
    """
    state = votes
    for r in range(rounds):
        best = state.groupBy("link").agg(F.max_by("shard", F.struct("n", F.xxhash64("link", "shard"))).alias("target"))
        aimed = materialize(state.join(best, "link"), "shard-votes")
        met = {(x.shard, x.target): x.n for x in aimed.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()}
        sizes = [sum(n for (at, _), n in met.items() if at == s) for s in range(n_shards)]
        demand = {k: n for k, n in met.items() if k[0] != k[1]}
        allowed = _quotas(demand, sizes, int(slack * total / n_shards) + 1)
        if not allowed:
            release(aimed)
            break
        spark = votes.sparkSession
        odds = [(s, t, float(x), min(1.0, x / demand[s, t])) for (s, t), x in allowed.items()]
        quota = spark.createDataFrame(odds, "shard int, target int, quota double, odds double")
        chance = F.pmod(F.xxhash64("link", "shard", F.lit(r)), F.lit(1 << 20)) / (1 << 20)
        part = F.floor(F.col("n") * F.col("odds"))
        whole = F.when(chance < F.col("odds"), F.col("n")).otherwise(F.lit(0))
        moves = F.when(F.col("odds").isNull(), F.lit(0)).when(F.col("n") > F.col("quota"), part).otherwise(whole).cast("long")
        # at most shards squared rows
        told = aimed.join(F.broadcast(quota), ["shard", "target"], "left").withColumn("move", moves)
        ways = F.array(
            F.struct(F.col("shard").alias("shard"), (F.col("n") - F.col("move")).alias("n")),
            F.struct(F.col("target").alias("shard"), F.col("move").alias("n")),
        )
        spread = told.select("link", F.explode(ways).alias("w")).select("link", "w.shard", "w.n").where("n > 0")
        nxt = materialize(spread.groupBy("link", "shard").agg(F.sum("n").alias("n")), "shard-state")
        release(aimed, state)
        state = nxt
    last = state.groupBy("link").agg(F.max_by("shard", F.struct("n", F.xxhash64("link", "shard"))).alias("target"), F.sum("n").alias("m"))
    fits = F.col("m") * n_shards <= F.lit(total)
    settled = state.join(last, "link").select("link", F.when(fits, F.col("target")).otherwise(F.col("shard")).alias("shard"), "n")
    return materialize(settled.groupBy("link", "shard").agg(F.sum("n").alias("n")), "shard-settled")


def enforce_rows(state: DataFrame, n_shards: int) -> DataFrame:
    """Final quotas for rows (doc_id, link, shard): counts at most one apart. Within each shard the unlinked rows stand at both
    ends and links are whole in between, so that the ends, not the links, give way when a shard is over or under its share;
    each of the bounds between shards cuts one link at most. Adds shard and slot."""
    half = F.when(F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(2)) == 0, 0).otherwise(2)
    side = F.when(F.col("link").isNull(), half).otherwise(1)
    order = [F.col("shard"), F.col("_side"), F.col("link"), F.col("doc_id"), F.col("text_crc32")]
    ranked = global_rank(state.withColumn("_side", side), order, "shard-rank")
    n = ranked.count()
    shard = F.floor(((F.col("rank") + 1) * n_shards - 1) / F.lit(max(n, 1))).cast("int")
    whole = lambda c: (c * F.lit(n) - F.pmod(c * F.lit(n), F.lit(n_shards))) / F.lit(n_shards)
    placed = ranked.withColumn("shard", shard)
    return placed.withColumn("slot", F.col("rank") - whole(F.col("shard").cast("long")).cast("long")).drop("rank", "_side")


def shard_documents(docs: DataFrame, n_shards: int = 8, rounds: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs, under the law `rows`.

    Documents with equal text are linked. size is the text's UTF-8 bytes plus 1; a null text has size 1, CRC 0 and no links,
    an empty one size 1, CRC 0 and is linked with the other empty ones. Repeated rows get places of their own, ties are
    broken by hashes, an empty table gives an empty result, other columns are ignored.
    """
    text = F.encode(F.col("text"), "UTF-8")
    start = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_shards)).cast("int")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.unhex(F.sha2("text", 256)).alias("sha"),
        start.alias("shard"),
    )
    rows = materialize(rows, "shard-rows")
    # a text that only one row has links nothing; counts are combined before the shuffle
    counts = rows.where("sha is not null").groupBy(F.col("sha").alias("link"), "shard").agg(F.count(F.lit(1)).alias("n"))
    shared = counts.groupBy("link").agg(F.sum("n").alias("m")).where("m > 1").select("link")
    votes = materialize(counts.join(shared, "link"), "shard-votes")
    total = rows.count()
    state = balanced_label_propagation(votes, total, n_shards, rounds)
    held = {x["shard"]: x["n"] for x in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    # unlinked rows fill what the links leave of each shard's share
    room = [max(total / n_shards - held.get(s, 0), 0.0) for s in range(n_shards)]
    fill, upto = F.lit(n_shards - 1), sum(room)
    draw = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("fill")), F.lit(1 << 20)) / (1 << 20)
    for s in range(n_shards - 1, 0, -1):
        upto -= room[s]
        fill = F.when(draw < upto / max(sum(room), 1e-9), s - 1).otherwise(fill)
    # a link's members by shard, as running shares; members fall into them by hash
    parts = F.array_sort(F.collect_list(F.struct("shard", "n")))
    links = materialize(state.groupBy("link").agg(parts.alias("parts"), F.sum("n").alias("m")), "shard-links")
    joined = join_classes(rows, links.withColumnRenamed("link", "sha"), ["sha"], F.col("m"), total, ["parts", "m"])
    u = F.floor(F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("place")), F.lit(1 << 20)) * F.col("m") / (1 << 20))
    first = F.lit(0).cast("long")
    walk = F.aggregate(
        "parts",
        F.struct(first.alias("upto"), F.lit(-1).alias("shard")),
        lambda a, p: F.struct((a["upto"] + p["n"]).alias("upto"), F.when((a["shard"] < 0) & (u < a["upto"] + p["n"]), p["shard"]).otherwise(a["shard"]).alias("shard")),
    )
    linked = F.col("m").isNotNull()
    to = F.when(linked, walk["shard"]).otherwise(fill)
    state_rows = joined.select("doc_id", "size", "text_crc32", F.when(linked, F.col("sha")).alias("link"), to.alias("shard"))
    placed = enforce_rows(state_rows, n_shards)
    release(votes)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_shard_documents(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
