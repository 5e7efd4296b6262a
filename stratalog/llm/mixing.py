"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_rank, join_classes, materialize, release

WORD = r"[^\x20\x09-\x0D]+"
GROUP_ROWS = 4096
FAN_IN = 1024
#: Draws of a source's last group, which end once at most this share of its mass is left over.
DRAWS, NEAR = 32, 0.001


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(1, 2, 3), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, source_size, classes, target) per source.

    Sources in code point order, null last, take the weights in turn and share `share` of all sizes; no target passes
    `cap` times its source's size, and the excess goes to the others by weight until none is above. The level that all
    free sources share is found by Newton steps, each one aggregation over the table of sources.
    """
    stats = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = global_rank(stats, [F.col("source").asc_nulls_last()], "mix-sources")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", w)
    over = lambda lam: F.lit(lam) * F.col("w") > F.lit(cap) * F.col("source_size")
    total, all_w = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    lam, capped = share * (total or 0) / (all_w or 1.0), -1
    while True:  # each pass caps at least one source more, or ends
        n, held, free = ranked.agg(
            F.sum(F.when(over(lam), 1).otherwise(0)),
            F.sum(F.when(over(lam), F.col("source_size")).otherwise(0)),
            F.sum(F.when(over(lam), 0.0).otherwise(F.col("w"))),
        ).first()
        if n is None or n == capped:
            break
        capped = n
        lam = (share * total - cap * held) / free if free else float("inf")
    target = F.when(over(lam), F.lit(cap) * F.col("source_size")).otherwise(F.lit(lam) * F.col("w")).cast("double")
    return ranked.select("source", "source_size", F.col("n").alias("classes"), target.alias("target"))


def _pivot(ids, p: np.ndarray, s: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Decide 0 or 1 for all rows but one: in the order given, the row that is still fractional and the next one exchange mass
    (probability times size, whose sum stays) at random until one of them is integral. Returns the probabilities and the
    place of the row that may still be fractional."""
    p = p.copy()
    u = rng.random(len(p))
    a = 0
    for b in range(1, len(p)):
        up, down = min((1 - p[a]) * s[a], p[b] * s[b]), min(p[a] * s[a], (1 - p[b]) * s[b])
        if u[b] * (up + down) < down:  # a rises with this chance, which keeps each expectation
            if (1 - p[a]) * s[a] <= p[b] * s[b]:
                p[b] -= (1 - p[a]) * s[a] / s[b]
                p[a] = 1.0
            else:
                p[a] += p[b] * s[b] / s[a]
                p[b] = 0.0
        elif p[a] * s[a] <= (1 - p[b]) * s[b]:
            p[b] += p[a] * s[a] / s[b]
            p[a] = 0.0
        else:
            p[a] -= (1 - p[b]) * s[b] / s[a]
            p[b] = 1.0
        if p[a] in (0.0, 1.0):
            a = b
    return p, a


def _level(k: int, seed: int):
    """One level of the reduction tree for one group of one source: all rows but one are decided."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # from large to small: neighbours are alike in size, so that either may stay open, and what is left over is small
        pdf = pdf.sort_values(["size", "h", "cid"], ascending=False, kind="stable", ignore_index=True)
        size, p = pdf["size"].to_numpy(np.float64), pdf["p"].to_numpy(np.float64).copy()
        p[size == 0] = 0.0
        order = np.flatnonzero((p > 0) & (p < 1))
        left = np.zeros(len(pdf), bool)
        if len(order):
            best, least, q = None, np.inf, p[order]
            for turn in range(DRAWS if pdf["of"].iloc[0] == 1 else 1):
                rng = np.random.default_rng([seed, k, turn, int(pdf["g"].iloc[0]), int(pdf["sid"].iloc[0])])
                got, last = _pivot(order, q, size[order], rng)
                over = min(got[last], 1 - got[last]) * size[order[last]]
                if over < least:
                    best, least = (got, last), over
                if over <= NEAR * (q * size[order]).sum():
                    break
            p[order], last = best
            left[order[last]] = 0 < p[order[last]] < 1
        return pdf.assign(p=p, left=left)[["cid", "sid", "size", "h", "p", "g", "of", "left"]]

    return run


def pivotal_copies(units: DataFrame, most: int, seed: int = 17) -> DataFrame:
    """(cid, one) for units (cid, sid, size, h, p, g, of): whether each unit's fractional copy is taken.

    p is the unit's fractional copy probability, sid a number of its source, h a hash of its contents, which orders ties, and
    g its group among the `of` groups of its source, `most` at most. Level 0 pairs the units of each group, FAN_IN groups'
    open units meet at the next level, until one unit a source is open; that one is rounded to the nearest. So a source
    differs from its target by at most half of one unit, whatever share of all rows it holds. Where a source's last group
    would leave over more than a thousandth of its mass, as small sources may, it is drawn anew, DRAWS times at most, and the
    draw that leaves least counts. No column that may be null goes through pandas.
    """
    shape = "cid long, sid long, size long, h long, p double, g long, of long, left boolean"
    done = []
    rest = units
    k, groups = 0, max(1, most)
    while True:
        out = materialize(rest.groupBy("sid", "g").applyInPandas(_level(k, seed), shape), f"mix-level{k}")
        done.append(out.where("not left"))
        rest = out.where("left")
        if groups <= 1:
            break
        groups, k = -(-groups // FAN_IN), k + 1
        rest = rest.drop("left").withColumn("g", F.floor(F.col("g") / FAN_IN)).withColumn("of", F.ceil(F.col("of") / FAN_IN))
    done.append(rest)
    decided = done[0]
    for x in done[1:]:
        decided = decided.unionByName(x)
    return decided.select("cid", (F.col("p") >= 0.5).cast("long").alias("one"))


#: Rows alike in these, th being a hash of the text, are alike in size too.
KEYS = ["doc_id", "source", "th"]


def _plan(rows: DataFrame, weights, cap: float, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The decisions per class of rows alike in KEYS: (KEYS, n, base, more): each of its n rows is taken base times, and
    `more` of them once more. Also the targets by source.

    n rows alike with fractional probability f, paired among themselves, leave floor(n * f) of them taken and one open with
    the rest of n * f: this one is the unit of its class, so that classes of any size are one row in the tree."""
    classes = materialize(rows.groupBy(*KEYS).agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n")).withColumn("cid", F.monotonically_increasing_id()), "mix-classes")
    targets = source_targets(classes, weights, cap, share)
    targets = materialize(targets.withColumn("sid", F.pmod(F.xxhash64("source"), F.lit(1 << 62))), "mix-targets")
    own = targets.select(F.col("source").alias("_s"), "source_size", "target", "classes", "sid")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    told = classes.join(own, classes.source.eqNullSafe(own._s)).drop("_s").withColumn("rate", rate)
    told = told.withColumn("base", F.floor("rate").cast("long")).withColumn("_f", (F.col("rate") - F.floor("rate")) * F.col("n"))
    told = told.withColumn("sure", F.floor("_f").cast("long"))
    h = F.xxhash64(*KEYS)
    groups = F.ceil(F.col("classes") / GROUP_ROWS)
    open_ = (F.col("_f") - F.floor("_f")).alias("p")
    units = told.select("cid", "sid", "size", h.alias("h"), open_, F.pmod(F.xxhash64(h, F.lit(seed)), groups).alias("g"), groups.alias("of"))
    most = targets.agg(F.max(F.ceil(F.col("classes") / GROUP_ROWS))).first()[0] or 1
    ones = pivotal_copies(units, most, seed)
    empty = F.col("size") == 0
    more = F.when(empty, F.lit(0)).otherwise(F.col("sure") + F.col("one")).cast("long")
    base = F.when(empty, F.lit(0)).otherwise(F.col("base")).cast("long")
    plan = told.join(ones, "cid").select(*KEYS, "n", base.alias("base"), more.alias("more"))
    return materialize(plan, "mix-plan"), targets


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows, which have KEYS, with `copies`. Of a class of several rows, the first `more` in a distributed order get one
    more copy; rows of classes of their own, nearly all, need no order."""
    told = join_classes(rows, plan, KEYS, F.col("n"), rows.count(), ["n", "base", "more"])
    single = told.where("n = 1").withColumn("copies", F.col("base") + F.col("more"))
    many = plan.where("n > 1 and more > 0 and more < n")
    alike = told.where("n > 1 and not (more > 0 and more < n)")
    alike = alike.withColumn("copies", F.col("base") + F.when(F.col("more") > 0, 1).otherwise(0))
    out = single.unionByName(alike)
    if not many.isEmpty():
        split = told.where("n > 1 and more > 0 and more < n")
        ranked = global_rank(split, [*KEYS, F.monotonically_increasing_id()], "mix-alike", "_rank")
        first = ranked.groupBy(*KEYS).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_size"))
        placed = join_classes(ranked, first, KEYS, F.col("_size"), ranked.count(), ["_first"])
        late = F.when(F.col("_rank") - F.col("_first") < F.col("more"), 1).otherwise(0)
        out = out.unionByName(placed.withColumn("copies", F.col("base") + late).drop("_rank", "_first"))
    return out.drop("n", "base", "more")


def mix_sources(docs: DataFrame, weights=(1, 2, 3), cap: float = 3.0, share: float = 1.0, seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken.

    Null and empty texts have size 0 and are taken 0 times; a null source is a source of its own, last in order; doc_id may
    be null or repeat; rows alike in doc_id, source and text are decided one by one, so that their numbers of copies
    differ by one at most; an empty table gives an empty result; other columns are ignored. Reruns agree, however the
    rows are dealt: chance comes from hashes of the rows.
    """
    rows = materialize(docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("th")), "mix-rows")
    plan, targets = _plan(rows, weights, cap, share, seed)
    joined = _with_copies(rows, plan)
    t = targets.select(F.col("source").alias("_src"), "source_size", "target")
    joined = joined.join(t, joined.source.eqNullSafe(t._src), "left")
    n = F.coalesce(F.col("copies"), F.lit(0)).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights=(1, 2, 3), cap: float = 3.0, share: float = 1.0, seed: int = 17) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the same columns, whatever their names."""
    names = [c if c in ("doc_id", "source", "text") else f"_c{i}" for i, c in enumerate(docs.columns)]
    own = docs.toDF(*names).withColumn("th", F.xxhash64("text"))
    rows = materialize(own.select(*KEYS, word_count().alias("size")), "mix-rows")
    plan, _ = _plan(rows, weights, cap, share, seed)
    release(rows)
    taken = _with_copies(own, plan)
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return taken.where("copies > 0").withColumn("_k", times).select(*names).toDF(*docs.columns)


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
