"""MinHash near-dedup with tensored banding: table keys are pairs of half keys from two small hash collections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, connected_components, join_classes, materialize, pairs_within, release, whole_groups
from .textops import SPACE, doc_of, mix, slices, small_batches, word_bounds, word_hashes
from .vectors import _span

WORDS = 5
HALVES, ROWS = 10, 2  # half keys in each of the two collections, minhashes in each half key: 40 minhashes make 100 tables
BLOCK = 2048
_SEEDS = mix(np.arange(1, 2 * (2 * HALVES * ROWS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """Sorted distinct 64-bit hashes of each text's shingles of five words, concatenated, and where each text's begin."""
    starts, ends = word_bounds(data, offsets, ~SPACE)
    h = word_hashes(data, starts, ends)
    n = len(offsets) - 1
    cut = np.searchsorted(doc_of(starts, offsets), np.arange(n + 1))
    rolled = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        rolled += h[j : j + len(rolled)] * _STEP[j]
    rolled = mix(rolled)
    sets = []
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if hi - lo >= WORDS:
            sets.append(np.unique(rolled[lo : hi - WORDS + 1]))
        elif hi > lo:  # fewer words: the whole sequence is the one shingle
            sets.append(mix((h[lo:hi] * _STEP[: hi - lo]).sum(keepdims=True) + np.uint64(hi - lo)))
        else:
            sets.append(np.zeros(0, np.uint64))
    at = np.zeros(n + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=at[1:])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), at


def signatures(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minhashes of each set, shape (sets, 2 * HALVES * ROWS); all ones for an empty set."""
    full = np.flatnonzero(at[1:] > at[:-1])
    out = np.full((len(at) - 1, len(_SEEDS) // 2), ~np.uint64(0))
    if len(full):
        for k in range(out.shape[1]):
            out[full, k] = np.minimum.reduceat((flat ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | np.uint64(1)), at[full])
    return out


def _mark(batches):
    for batch in batches:
        cols = {k: [] for k in ("n", "h1", "h2", "halves", "sig")}
        for lo, hi, data, offsets in slices(batch.column("text")):
            flat, at = shingle_sets(data, offsets)
            m = signatures(flat, at)
            total = np.zeros((2, len(flat) + 1), np.uint64)
            np.cumsum(flat, out=total[0, 1:])
            np.cumsum(mix(flat ^ np.uint64(0xA5A5A5A5)), out=total[1, 1:])
            half = mix(sum(mix(m[:, r::ROWS] + np.uint64(r)) * _STEP[r] for r in range(ROWS)))
            cols["n"].append(np.diff(at))
            cols["h1"].append((total[0, at[1:]] - total[0, at[:-1]]).view(np.int64))
            cols["h2"].append((total[1, at[1:]] - total[1, at[:-1]]).view(np.int64))
            cols["halves"].append(half.view(np.int64))
            cols["sig"] += [x.tobytes() for x in (mix(m) & np.uint64(0xFF)).astype(np.uint8)]
        n = batch.num_rows
        halves = np.concatenate(cols["halves"]).ravel() if cols["halves"] else np.zeros(0, np.int64)
        arrays = [pa.array(np.concatenate(cols[k]) if n else np.zeros(0, np.int64)) for k in ("n", "h1", "h2")]
        arrays += [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 2 * HALVES), pa.array(halves)), pa.array(cols["sig"], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tx"), *arrays], names=["doc_id", "tx", "n", "h1", "h2", "halves", "sig"])


def _sets(batches):
    for batch in batches:
        out = []
        for _, _, data, offsets in slices(batch.column("text")):
            flat, at = shingle_sets(data, offsets)
            out += [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.binary())], names=[*keep, "shingles"])


def _candidates(agree: int):
    def run(batches):
        """Per bucket, a spanning forest of the pairs whose signatures agree in `agree` places at least."""
        for pdf in whole_groups(batches, "pair"):
            key, ids, blk = pdf["pair"].to_numpy(), pdf["id"].to_numpy(), pdf["block"].to_numpy()
            same = pdf["bi"].to_numpy() == pdf["bj"].to_numpy()
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
            found_a, found_b = [], []
            for i, j in pairs_within(key):
                apart = same[i] | (blk[i] != blk[j])
                i, j = i[apart], j[apart]
                near = (sig[i] == sig[j]).sum(1) >= agree
                found_a.append(i[near])
                found_b.append(j[near])
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                keep = _span(len(key), a, b)
                yield pd.DataFrame({"a": ids[a[keep]], "b": ids[b[keep]]})

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections: shingles that one set alone has are dropped, the rest multiply as a 0/1 matrix."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    v, owner = every[order], owner[order]
    first = np.r_[True, v[1:] != v[:-1]]
    col = np.cumsum(first) - 1
    shared = np.bincount(col)[col] > 1
    col, owner = col[shared], owner[shared]
    out = np.zeros((len(sets), len(sets)), np.float32)
    if len(col):
        col = np.unique(col, return_inverse=True)[1]
        width = 1 + (4 << 20) // len(sets)
        for lo in range(0, int(col[-1]) + 1, width):
            a, b = np.searchsorted(col, [lo, lo + width])
            m = np.zeros((len(sets), min(width, int(col[-1]) + 1 - lo)), np.float32)
            m[owner[a:b], col[a:b] - lo] = 1
            out += m @ m.T
    return out


def _confirm(percent: int):
    def run(batches):
        """Within each candidate component, a spanning forest of the pairs that reach the similarity on their full sets."""
        for pdf in whole_groups(batches, "pair"):
            key = pdf["pair"].to_numpy()
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for lo, hi in zip(starts, np.r_[starts[1:], len(key)], strict=True):
                part = pdf.iloc[lo:hi]
                ids, blk = part["id"].to_numpy(), part["block"].to_numpy()
                sets = [np.frombuffer(s, np.uint64) for s in part["shingles"]]
                n = np.array([len(s) for s in sets], np.int64)
                both = _overlaps(sets).astype(np.int64)
                hit = 100 * both >= percent * (n[:, None] + n[None, :] - both)
                if part["bi"].iloc[0] != part["bj"].iloc[0]:
                    hit &= blk[:, None] != blk[None, :]
                a, b = np.nonzero(np.triu(hit, 1))
                keep = _span(len(ids), a, b)
                yield pd.DataFrame({"a": ids[a[keep]], "b": ids[b[keep]]})

    return run


def _near_pivot(agree: int):
    def run(batches):
        """Whether each row's signature agrees with its bucket's pivot in `agree` places at least."""
        for pdf in batches:
            view = lambda c: np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), -1)
            if len(pdf):
                yield pdf[["bucket", "id", "sig", "pid"]].assign(near=(view("sig") == view("psig")).sum(1) >= agree)

    return run


def _confirm_edges(percent: int):
    def run(batches):
        """The edges whose two full sets reach the similarity."""
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["shingles"], pdf["_up"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _bucket_pairs(entries: DataFrame, agree: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of entries dealt to pairs of blocks of their bucket, and, where there are buckets of more than BLOCK rows, edges
    that hold these buckets' near rows together: all rows that agree with the smallest one are linked to it and need not
    meet each other, so that a group of near copies costs its rows, not their square."""
    counts = materialize(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "dup-buckets")
    # a bucket of one class alone pairs nothing
    met = entries.join(counts, "bucket")
    if counts.where(F.col("c") > BLOCK).isEmpty():
        return block_pairs(met, ["bucket"], "id", BLOCK, "dup"), None
    large = met.where(F.col("c") > BLOCK)
    pivots = large.groupBy("bucket").agg(F.first("c").alias("size"), F.min_by(F.struct("id", "sig"), "id").alias("p")).select("bucket", "size", F.col("p.id").alias("pid"), F.col("p.sig").alias("psig"))
    told = join_classes(large.select("bucket", "id", "sig"), pivots, ["bucket"], F.col("size"), counts.agg(F.sum("c")).first()[0], ["pid", "psig"])
    told = materialize(told.mapInPandas(_near_pivot(agree), "bucket long, id long, sig binary, pid long, near boolean"), "dup-pivots")
    edges = told.where("near and id <> pid").select(F.col("id").alias("a"), F.col("pid").alias("b")).distinct()
    cols = ["pair", "bi", "bj", "block", "id", "sig"]
    few = block_pairs(met.where(F.col("c") <= BLOCK), ["bucket"], "id", BLOCK, "dup").select(*cols)
    return few.unionByName(block_pairs(told, ["bucket"], "id", BLOCK, "dup", F.col("near")).select(*cols)), edges


def _hold_together(members: DataFrame, forest: DataFrame, percent: int, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """members with `main`, and confirmed links among them: in candidate components of more than `limit` members, each member
    but the smallest is held against one smaller member, in a tree that spans the component. `main` marks the largest part
    that confirmed links of the tree hold together; its members need not meet each other any more."""
    sizes = materialize(members.groupBy("component").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > limit), "dup-large")
    if sizes.isEmpty():
        return members.withColumn("main", F.lit(False)), None
    sized = join_classes(members.select("id", "component"), sizes, ["component"], F.col("_m"), members.count(), ["_m"]).where("_m is not null").drop("_m")
    lower = forest.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("low")).groupBy("id").agg(F.min("low").alias("low"))
    tree = sized.join(lower, "id", "left").select("id", F.coalesce("low", "component").alias("up")).where("up <> id")
    sets = members.select("id", "shingles")
    edges = tree.join(sets, "id").select(F.col("id").alias("a"), F.col("up").alias("b"), "shingles").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("_up")), "b")
    links = materialize(edges.mapInPandas(_confirm_edges(percent), "a long, b long"), "dup-tree")
    held = connected_components(links, "dup-held")
    part = materialize(sized.join(held.select(F.col("node").alias("id"), F.col("component").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id")), "dup-parts")
    most = part.groupBy("component", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("part", F.struct("n", "part")).alias("part"))
    main = part.join(most, ["component", "part"], "left_semi").select("id", F.lit(True).alias("main"))
    return members.join(main, "id", "left"), links


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, tx (a hash of the text), n_shingles, component_id, kept for every row of docs.

    Texts with equal shingle sets form a class and are compared once. Two classes are candidates if they share a half key in
    each of the two collections; half keys that one class alone has are dropped before pairs are formed, which loses nothing.
    Signatures thin the candidates, their spanning forests give components, and inside these all full sets are compared, in
    blocks, without emitting pairs. In large buckets and components, rows that links to single members already hold together
    meet only the rest, which loses no component: a large group of near copies costs its size, not its square. A null, empty or white text has no shingles, no links and is its own component; a null
    doc_id takes no part, has a null component and is kept; an empty table gives an empty result; rows that repeat a doc_id
    are one document and get equal answers for equal texts; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    share = percent / 100
    places = 2 * HALVES * ROWS
    agree = max(1, int(places * share - 5 * math.sqrt(places * share * (1 - share))))
    text = docs.select("doc_id", F.xxhash64("text").alias("tx"), "text")
    marks = materialize(text.mapInArrow(_mark, "doc_id long, tx long, n long, h1 long, h2 long, halves array<long>, sig binary"), "dup-marks")
    classes = marks.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id"), F.first("halves").alias("halves"), F.first("sig").alias("sig"))
    classes = materialize(classes, "dup-classes")
    halves = classes.select("id", F.posexplode("halves").alias("pos", "key"))
    common = halves.groupBy("pos", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("pos", "key")
    kept = halves.join(common, ["pos", "key"]).groupBy("id").agg(F.collect_list(F.when(F.col("pos") < HALVES, F.struct("pos", "key"))).alias("left"), F.collect_list(F.when(F.col("pos") >= HALVES, F.struct("pos", "key"))).alias("right"))
    crossed = kept.where((F.size("left") > 0) & (F.size("right") > 0)).join(classes.select("id", "sig"), "id").withColumn("l", F.explode("left")).withColumn("r", F.explode("right"))
    entries = materialize(crossed.select("id", "sig", F.xxhash64("l.pos", "r.pos", "l.key", "r.key").alias("bucket")), "dup-entries")
    paired, near = _bucket_pairs(entries, agree)
    forest = paired.select("pair", "bi", "bj", "block", "id", "sig").repartition("pair").sortWithinPartitions("pair").mapInPandas(_candidates(agree), "a long, b long")
    forest = materialize(forest if near is None else forest.unionByName(near), "dup-forest")
    groups = connected_components(forest, "dup-candidates")
    wanted = groups.select(F.col("node").alias("id"), "component").join(classes.select("id", "h1", "h2"), "id")
    # the class's text is that of its first document; a doc_id with several texts is told by the set's hashes
    owner = marks.join(wanted, (marks.doc_id == wanted.id) & (marks.h1 == wanted.h1) & (marks.h2 == wanted.h2)).groupBy("id", "component").agg(F.first("tx").alias("_tx"))
    mine = docs.select(F.col("doc_id").alias("_d"), "text").where("doc_id is not null").join(owner, (F.col("_d") == F.col("id")) & (F.xxhash64("text") == F.col("_tx"))).dropDuplicates(["id", "_tx"]).select("id", "component", "text")
    members = materialize(mine.mapInArrow(_sets, "id long, component long, shingles binary"), "dup-sets")
    release(entries)
    # the tree moves sets about as often as eight copies of a component do, which is what BLOCK members would have
    told, held = _hold_together(members, forest, percent, BLOCK)
    exact = block_pairs(told, ["component"], "id", BLOCK // 8, "dup", F.col("main")).select("pair", "bi", "bj", "block", "id", "shingles")
    links = exact.repartition("pair").sortWithinPartitions("pair").mapInPandas(_confirm(percent), "a long, b long")
    links = links if held is None else links.unionByName(held)
    parts = connected_components(links, "dup-components")
    release(members)
    named = classes.select("h1", "h2", "n", "id").join(parts, classes.id == parts.node, "left").select("h1", "h2", "n", F.coalesce("component", "id").alias("_c"))
    out = marks.select("doc_id", "tx", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return out.select("doc_id", "tx", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, with their columns, of which one of each group of near duplicates stays: its smallest doc_id. Rows
    alike in doc_id and text are one document and stay once."""
    kept = near_duplicates(docs, percent).where("kept").select(F.col("doc_id").alias("_d"), F.col("tx").alias("_t")).distinct()
    names = [f"_c{i}" if c not in ("doc_id", "text") else c for i, c in enumerate(docs.columns)]
    rows = docs.toDF(*names).withColumn("_x", F.xxhash64("text"))
    joined = rows.join(kept, rows.doc_id.eqNullSafe(kept._d) & (rows._x == kept._t))
    return joined.dropDuplicates(["doc_id", "_x"]).select(*names).toDF(*docs.columns)


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, 85).select("doc_id", "n_shingles", "component_id", "kept")
