"""Embedding near-dedup by cross-polytope hashing, and exact top-k inner products by norm buckets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import block_pairs, connected_components, global_rank, join_classes, materialize, pairs_within, whole_groups

#: Tables at one or two rotations a bucket; each rotation more doubles them, so that recall does not fall as tables grow.
TABLES = 16
#: Rotations in a bucket: so many that a random vector meets about one of this many others.
SPREAD = 128
#: Sign bits of a sketch. Vectors at cosine 0.9 differ in 73.5 of them on average, with deviation 7.9.
SKETCH_BITS, SKETCH_CUT = 512, 113
BLOCK = 2048
#: Members of a large component around which its cores are sought.
SEEDS = 4


def _valid(col: str = "embedding"):
    v = F.col(col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _stack(vs: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vs])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def _rotations(unit: np.ndarray, n: int, seed: int):
    """n fast pseudo-random rotations of the rows: three rounds of random signs and a Hadamard transform each."""
    width = 1 << max(1, (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), width))
    x[:, : unit.shape[1]] = unit
    rng = np.random.default_rng([seed, width])
    for _ in range(n):
        y = x
        for _ in range(3):
            y = _hadamard(y * rng.choice([-1.0, 1.0], width))
        yield y


def cross_polytope(unit: np.ndarray, tables: int, k: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each row in each table (k rotations' nearest signed axes), and k probes a table: the bucket with one of the
    axes replaced by the second nearest. Shapes (rows, tables) and (rows, tables * k)."""
    main, probes, turn = [], [], _rotations(unit, tables * k, seed)
    for _ in range(tables):
        first, second, base = [], [], 1
        for _ in range(k):
            y = next(turn)
            a = np.argpartition(np.abs(y), -2, axis=1)[:, -2:]
            v = np.take_along_axis(y, a, 1)
            swap = np.abs(v[:, 0]) > np.abs(v[:, 1])
            a[swap], v[swap] = a[swap][:, ::-1], v[swap][:, ::-1]
            code = (2 * a + (v > 0)).astype(np.int64)
            first.append(code[:, 1] * base)
            second.append(code[:, 0] * base)
            base *= 2 * y.shape[1]
        whole = sum(first)
        main.append(whole)
        probes += [whole - f + s for f, s in zip(first, second, strict=True)]
    return np.stack(main, 1), np.stack(probes, 1)


def sketch(unit: np.ndarray, seed: int = 9) -> np.ndarray:
    """Sign bits of random projections, as bytes a row."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    return np.packbits(unit @ rng.normal(size=(unit.shape[1], SKETCH_BITS)) > 0, axis=1)


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _span(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of the edges (a, b) that form a spanning forest."""
    parent, keep = np.arange(n), []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = _find(parent, x), _find(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    return keep


def candidate_edges(batches):
    """Per bucket, a spanning forest of the pairs whose sketches are near; at least one of a pair is no probe."""
    for pdf in whole_groups(batches, "pair"):
        key, main = pdf["pair"].to_numpy(), pdf["main"].to_numpy()
        ids, blk = pdf["id"].to_numpy(), pdf["block"].to_numpy()
        bits = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), -1)
        same = pdf["bi"].to_numpy() == pdf["bj"].to_numpy()
        found_a, found_b = [], []
        for i, j in pairs_within(key):
            ok = (main[i] | main[j]) & (same[i] | (blk[i] != blk[j])) & (ids[i] != ids[j])
            i, j = i[ok], j[ok]
            near = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int32) <= SKETCH_CUT
            found_a.append(i[near])
            found_b.append(j[near])
        if found_a:
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            keep = _span(len(key), a, b)
            yield pd.DataFrame({"a": np.maximum(ids[a[keep]], ids[b[keep]]), "b": np.minimum(ids[a[keep]], ids[b[keep]])})


def _links(threshold: float):
    def run(batches):
        """Degrees by exact cosines within each candidate component, and a spanning forest of the links."""
        for pdf in whole_groups(batches, "pair"):
            key = pdf["pair"].to_numpy()
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for lo, hi in zip(starts, np.r_[starts[1:], len(key)], strict=True):
                part = pdf.iloc[lo:hi]
                ids, n, blk = part["id"].to_numpy(), part["n"].to_numpy(), part["block"].to_numpy()
                x = _stack(part["embedding"])
                x /= np.linalg.norm(x, axis=1)[:, None]
                hit = x @ x.T >= threshold
                np.fill_diagonal(hit, False)
                if part["bi"].iloc[0] != part["bj"].iloc[0]:
                    hit &= blk[:, None] != blk[None, :]
                a, b = np.nonzero(np.triu(hit))
                keep = _span(len(ids), a, b)
                yield pd.DataFrame({"id": np.r_[ids, ids[a[keep]]], "links": np.r_[hit @ n, np.zeros(len(keep), np.int64)], "to": np.r_[np.full(len(ids), -1), ids[b[keep]]], "edge": np.r_[np.zeros(len(ids), bool), np.ones(len(keep), bool)]})

    return run


def _near_pivot(batches):
    """Whether each entry's sketch is near its bucket's pivot's."""
    for pdf in batches:
        bits = lambda c: np.frombuffer(b"".join(pdf[c]), np.uint64).reshape(len(pdf), -1)
        if len(pdf):
            near = np.bitwise_count(bits("sketch") ^ bits("_psk")).sum(1, dtype=np.int32) <= SKETCH_CUT
            yield pdf.drop(columns="_psk").assign(near=near)


def _bucket_pairs(entries: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Entries dealt to pairs of blocks of their bucket, and, where there are buckets of more than BLOCK entries, edges from all
    entries near such a bucket's smallest one, no probe, to it. These need not meet each other: their component is told, so a
    group of near copies costs its entries, not their square. A bucket of probes alone pairs nothing."""
    key, cols = ["dim", "table", "bucket"], ["pair", "bi", "bj", "block", "id", "sketch", "main"]
    large = materialize(entries.groupBy(*key).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > BLOCK), "vec-large")
    if large.isEmpty():
        return block_pairs(entries, key, "id", BLOCK, "vec").select(*cols), None
    total = entries.count()
    met = join_classes(entries, large, key, F.col("_m"), total, ["_m"])
    few = block_pairs(met.where("_m is null").select(*entries.columns), key, "id", BLOCK, "vec").select(*cols)
    many = met.where("_m is not null")
    pivots = many.where("main").groupBy(*key).agg(F.first("_m").alias("size"), F.min_by(F.struct("id", "sketch"), "id").alias("p"))
    pivots = materialize(pivots.select(*key, "size", F.col("p.id").alias("_pid"), F.col("p.sketch").alias("_psk")), "vec-heads")
    many = join_classes(many.drop("_m"), pivots, key, F.col("size"), total, ["_pid", "_psk"]).where("_pid is not null")
    many = many.select("id", *key, "sketch", "main", "_pid", "_psk")
    told = materialize(many.mapInPandas(_near_pivot, "id long, dim int, table int, bucket long, sketch binary, main boolean, _pid long, near boolean"), "vec-pivots")
    edges = told.where("near and id <> _pid").select(F.greatest("id", "_pid").alias("a"), F.least("id", "_pid").alias("b")).distinct()
    return few.unionByName(block_pairs(told, key, "id", BLOCK, "vec", F.col("near")).select(*cols)), edges


def _seed_sums(threshold: float):
    def run(batches):
        """Sums of the unit vectors that each seed of their component links."""
        for pdf in batches:
            for (component, dim), part in pdf.groupby(["component", "dim"]):
                x, seeds = _unit(_stack(part["embedding"])), _unit(_stack(part["_seeds"].iloc[0]))
                sums = (x @ seeds.T >= threshold).T.astype(np.float64) @ x
                yield pd.DataFrame({"component": component, "dim": dim, "which": np.arange(len(sums)), "total": list(sums)})

    return run


def _inside(limit: float):
    def run(batches):
        """A bit for each mean of their component to which vectors have cosine `limit` or more."""
        for pdf in batches:
            for _, part in pdf.groupby(["component", "dim"]):
                means = _unit(_stack(part["_means"].iloc[0]))
                bits = ((_unit(_stack(part["embedding"])) @ means.T >= limit) << np.arange(len(means))).sum(1)
                yield part[["id", "component", "dim", "n"]].assign(bits=bits.astype(np.int64))

    return run


def _cores(members: DataFrame, threshold: float, limit: int) -> DataFrame | None:
    """(id, n, low, total) of the core of each candidate component of more than `limit` members: vectors within half the
    threshold's angle of one direction, so that any two of them are linked and none needs to meet another. Directions are
    the means of what SEEDS members link; the one with the largest core is taken. low is the core's smallest id, total the
    sum of its n."""
    key = ["component", "dim"]
    seeds = F.array(*[F.min_by("embedding", F.xxhash64("id", F.lit(i))) for i in range(SEEDS)])
    large = members.groupBy(*key).agg(F.count(F.lit(1)).alias("_m"), seeds.alias("_seeds")).where(F.col("_m") > limit)
    large = materialize(large, "vec-seeds")
    if large.isEmpty():
        return None
    rows, total = members.select("id", "component", "dim", "n", "embedding"), members.count()
    seeded = join_classes(rows, large, key, F.col("_m"), total, ["_seeds"]).where("_seeds is not null").select("component", "dim", "embedding", "_seeds")
    sums = seeded.mapInPandas(_seed_sums(threshold), "component long, dim int, which int, total array<double>")
    mean = sums.select(*key, "which", F.posexplode("total").alias("pos", "x")).groupBy(*key, "which", "pos").agg(F.sum("x").alias("x"))
    mean = mean.groupBy(*key, "which").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))
    mean = mean.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("which", "mean"))), lambda s: s["mean"]).alias("_means"))
    means = materialize(mean.join(large.select(*key, "_m"), key), "vec-means")
    held = join_classes(rows, means, key, F.col("_m"), total, ["_means"]).where("_means is not null").select("id", "component", "dim", "n", "embedding", "_means")
    # the margin is far above what rounding may move a cosine
    half = math.sqrt((1 + threshold) / 2) + 1e-9
    inside = materialize(held.mapInPandas(_inside(half), "id long, component long, dim int, n long, bits long"), "vec-inside")
    count = lambda i: F.struct(F.sum(F.col("n") * F.shiftright("bits", i).bitwiseAND(F.lit(1))).alias("total"), F.min(F.when(F.shiftright("bits", i).bitwiseAND(F.lit(1)) == 1, F.col("id"))).alias("low"), F.lit(i).alias("which"))
    best = inside.groupBy(*key).agg(F.count(F.lit(1)).alias("_m"), F.greatest(*[count(i) for i in range(SEEDS)]).alias("_best"))
    core = join_classes(inside, best, key, F.col("_m"), total, ["_best"]).where(F.expr("shiftright(bits, _best.which) & 1") == 1)
    return materialize(core.select("id", "n", F.col("_best.low").alias("low"), F.col("_best.total").alias("total")), "vec-core")


def table_shape(classes: int) -> tuple[int, int]:
    """Rotations in a bucket and tables for so many distinct vectors."""
    k = max(1, round(math.log(max(classes, 2)) / math.log(SPREAD)))
    return k, TABLES << max(0, k - 2)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding); other columns are ignored.

    Equal vectors form a class and are compared once. Cross-polytope buckets with probes propose pairs, sign sketches thin
    them, and their spanning forests give candidate components, inside which all cosines are computed exactly in double
    precision, in blocks, so that no pair is emitted. Vectors of a large component that lie within half the threshold's angle
    of one direction are all linked to each other; they are counted, and meet only the rest. Vectors that are null, zero,
    empty or hold null or non-finite components have no links and are their own component; vectors of different length are
    never linked; repeated rows are each other's links; rows that repeat a vec_id with other vectors are counted each by its
    own vector. An empty table gives an empty result.
    """
    rows = vectors.select("vec_id", "embedding")
    ok = _valid() & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    classes = rows.where(ok).groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.select("*", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("id")), "vec-classes")
    total = classes.count()
    k, tables = table_shape(total)

    def hashed(batches):
        for pdf in batches:
            for _, part in pdf.groupby(pdf["dim"].to_numpy()):
                x = _unit(_stack(part["embedding"]))
                main, probes = cross_polytope(x, tables, k)
                s = sketch(x)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "dim": part["dim"].to_numpy(), "sketch": [x.tobytes() for x in s], "main": list(main), "probes": list(probes)})

    marks = classes.select("id", "dim", "embedding").mapInPandas(hashed, "id long, dim int, sketch binary, main array<long>, probes array<long>")
    entry = lambda c, every, flag: F.transform(F.col(c), lambda x, i: F.struct(F.floor(i / every).cast("int").alias("table"), x.alias("bucket"), F.lit(flag).alias("main")))
    entries = marks.select("id", "dim", "sketch", F.explode(F.concat(entry("main", 1, True), entry("probes", k, False))).alias("e")).select("id", "dim", "sketch", "e.*")
    entries = materialize(entries, "vec-entries")
    paired, near = _bucket_pairs(entries)
    forest = paired.repartition("pair").sortWithinPartitions("pair").mapInPandas(candidate_edges, "a long, b long")
    groups = connected_components(forest if near is None else forest.unionByName(near), "vec-candidates")
    members = materialize(classes.join(groups, classes.id == groups.node).select("id", "n", "embedding", "component", "dim"), "vec-members")
    core = _cores(members, threshold, BLOCK // 4)
    marked = members.withColumn("main", F.lit(False)) if core is None else members.join(core.select("id", F.lit(True).alias("main")), "id", "left")
    exact = block_pairs(marked, ["component", "dim"], "id", BLOCK // 4, "vec-exact", F.col("main")).select("pair", "bi", "bj", "block", "id", "n", "embedding")
    links = exact.repartition("pair").sortWithinPartitions("pair").mapInPandas(_links(threshold), "id long, links long, to long, edge boolean")
    links = materialize(links, "vec-links")
    edges = links.where("edge").select(F.col("id").alias("a"), F.col("to").alias("b"))
    degrees = links.where("not edge").select("id", "links")
    if core is not None:
        edges = edges.unionByName(core.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")))
        degrees = degrees.unionByName(core.select("id", (F.col("total") - F.col("n")).alias("links")))
    degree = degrees.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(edges, "vec-components")
    parted = classes.select("id", "first").join(parts, F.col("id") == parts.node).select("id", "first", "component")
    lowest = parted.groupBy("component").agg(F.count(F.lit(1)).alias("_m"), F.min("first").alias("_c"))
    named = join_classes(parted, lowest, ["component"], F.col("_m"), total, ["_c"]).select("id", "_c")
    told = classes.join(degree, "id", "left").join(named, "id", "left")
    told = told.select(F.col("embedding").alias("_e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_l"), F.coalesce("_c", "first").alias("_c"))
    keyed = rows.withColumn("_key", F.when(ok, F.col("embedding")))
    out = keyed.join(told, keyed["_key"] == told["_e"], "left")
    component = F.coalesce("_c", "vec_id")
    return out.select("vec_id", F.coalesce("_l", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op4_near_duplicate_vectors(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERY_BLOCK = 512
BUCKET = 4096
#: Query blocks that one task holds beside a bucket; most tasks of the search.
TOGETHER, MOST_TASKS = 8, 4096
PACKED = "dim int, block long, n int, low double, high double, uids binary, ids binary, matrix binary"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("uid", ignore_index=True)
    m = np.stack([np.asarray(v, np.int64) for v in pdf["v"]]) if pdf["dim"].iloc[0] else np.zeros((len(pdf), 0), np.int64)
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]], "n": [len(pdf)], "low": [pdf["norm"].min()], "high": [pdf["norm"].max()], "uids": [pdf["uid"].to_numpy(np.int64).tobytes()], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "matrix": [m.tobytes()]})


def _unpack(uids: bytes, ids: bytes, matrix: bytes, dim: int):
    i = np.frombuffer(ids, np.int64)
    m = np.frombuffer(matrix, np.int64).reshape(len(i), dim)
    return np.frombuffer(uids, np.int64), i, m


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point where every sum is below 2**53, else in 64-bit integers, else in
    Python's, held to the range of 64 bits at the end."""
    top = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if top < 2**62:
        return q @ v.T
    return np.clip(q.astype(object) @ v.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, ties to the smaller id."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= edge)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))][:k]


def bucket_top_k(q, v, theta: np.ndarray, k: int):
    """For one block of queries against one bucket of candidates in order of falling length: (query, place, score) triples.

    The local threshold of a query is theta / (its length * the bucket's greatest length), the cosine that a candidate must
    reach at least. Above 1 the bucket is skipped. From COORDINATE on, intervals around the query's three largest
    coordinates leave few candidates, and these are verified; below, only the candidates long enough are multiplied.
    """
    (q_uid, _, qm), (v_uid, v_id, vm) = q, v
    ql, vl = np.sqrt((qm.astype(np.float64) ** 2).sum(1)), np.sqrt((vm.astype(np.float64) ** 2).sum(1))
    local = np.where(ql * vl.max(initial=0) > 0, theta / np.maximum(ql * vl.max(initial=0), 1e-300), np.where(theta > 0, np.inf, -np.inf))
    unit = None
    by_length = []
    for i in range(len(qm)):
        t = local[i] - 1e-9
        if t > 1:
            continue
        if t < COORDINATE:
            by_length.append(i)
            continue
        if unit is None:
            unit = vm / np.maximum(vl, 1e-300)[:, None]
        qu = qm[i] / ql[i]
        left = np.ones(len(vm), bool)
        for f in np.argsort(-np.abs(qu))[:3]:
            reach = math.sqrt(max(0.0, (1 - t * t) * (1 - qu[f] ** 2))) + 1e-9
            top = 1.0 if qu[f] >= t else qu[f] * t + reach
            low = -1.0 if qu[f] <= -t else qu[f] * t - reach
            left &= (unit[:, f] >= low) & (unit[:, f] <= top)
        at = np.flatnonzero(left & (v_uid != q_uid[i]))
        s = _products(qm[i : i + 1], vm[at])[0]
        at, s = at[s >= theta[i]], s[s >= theta[i]]
        b = _best(s, v_id[at], k)
        yield i, at[b], s[b]
    if by_length:
        need = np.array([theta[i] / ql[i] if ql[i] > 0 else -np.inf for i in by_length]) - 1e-6
        # candidates fall in length, so each query needs a prefix; the block takes the longest of them
        reach = int(np.count_nonzero(vl >= need.min())) if len(need) else 0
        score = _products(qm[by_length], vm[:reach])
        for row, i in enumerate(by_length):
            at = np.flatnonzero((score[row] >= theta[i]) & (v_uid[:reach] != q_uid[i]))
            b = _best(score[row][at], v_id[at], k)
            yield i, at[b], score[row][at[b]]


COORDINATE = 0.7


def exact_top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows where is_query holds, the k candidates with the highest inner product of
    floor(1024 * x), over all rows but the query's own; ties to the smaller vec_id.

    Candidates are ordered by length and cut into buckets; each block of queries first meets the longest bucket, which
    gives it thresholds, and then the buckets that the thresholds leave. Vectors that are null or hold null or non-finite
    components, and rows with a null vec_id, take no part; vectors meet only those with as many components; rows that repeat
    a vec_id are candidates of their own; components beyond 64 bits and scores beyond them are held to that range; an empty
    table gives an empty result; other columns are ignored.
    """
    v = F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("long"))
    rows = vectors.where(_valid() & F.col("vec_id").isNotNull()).select("vec_id", v.alias("v"), is_query.alias("q"))
    rows = rows.withColumn("dim", F.size("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    ranked = global_rank(rows, ["dim", F.desc("norm"), "vec_id"], "topk-rows", "uid")
    cut = lambda df, size: df.withColumn("block", F.floor(F.col("uid") / size)).groupBy("dim", "block").applyInPandas(_pack, PACKED)
    buckets = materialize(cut(ranked.drop("q"), BUCKET), "topk-buckets")
    asked_rows = global_rank(ranked.where("q").drop("q"), ["dim", F.desc("norm"), "uid"], "topk-queries", "place")
    blocks = asked_rows.withColumn("block", F.floor(F.col("place") / QUERY_BLOCK)).drop("place").groupBy("dim", "block").applyInPandas(_pack, PACKED)
    queries = materialize(blocks, "topk-blocks")
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    longest = buckets.groupBy("dim").agg(F.min("block").alias("block"))
    first = buckets.join(longest, ["dim", "block"])

    def thresholds(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                block, bucket = _unpack(r.q_uids, r.q_ids, r.q_matrix, r.dim), _unpack(r.uids, r.ids, r.matrix, r.dim)
                theta = np.full(len(block[1]), -np.inf)
                for i, _, s in bucket_top_k(block, bucket, theta.copy(), k):
                    theta[i] = s[-1] if len(s) == k else -np.inf
                length = np.sqrt((block[2].astype(np.float64) ** 2).sum(1))
                reach = np.where(length > 0, theta / np.maximum(length, 1e-300), np.where(theta > 0, np.inf, -np.inf))
                yield pd.DataFrame({"q_dim": [r.dim], "q_block": [r.q_block], "theta": [theta.tobytes()], "reach": [float(reach.min())]})

    met = q.join(first, q.q_dim == first.dim).select("q_block", "q_uids", "q_ids", "q_matrix", "dim", "uids", "ids", "matrix")
    theta = materialize(met.mapInPandas(thresholds, "q_dim int, q_block long, theta binary, reach double"), "topk-theta")
    # blocks of the stated queries against buckets of all rows: ids and bounds only, then each side by its id. A bucket's
    # matrix moves once for every TOGETHER query blocks; the number of tasks follows the work, as its bytes tell little
    bounds = buckets.select("dim", "block", "high")
    met = (F.col("q_dim") == F.col("dim")) & (F.col("high") + 1e-6 >= F.col("reach"))
    chunk = F.floor(F.col("q_block") / TOGETHER).alias("chunk")
    plan = materialize(theta.select("q_dim", "q_block", "reach").join(bounds, met).select("dim", "block", "q_block", chunk), "topk-plan")
    by = ["dim", "block", "chunk"]
    groups = plan.select(*by).distinct()
    tasks = max(1, min(groups.count(), MOST_TASKS))

    def search(bucket_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in bucket_rows.itertuples():
            bucket = _unpack(b.uids, b.ids, b.matrix, b.dim)
            for r in query_rows.itertuples():
                block = _unpack(r.q_uids, r.q_ids, r.q_matrix, b.dim)
                for i, at, s in bucket_top_k(block, bucket, np.frombuffer(r.theta, np.float64), k):
                    if len(at):
                        out.append(pd.DataFrame({"own": block[0][i], "query_id": block[1][i], "uid": bucket[0][at], "vec_id": bucket[1][at], "score": s}))
        cols = ["own", "query_id", "uid", "vec_id", "score"]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in cols})

    asked = q.join(theta.select("q_dim", "q_block", "theta"), ["q_dim", "q_block"]).withColumnRenamed("q_dim", "dim")
    left = groups.join(buckets.select("dim", "block", "uids", "ids", "matrix"), ["dim", "block"]).repartition(tasks, *by)
    own = [F.col(c).alias(f"its_{c}") for c in by]
    right = plan.join(asked, ["dim", "q_block"]).select(*own, "q_uids", "q_ids", "q_matrix", "theta").repartition(tasks, *[f"its_{c}" for c in by])
    shape = "own long, query_id long, uid long, vec_id long, score long"
    found = left.groupBy(*by).cogroup(right.groupBy(*[f"its_{c}" for c in by])).applyInPandas(search, shape)
    order = W.partitionBy("own").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.own <> c.own AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) <= 10
"""
