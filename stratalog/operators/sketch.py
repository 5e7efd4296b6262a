"""Membership filters and frequency sketches, built per group by partial aggregation."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import BLOOM_SEED, hash32_many

# Shape of the frequency sketch.
SKETCH_ROWS, SKETCH_WIDTH, HOT_COUNT = 2, 500, 1
#: Bits of a segment, so that a place takes two octets; keys packed at once; bytes sent at once; asked rows a cell, and most cells a group.
SEGMENT, GATHERED, FRAME, CELL, CELLS = 1 << 16, 1 << 18, 1 << 22, 1 << 19, 32


def probes(bits_per_key: int) -> int:
    return min(30, max(1, int(bits_per_key * 0.69)))


def _delta(h: np.ndarray) -> np.ndarray:
    return (h >> 17) | (h << 15) & 0xFFFFFFFF


def _positions(h: np.ndarray, k: int, bits: np.ndarray | int) -> np.ndarray:
    """k bit places of each 32-bit hash by double hashing."""
    return (h[:, None] + _delta(h)[:, None] * np.arange(k)) % (1 << 32) % (np.asarray(bits)[..., None] if np.ndim(bits) else bits)


def _key_hashes(keys) -> np.ndarray:
    return hash32_many(keys if isinstance(keys, pa.Array) else list(keys), BLOOM_SEED)


def build_filters(keys: DataFrame, group: str, bits_per_key: int = 10, few_groups: bool = False) -> DataFrame:
    """(group, n, filter): a filter's bits and, as its last byte, its number of probes. Keys come distinct; a null counts in n
    and sets no bit. Only bit places travel, packed by segment of a filter; segments are united before they meet in a filter.
    few_groups: no more than partitions, so that their sizes are broadcast."""
    k = probes(bits_per_key)
    sizes = keys.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    sizes = F.broadcast(sizes) if few_groups else sizes
    octets = lambda n: -(-np.maximum(64, n * bits_per_key) // 8)

    def packed(batches):
        for batch in _gathered(batches, GATHERED):
            codes, names = pd.factorize(batch.column(group).to_pandas())
            first = np.full(len(names), -1)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            n, h = batch.column("n").to_numpy(), _key_hashes(batch.column("user_key"))
            told = h >= 0
            stride = octets(n.max()) * 8 // SEGMENT + 1
            at = (codes[told, None].astype(np.int64) * stride * SEGMENT + _positions(h[told], k, octets(n[told]) * 8)).ravel()
            at.sort()
            at = at[np.diff(at, prepend=-1) > 0]
            cell = at // SEGMENT
            start = np.flatnonzero(np.diff(cell, prepend=-1))
            places = np.split((at % SEGMENT).astype("<u2"), start[1:]) if len(start) else []
            bare = np.setdiff1d(codes, codes[told])  # nulls alone: a filter without bits
            code, segment = np.append(cell[start] // stride, bare), np.append(cell[start] % stride, bare * 0)
            columns = [batch.column(group).take(pa.array(first[code])), pa.array(n[first[code]]), pa.array(segment), pa.array([x.tobytes() for x in places] + [b""] * len(bare), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [group, "n", "segment", "places"])

    def united(run):
        (name, n, segment), rows = run
        bits = np.zeros(SEGMENT, bool)
        for r in rows:
            bits[np.frombuffer(r.places, "<u2")] = True
        return name, n, segment, np.packbits(bits, bitorder="little")[: octets(n) - segment * SEGMENT // 8].tobytes()

    def assembled(run):
        (name, n), rows = run
        data = np.zeros(octets(n) + 1, np.uint8)
        for r in rows:
            at = r.segment * SEGMENT // 8
            data[at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
        data[-1] = k
        return name, n, data.tobytes()

    kind = dict(keys.dtypes)[group]
    cells = keys.join(sizes, group).select(group, "user_key", "n").mapInArrow(packed, f"{group} {kind}, n long, segment long, places binary")
    segments = _runs(cells, [group, "n", "segment"], united, f"{group} {kind}, n long, segment long, bits binary")
    return _runs(segments, [group, "n"], assembled, f"{group} {kind}, n long, filter binary")


def _gathered(batches, rows: int):
    """Arrow batches put together to at least so many rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _runs(rows: DataFrame, by: list[str], fold, schema: str) -> DataFrame:
    """fold((values, rows)) of all rows equal in `by`, the first columns; a run streams through its task."""
    names = T.StructType.fromDDL(schema).names

    def folded(batches):
        out, size = [], 0
        each = (r for pdf in batches for r in pdf.itertuples(index=False))
        for row in map(fold, groupby(each, key=lambda r: tuple(r[: len(by)]))):
            out, size = [*out, row], size + len(row[-1])
            if size >= FRAME or len(out) >= 1000:
                yield pd.DataFrame(out, columns=names)
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*by).sortWithinPartitions(*by).mapInPandas(folded, schema)


def probed(asked: DataFrame, filters: DataFrame, group: str, key: str = "user_key", few_groups: bool = False) -> DataFrame:
    """asked with `match`: whether its group's filter may hold the key; null for a null key and without a filter. Rows without
    a group are left out. A filter is never joined to rows, each of which would carry a copy: rows and filters are dealt by
    group and cell, of which a group has no more than CELLS however many rows ask, and a task reads its filters first."""
    cells = asked.groupBy(group).agg(F.least(F.lit(CELLS), F.ceil(F.count(F.lit(1)) / CELL)).cast("int").alias("_of"))
    cells = F.broadcast(cells) if few_groups else cells
    rows = asked.join(cells, group).withColumn("_cell", F.pmod(F.xxhash64(*asked.columns), "_of").cast("int")).drop("_of")
    heads = filters.join(cells, group).select(group, F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_cell"), F.col("filter").alias("_filter"))
    met = rows.unionByName(heads, allowMissingColumns=True).repartition(group, "_cell").sortWithinPartitions(F.col("_filter").isNull())
    names = asked.columns

    def told(batches):
        found, index, held = {}, pd.Index([]), _laid([])
        for batch in batches:
            head = batch.column("_filter").is_valid()
            if (first := batch.filter(head)).num_rows:
                found |= zip(first.column(group).to_pandas(), first.column("_filter").to_pylist(), strict=True)
                index, held = pd.Index(list(found)), _laid(list(found.values()))
            batch = batch.filter(pc.invert(head))
            h, which = _key_hashes(batch.column(key)), index.get_indexer(batch.column(group).to_pandas())
            unknown = (h < 0) | (which < 0)
            match = np.zeros(len(h), bool)
            match[~unknown] = _in_filters(h[~unknown], held, which[~unknown])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(match, mask=unknown)], [*names, "match"])

    return met.mapInArrow(told, T.StructType([*asked.schema.fields, T.StructField("match", T.BooleanType())]))


def may_match(key: bytes, data: bytes) -> bool:
    """Whether a filter may hold the key; unknown probe numbers match always."""
    return _in_filter(_key_hashes([key]), data)


def _in_filter(h: np.ndarray, data: bytes) -> bool:
    return bool(_in_filters(h, _laid([data]), np.zeros(1, np.int64))[0])


def _laid(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Filters in one array, with the start, size and number of probes of each; unknown numbers ask nothing."""
    size = np.array([len(f) for f in filters], np.int64)
    count = np.array([f[-1] if f and f[-1] <= 30 else 0 for f in filters], np.int64)
    return np.frombuffer(b"".join(filters), np.uint8), np.cumsum(size) - size, size, count


def _in_filters(h: np.ndarray, held: tuple, which: np.ndarray) -> np.ndarray:
    """Whether filter which[i] may hold hash h[i]; an empty one holds none."""
    data, start, size, count = held
    hit, delta = size[which] > 1, _delta(h)
    for j in range(count.max(initial=0)):
        at = np.flatnonzero(hit & (j < count[which]))
        w = which[at]
        place = (h[at] + delta[at] * j) % (1 << 32) % ((size[w] - 1) * 8)
        hit[at] = data[start[w] + place // 8] >> (place % 8).astype(np.uint8) & 1
    return hit


def _matches(keys: pd.Series, filters: pd.Series) -> pd.Series:
    h = _key_hashes(keys)
    which, known = pd.factorize(pd.Series([None if f is None else bytes(f) for f in filters], dtype=object))
    told = (h >= 0) & (which >= 0)
    out = pd.Series(pd.NA, range(len(h)), dtype="boolean")
    out[told] = _in_filters(h[told], _laid(list(known)), which[told])
    return out


matches = F.pandas_udf(_matches, T.BooleanType())


def sketch_counts(keys: DataFrame, hashed: str = "h") -> DataFrame:
    """(row, cell, n): the counters after adding every key's 64-bit hash; at most SKETCH_ROWS x SKETCH_WIDTH rows."""
    return keys.select(F.explode(_cells(hashed)).alias("c")).groupBy("c.row", "c.cell").agg(F.count(F.lit(1)).alias("n"))


def _cells(hashed: str):
    h = F.col(hashed)
    delta = F.shiftrightunsigned(h, 17).bitwiseOR(F.shiftleft(h, 15))
    places = [F.pmod((h.cast("decimal(38,0)") + delta.cast("decimal(38,0)") * i), F.lit(SKETCH_WIDTH).cast("decimal(38,0)")).cast("int") for i in range(SKETCH_ROWS)]
    return F.array(*[F.struct(F.lit(i).alias("row"), p.alias("cell")) for i, p in enumerate(places)])


def estimates(keys: DataFrame, counts: DataFrame, hashed: str = "h") -> DataFrame:
    """keys with their estimated frequency (never too low) and whether all counters pass the hot threshold."""
    met = keys.withColumn("c", F.explode(_cells(hashed))).select(*keys.columns, "c.row", "c.cell").join(counts, ["row", "cell"], "left")
    low = F.min(F.coalesce("n", F.lit(0)))
    return met.groupBy(*keys.columns).agg(low.alias("estimate"), (low > HOT_COUNT).alias("hot"))


def build_filter_blocks(keys: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """A filter for every 2 KB of file offset (keys: user_key, offset)."""
    return build_filters(keys.select(F.shiftright("offset", 11).alias("block"), "user_key").distinct(), "block", bits_per_key)


def decayed(adds: DataFrame, every: int = 100_000_000) -> DataFrame:
    """adds (add_no, h) of the running epoch: the sketch is cleared after `every` adds."""
    newest = adds.agg(F.floor(F.max("add_no") / every).alias("_e"))
    return adds.join(F.broadcast(newest), F.floor(F.col("add_no") / every) == F.col("_e")).drop("_e")
