"""The store's calls, end to end, and the choices of compaction."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.functions import scalar as X
from stratalog.operators import compact as C
from stratalog.operators import files as FS
from stratalog.operators import records as R
from stratalog.operators import sketch as K
from stratalog.operators.store import VersionedTable

FILES = "level int, file_no long, file_size long, smallest_key long, smallest_seq long, largest_key long, largest_seq long, allowed_seeks long"


def test_store_session(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/db")
    t.put(b"foo", b"hello")
    t.write(spark.createDataFrame([(0, 1, b"bar", b"b"), (1, 1, b"box", b"c"), (2, 0, b"bar", None)], "op_idx int, vtype int, user_key binary, value binary"))
    keys = spark.createDataFrame([(b"foo",), (b"bar",), (b"box",), (b"no",)], "user_key binary")
    look = lambda s=None: {bytes(r.user_key): (r.status, r.value and bytes(r.value)) for r in t.get(keys, s).collect()}
    assert look() == {b"foo": ("FOUND", b"hello"), b"bar": ("DELETED", None), b"box": ("FOUND", b"c"), b"no": ("NOT_FOUND", None)}
    assert [bytes(r.user_key) for r in t.scan().collect()] == [b"box", b"foo"]
    assert [bytes(r.user_key) for r in t.scan(reverse=True).collect()] == [b"foo", b"box"]
    assert [bytes(r.user_key) for r in t.scan(b"c").collect()] == [b"foo"]
    s = t.snapshot()
    t.delete(b"foo")
    assert look(s)[b"foo"] == ("FOUND", b"hello") and look()[b"foo"] == ("DELETED", None)
    before = t.log().count()
    t.compact()
    assert look(s)[b"foo"] == ("FOUND", b"hello") and look()[b"foo"] == ("DELETED", None)
    t.release(s)
    t.compact(level=2)
    assert t.log().count() == 1 < before
    assert look()[b"foo"] == ("NOT_FOUND", None)
    assert t.property("num-files-at-level2").first().n == 1
    assert t.property("stats").first().level == 2
    assert t.property("sstables").count() == 1
    assert t.property("approximate-memory-usage").first().bytes == 12
    sizes = t.approximate_sizes(spark.createDataFrame([(1, b"a", b"c"), (2, b"c", b"z")], "range_id int, start binary, limit binary"))
    assert {r.range_id: r.bytes for r in sizes.collect()} == {1: 12, 2: 0}
    t.repair()
    assert t.log().count() == 1
    t.destroy()
    assert not (tmp_path / "db").exists()


def test_sequence_numbers_outlive_compaction(spark, tmp_path):
    """put, delete, snapshot, compact, put: the old snapshot must not see the new value; nor after a reopening."""
    where = f"file://{tmp_path}/db"
    t = VersionedTable(spark, where)
    key = spark.createDataFrame([(b"k",)], "user_key binary")
    t.put(b"k", b"old")
    t.delete(b"k")
    s = t.snapshot()
    t.compact()
    assert t.log().count() == 0 and t.last_seq() == 2
    t.put(b"k", b"new")
    assert t.last_seq() == 3
    assert t.get(key, s).first().status != "FOUND"
    assert bytes(t.get(key).first().value) == b"new"
    again = VersionedTable(spark, where)
    assert again.last_seq() == 3 and bytes(again.get(key).first().value) == b"new"


def test_failures_between_steps_leave_the_old_state(spark, tmp_path, monkeypatch):
    where = f"file://{tmp_path}/db"
    t = VersionedTable(spark, where)
    key = spark.createDataFrame([(b"a",), (b"b",)], "user_key binary")
    t.put(b"a", b"1")
    state = lambda: sorted((bytes(r.user_key), r.status) for r in VersionedTable(spark, where).get(key).collect())
    before = state()

    def broken(*_):
        raise OSError("lost")

    for step in (lambda x: x.put(b"b", b"2"), lambda x: x.compact()):
        victim = VersionedTable(spark, where)
        monkeypatch.setattr(victim, "_point", broken)
        try:
            step(victim)
        except OSError:
            pass
        assert state() == before
    t.put(b"b", b"3")  # takes the number of the batch that was lost
    assert t.last_seq() == 2
    assert {bytes(r.user_key): bytes(r.value) for r in t.get(key).collect()} == {b"a": b"1", b"b": b"3"}
    for p in (tmp_path / "db").glob("CURRENT-*"):
        p.unlink()
    for p in (tmp_path / "db").glob(".CURRENT-*"):
        p.unlink()
    try:
        VersionedTable(spark, where)
        raise AssertionError("a table without a pointer must not read as empty")
    except ValueError:
        t.repair()
    assert VersionedTable(spark, where).log().count() == 2


def test_pick(spark):
    rows = [(1, i, 100, 10 * i, 1, 10 * i + 5, 1, 100) for i in range(5)]
    files = spark.createDataFrame(rows, FILES)
    assert C.pick(files, {}, base=200) == {"reason": "size", "level": 1, "file_no": 0}
    assert C.pick(files, {1: 15}, base=200) == {"reason": "size", "level": 1, "file_no": 2}
    assert C.pick(files, {1: 99}, base=200)["file_no"] == 0
    misses = spark.createDataFrame([(3,)] * 100, "file_no long")
    assert C.pick(files, {}, misses, base=10_000) == {"reason": "seek", "level": 1, "file_no": 3}
    assert C.pick(files, {}, base=10_000) is None


def test_other_inputs(spark):
    rows = [(1, 1, 10, 0, 1, 10, 1, 100), (1, 2, 10, 11, 1, 19, 1, 100), (1, 3, 10, 40, 1, 50, 1, 100), (2, 4, 10, 5, 1, 18, 1, 100), (2, 5, 10, 30, 1, 60, 1, 100)]
    files = spark.createDataFrame(rows, FILES)
    assert C.other_inputs(files, 1, [1], 1000) == ([1, 2], [4])
    assert C.other_inputs(files, 1, [1], 25) == ([1], [4])


def test_recovery(spark):
    shape = "edit_no long, comparator string, log_number long, next_file long, last_seq long"
    edits = spark.createDataFrame([(1, "bytewise", 3, 5, 10), (2, None, 4, 7, None), (3, None, None, None, 20)], shape)
    assert tuple(FS.recover(edits).first()) == ("bytewise", 4, 7, 20, "OK")
    assert FS.recover(edits.withColumn("comparator", F.lit("other"))).first().status == "INVALID_ARGUMENT"
    assert FS.recover(edits.where("edit_no = 3")).first().status == "CORRUPTION"
    live = spark.createDataFrame([(1, 2, 30)], "level int, file_no long, file_size long")
    assert FS.fold_edits(FS.as_one_edit(live)).collect() == live.collect()


def test_filter_blocks_and_decay(spark):
    keys = spark.createDataFrame([(f"k{i}".encode(), i * 40) for i in range(200)], "user_key binary, offset long")
    blocks = K.build_filter_blocks(keys)
    asked = keys.withColumn("block", F.shiftright("offset", 11)).join(blocks, "block")
    assert asked.where(~K.matches("user_key", "filter")).count() == 0
    assert blocks.count() == 4
    adds = spark.range(25).select(F.col("id").alias("add_no"), F.col("id").alias("h"))
    assert K.decayed(adds, 10).count() == 5


@pytest.mark.parametrize("few", [False, True])
def test_filters_of_many_segments_and_cells(spark, monkeypatch, few):
    """Filters are those of bits set one by one; rows meet them in several cells, also rows whose group has none."""
    monkeypatch.setattr(K, "CELL", 500)
    keys = [("big", f"k{i}".encode()) for i in range(15_000)] + [("small", b"a"), ("small", None), ("null", None)]
    filters = K.build_filters(spark.createDataFrame(keys, "g string, user_key binary"), "g", few_groups=few).cache()
    n = Counter(g for g, _ in keys)
    want = {g: np.zeros(-(-max(64, 10 * n[g]) // 8) * 8, np.uint8) for g in n}
    for g, k in keys:
        for j in range(6 if k else 0):
            h = X.hash32_bytes(k, X.BLOOM_SEED)
            want[g][(h + ((h >> 17 | h << 15) & 0xFFFFFFFF) * j) % (1 << 32) % len(want[g])] = 1
    got = {r.g: (r.n, bytes(r.filter)) for r in filters.collect()}
    assert got == {g: (n[g], np.packbits(bits, bitorder="little").tobytes() + b"\x06") for g, bits in want.items()}
    asked = [(i, g, k) for i, (g, k) in enumerate([*keys, *(("big", f"x{i}".encode()) for i in range(3000)), ("small", b"zz"), ("none", b"a"), (None, b"a")])]
    rows = K.probed(spark.createDataFrame(asked, "i long, g string, user_key binary"), filters, "g", few_groups=few).collect()
    assert sorted((r.i, r.match) for r in rows) == [(i, None if k is None or g == "none" else K.may_match(k, got[g][1])) for i, g, k in asked if g]
    joined = spark.createDataFrame(asked, "i long, g string, user_key binary").join(filters, "g", "left").select("i", K.matches("user_key", "filter").alias("match"))
    assert {r.i: r.match for r in joined.where("g is not null").collect()} == {r.i: r.match for r in rows}


def test_fills(spark):
    assert R.fill(spark, 10, "fillseq").where("batch_id <> id").count() == 0
    assert R.fill(spark, 2000, "fillbatch", 1000).select("batch_id").distinct().count() == 2
    assert R.fill(spark, 1000, "hotwrite").agg(F.max("id")).first()[0] < 10
    assert R.fill(spark, 1000, "fillrandom").select("id").distinct().count() < 1000
