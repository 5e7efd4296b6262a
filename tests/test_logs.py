"""Golden cases and properties of version logs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stratalog.operators import compact as C
from stratalog.operators import files as FS
from stratalog.operators import records as R
from stratalog.operators import resolve as M
from stratalog.operators import scan as S
from stratalog.operators import stats as A
from stratalog.operators import write as WR
from stratalog.streaming import changelog

SHAPE = "user_key binary, seq long, vtype int, value binary"


def log_of(spark, ops):
    """Rows from (key, value) puts and (key, None) deletes, seq by place from 1."""
    return spark.createDataFrame([(k, i + 1, 0 if v is None else 1, v) for i, (k, v) in enumerate(ops)], SHAPE)


def state(df):
    return {bytes(r.user_key): bytes(r.value) for r in df.collect()}


@pytest.mark.parametrize(
    ("ops", "want"),
    [
        ([(b"foo", b"v1"), (b"bar", b"v2"), (b"foo", b"v3")], {b"foo": b"v3", b"bar": b"v2"}),
        ([(b"foo", b"v1"), (b"foo", b"v2"), (b"foo", None)], {}),
        ([(b"", b"v1"), (b"", b"v2")], {b"": b"v2"}),
        ([(b"key", b"v1"), (b"key", b"")], {b"key": b""}),
        ([(b"b", b"x"), (b"b", None), (b"a", None), (b"a", None), (b"a", b"v")], {b"a": b"v"}),
        ([(b"foo", b"hello"), (b"bar", b"b"), (b"box", b"c"), (b"bar", None)], {b"foo": b"hello", b"box": b"c"}),
    ],
)
def test_live_state(spark, ops, want):
    log = log_of(spark, ops)
    assert state(M.live(log)) == want
    assert state(M.newest_by_rank(log).where("vtype = 1")) == want


def test_snapshots_stay(spark):
    log = log_of(spark, [(b"foo", b"v1"), (b"foo", b"v2"), (b"foo", b"v3"), (b"foo", b"v4")])
    assert [state(M.live(log, s)) for s in (0, 1, 2, 3)] == [{}, {b"foo": b"v1"}, {b"foo": b"v2"}, {b"foo": b"v3"}]
    snaps = spark.createDataFrame([(i, i) for i in range(5)], "snap_id long, seq long")
    assert {(r.snap_id, bytes(r.value)) for r in M.at_snapshots(log, snaps).collect()} == {(1, b"v1"), (2, b"v2"), (3, b"v3"), (4, b"v4")}


def test_value_beats_deletion_at_equal_seq(spark):
    log = spark.createDataFrame([(b"a", 1, 0, None), (b"a", 1, 1, b"v")], SHAPE)
    assert state(M.live(log)) == state(M.newest_by_rank(log).where("vtype = 1")) == {b"a": b"v"}


def test_seek_and_order(spark):
    log = log_of(spark, [(k, k) for k in (b"a", b"b", b"c", b"\xff\xff", b"abc", b"abcd", b"ac")])
    first = lambda t: [bytes(r.user_key) for r in S.seek(log, F.lit(t)).collect()]
    assert [first(t) for t in (b"", b"a", b"ax", b"b", b"z", b"\xff\xff\xff")] == [[b"a"], [b"a"], [b"b"], [b"b"], [b"\xff\xff"], []]
    fwd = [bytes(r.user_key) for r in S.forward(log).collect()]
    assert fwd == [b"a", b"abc", b"abcd", b"ac", b"b", b"c", b"\xff\xff"]
    assert [bytes(r.user_key) for r in S.reverse(log).collect()] == fwd[::-1]


def test_random_model(spark):
    rng, model, ops = random.Random(7), {}, []
    keys = [bytes(rng.choices(b"\x00\x01abcde\xfd\xfe\xff", k=rng.randrange(4))) for _ in range(40)]
    held, at = {}, 0
    for i in range(600):
        k = rng.choice(keys)
        if rng.random() < 0.5:
            v = b"%d" % i
            model[k] = v
            ops.append((k, v))
        else:
            model.pop(k, None)
            ops.append((k, None))
        if i == 300:
            held, at = dict(model), len(ops)
    log = log_of(spark, ops).withColumn("level", F.when(F.col("seq") < 300, 2).when(F.col("seq") < 480, 1).otherwise(0)).withColumn("file_no", F.floor(F.col("seq") / 100)).cache()
    assert state(M.live(log)) == model
    assert state(M.newest_by_level(log).where("vtype = 1")) == model
    assert state(M.live(log, at)) == held
    kept = C.drop_shadowed(log, at)
    assert kept.count() < log.count()
    for s in (at, at + 50, 600):
        assert state(M.live(kept, s)) == state(M.live(log, s))


def test_lookup_status(spark):
    log = log_of(spark, [(b"a", b"1"), (b"b", b"2"), (b"b", None)])
    keys = spark.createDataFrame([(b"a",), (b"b",), (b"c",)], "user_key binary")
    assert {bytes(r.user_key): r.status for r in M.lookup(keys, log).collect()} == {b"a": "FOUND", b"b": "DELETED", b"c": "NOT_FOUND"}
    assert {bytes(r.user_key) for r in M.missing(keys, log).collect()} == {b"b", b"c"}


def test_compaction_keeps_what_snapshots_see(spark):
    log = log_of(spark, [(b"foo", b"big"), (b"foo", b"tiny")])
    assert C.drop_shadowed(log, 2).count() == 1
    assert C.drop_shadowed(log, 1).count() == 2


def test_markers_stay_over_deeper_files(spark):
    log = spark.createDataFrame([(b"foo", 5, 0, None)], SHAPE)
    deep = spark.createDataFrame([(b"a", b"z")], "smallest_key binary, largest_key binary")
    assert C.drop_markers(log, 9, deep).count() == 1
    assert C.drop_markers(log, 9, deep.limit(0)).count() == 0
    assert C.drop_markers(log, 4, deep.limit(0)).count() == 1


def test_batches(spark):
    rows = spark.createDataFrame([(100, [(1, b"foo", b"bar"), (0, b"box", None), (1, b"baz", b"boo")])], "base_seq long, ops array<struct<vtype:int,user_key:binary,value:binary>>")
    assert [(bytes(r.user_key), r.seq, r.vtype) for r in WR.explode_batches(rows).orderBy("seq").collect()] == [(b"foo", 100, 1), (b"box", 101, 0), (b"baz", 102, 1)]
    bad = rows.withColumn("count", F.lit(2))
    assert [r.problem for r in WR.batch_problems(bad).collect()] == ["WRONG_COUNT"]


def test_group_commit_limits(spark):
    w = spark.createDataFrame([(1, i, s, y) for i, (s, y) in enumerate([(10, False), (20, False), (200_000, False), (5, True), (900_000, False)])], "queue long, op_idx long, size long, sync boolean")
    assert [r.commit_group for r in WR.group_commit(w).orderBy("op_idx").collect()] == [0, 0, 1, 2, 3]


def test_find_file(spark):
    f = spark.createDataFrame([(200, 0), (250, 1), (350, 2), (450, 3)], "largest_key long, file_no long")
    keys = [100, 150, 200, 201, 250, 251, 300, 350, 351, 450, 451]
    got = {r.user_key: r.file_no for r in FS.find_file(f, spark.createDataFrame([(k,) for k in keys], "user_key long")).collect()}
    assert [got[k] for k in keys] == [0, 0, 0, 1, 1, 2, 2, 2, 3, 3, None]


def test_overlap_with_open_bounds(spark):
    f = spark.createDataFrame([(1, 0, 150, 200), (1, 1, 200, 250), (1, 2, 300, 350), (1, 3, 400, 450)], "level int, file_no long, smallest_key long, largest_key long")
    asked = [(100, 149), (251, 299), (451, 500), (351, 399), (100, 150), (375, 400), (450, 450), (None, 150), (450, None), (None, None)]
    r = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(asked)], "range_id int, start long, limit long")
    assert sorted({x.range_id for x in FS.overlapping(f, r).collect()}) == [4, 5, 6, 7, 8, 9]


def test_expanding_range_and_boundaries(spark):
    shape = "level int, file_no long, file_size long, smallest_key long, smallest_seq long, largest_key long, largest_seq long"
    f = spark.createDataFrame([(0, 1, 1, 10, 9, 20, 8), (0, 2, 1, 18, 7, 40, 6), (0, 3, 1, 39, 5, 60, 4), (0, 4, 1, 90, 3, 99, 2)], shape)
    assert sorted(r.file_no for r in FS.expand_overlapping(f, 5, 12).collect()) == [1, 2, 3]
    b = spark.createDataFrame([(1, 1, 1, 100, 6, 100, 5), (1, 2, 1, 100, 2, 300, 1), (1, 3, 1, 100, 4, 100, 3)], shape)
    assert FS.boundary_inputs(b, [1]) == [1, 3, 2]


def test_outputs_split(spark):
    rows = spark.createDataFrame([(1, i, 40, 10) for i in range(10)], "c int, k int, bytes long, met long")
    assert [r.output for r in C.split_by_size(rows, "c", "k", "bytes", 100).orderBy("k").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert max(r.output for r in C.split_by_size(rows, "c", "k", "bytes", 1000, "met", 25).collect()) > 2


def test_histogram_bounds_and_merge(spark):
    assert len(A.BOUNDS) == 154
    v = spark.createDataFrame([(0.5,), (1.0,), (9.5,), (10.0,), (1e12,)], "v double")
    got = {r.bucket: r.n for r in A.buckets(v).collect()}
    assert got == {0: 1, 1: 1, 9: 1, 10: 1, 153: 1}
    assert {r.bucket: r.n for r in A.merge(A.buckets(v), A.buckets(v)).collect()} == {k: 2 * n for k, n in got.items()}
    assert A.summary(v.limit(0)).first().n == 0


def test_percentile_is_clamped(spark):
    v = spark.createDataFrame([(5.0,)] * 10, "v double")
    assert [r.value for r in A.percentile(v, [1, 50, 99]).orderBy("p").collect()] == [5.0, 5.0, 5.0]


def test_acknowledged_run(spark):
    ids = spark.createDataFrame([(i,) for i in (0, 1, 2, 4, 5)], "id long")
    assert R.acknowledged(ids).first().last_ack == 2
    assert R.acknowledged(ids.where("id > 0")).first().last_ack == -1


def test_read_cache(spark):
    reads = spark.createDataFrame([(i, 1, "k") for i in range(5)], "op_id long, file_no long, user_key string")
    assert [r.served for r in C.read_cache(reads).orderBy("op_id").collect()] == [False, False, True, True, True]


def test_late_rows_do_not_overwrite(spark, tmp_path):
    src = str(tmp_path / "in")
    for i, rows in enumerate(([(b"a", 5, 1, b"new")], [(b"a", 3, 1, b"old"), (b"b", 4, 1, b"x")], [(b"b", 6, 0, None)])):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(src)
        del i
    stream = changelog.read_log_stream(spark, src, spark.read.parquet(src).schema)
    changelog.to_memory(changelog.current_state(stream), "current_state", str(tmp_path / "ck")).awaitTermination(120)
    got = {bytes(r.user_key): (r.seq, r.vtype) for r in spark.table("current_state").collect()}
    assert got == {b"a": (5, 1), b"b": (6, 0)}


def test_levels_are_pruned(spark, tmp_path):
    from stratalog.sources import levels

    log = spark.range(1000).select(F.col("id").alias("user_key"), F.col("id").alias("seq"), F.lit(1).alias("vtype"), F.lit(1.0).alias("value"), (F.col("id") % 6).cast("int").alias("level"), F.lit(1).alias("file_no"))
    where = str(tmp_path / "levels")
    levels.write_levels(log, where)
    got = levels.read_level(spark, where, level=5, start=100, limit=200)
    assert got.count() == log.where("level = 5 and user_key >= 100 and user_key < 200").count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan and "PushedFilters: [IsNotNull(user_key), GreaterThanOrEqual(user_key,100), LessThan(user_key,200)]" in plan
    assert levels.read_level(spark, where, tier="SSD").select("level").distinct().count() == 2


def test_appended_batches(spark):
    shape = "batch_id long, op_idx int, vtype int, user_key binary, value binary"
    a = spark.createDataFrame([(1, 0, 1, b"a", b"va"), (1, 1, 1, b"b", b"vb")], shape)
    b = spark.createDataFrame([(1, 0, 0, b"a", None), (2, 0, 1, b"c", b"vc")], shape)
    got = [(r.batch_id, r.op_idx, r.vtype, bytes(r.user_key)) for r in WR.append_batches(a, b).orderBy("batch_id", "op_idx").collect()]
    assert got == [(1, 0, 1, b"a"), (1, 1, 1, b"b"), (1, 2, 0, b"a"), (2, 0, 1, b"c")]
    assert WR.append_batches(a.limit(0), b).count() == 2
    assert {r.batch_id: r.bytes for r in WR.approximate_batch_size(a).collect()} == {1: 12 + 2 * (1 + 2 + 3)}
