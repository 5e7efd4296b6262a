"""Sweeps and interval joins against all pairs in plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stratalog.operators import compact as C
from stratalog.operators import files as FS
from stratalog.operators import ordered as O
from stratalog.operators import resolve as M


def _case(seed: int):
    r = random.Random(seed)
    files = [(r.randrange(3), i, *sorted((r.randrange(60), r.randrange(60))), r.randrange(1, 900)) for i in range(40)]
    ranges = [(i, r.choice([None, r.randrange(60)]), r.choice([None, r.randrange(60)])) for i in range(25)]
    return files, ranges


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_are_all_pairs(spark, seed):
    files, ranges = _case(seed)
    f = spark.createDataFrame(files, "level long, file_no long, smallest_key long, largest_key long, file_size long")
    r = spark.createDataFrame(ranges + ranges[:2], "range_id long, start long, limit long")
    want = sorted((i, lv, n) for i, s, e in ranges + ranges[:2] for lv, n, lo, hi, _ in files if (s is None or hi >= s) and (e is None or lo <= e))
    assert sorted(tuple(x) for x in FS.overlapping(f, r).collect()) == want
    assert FS.overlapping(f.limit(0), r).count() == 0
    assert FS.overlapping(f, r.limit(0)).count() == 0
    below = {(lv, n): sum(s for l2, _, a, b, s in files if l2 == lv + 1 and a <= hi and b >= lo) for lv, n, lo, hi, _ in files if lv >= 1}
    assert {(x.level, x.file_no): x.overlap_bytes for x in FS.next_level_overlap(f).collect()} == below
    alone = sorted(k for k, v in below.items() if v == 0)
    assert sorted(tuple(x) for x in C.trivial_moves(f, 0).collect()) == alone


def test_many_matches_of_one_range(spark):
    n = 3 * O.STEP + 5
    f = spark.range(n).select(F.lit(1).alias("level"), F.col("id").alias("file_no"), F.col("id").alias("smallest_key"), (F.col("id") + 1).alias("largest_key"))
    r = spark.createDataFrame([(1, None, None), (2, 10, 11)], "range_id long, start long, limit long")
    assert {x.range_id: x.c for x in FS.overlapping(f, r).groupBy("range_id").agg(F.count("*").alias("c")).collect()} == {1: n, 2: 3}


@pytest.mark.parametrize("strict", [False, True])
def test_at_or_after(spark, strict):
    r = random.Random(3)
    marks, points = sorted({r.randrange(0, 300) for _ in range(60)}), list(range(-2, 303))
    m = spark.createDataFrame([(k, k * 10) for k in marks], "at long, n long").select("at", F.struct("at", "n").alias("row"))
    got = {x["at"]: x.hit and x.hit.n for x in O.at_or_after(spark.createDataFrame([(p,) for p in points], "at long"), m, "t", strict).collect()}
    assert got == {p: next((k * 10 for k in marks if k > p or k == p and not strict), None) for p in points}


def test_markers_under_deeper_files(spark):
    r = random.Random(4)
    deep = [(a, a + r.randrange(4)) for a in (r.randrange(100) for _ in range(12))]
    rows = [(k, s, s % 2, 1.0) for s, k in enumerate(r.randrange(110) for _ in range(150))]
    log = spark.createDataFrame(rows, "user_key long, seq long, vtype int, value double")
    d = spark.createDataFrame(deep, "smallest_key long, largest_key long")
    want = sorted(x for x in rows if not (x[2] == 0 and x[1] <= 90 and not any(a <= x[0] <= b for a, b in deep)))
    assert sorted(tuple(x) for x in C.drop_markers(log, 90, d).collect()) == want


@pytest.mark.parametrize("most", [M.SNAPSHOTS, 7])
def test_many_snapshots(spark, most):
    r = random.Random(5)
    rows = [(r.randrange(6), s, r.choice([0, 1, 1]), float(s)) for s in range(120)]
    snaps = [(i, r.randrange(-3, 125)) for i in range(40)]
    want = []
    for i, at in snaps:
        top = {k: (t, v) for k, s, t, v in rows if s <= at}
        want += [(i, k, v) for k, (t, v) in top.items() if t]
    got = M.at_snapshots(spark.createDataFrame(rows, "user_key long, seq long, vtype int, value double"), spark.createDataFrame(snaps, "snap_id long, seq long"), most)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
