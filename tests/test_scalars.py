"""Golden values of scalar functions and byte formats."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.functions import scalar as X
from stratalog.operators import records as R
from stratalog.operators import sketch as K
from stratalog.sources import logfile as LF


@pytest.mark.parametrize(("data", "want"), [(b"", 0xBC9F1D34), (b"\x62", 0xEF1345C4), (b"\xc3\x97", 0x5B663814), (b"\xe2\x99\xa5", 0x323C078F), (b"\xe1\x80\xb9\x32", 0xED21633A)])
def test_hash32(data, want):
    assert X.hash32_bytes(data, 0xBC9F1D34) == want


@pytest.mark.parametrize(("data", "want"), [(bytes(32), 0x8A9136AA), (b"\xff" * 32, 0x62A8AB43), (bytes(range(32)), 0x46DD794E), (bytes(range(31, -1, -1)), 0x113FDB5C)])
def test_crc32c(data, want):
    assert X.crc32c_bytes(data) == want
    assert X.unmask_crc(X.mask_crc(want)) == want != X.mask_crc(want)
    assert X.crc32c_bytes(data[10:], X.crc32c_bytes(data[:10])) == want


def test_varints():
    for i in range(1024):
        n = (i // 32) << (i % 32)
        assert X.read_varint(X.varint_bytes(n)) == (n, len(X.varint_bytes(n)))
    assert X.read_varint(b"\x80") is None
    assert X.read_varint(X.varint_bytes(1 << 33), 32) is None


def test_separators():
    got = [X.short_separator(a, b) for a, b in ((b"foo", b"hello"), (b"foo", b"foobar"), (b"foobar", b"foo"), (b"foo", b"bar"))]
    assert got == [b"g", b"foo", b"foobar", b"foo"]
    assert [X.short_successor(x) for x in (b"foo", b"\xff\xff")] == [b"g", b"\xff\xff"]


def test_fixed_and_tags(spark):
    seqs = [1, 2, 3, 255, 256, 257, 65535, 65536, 65537, 2**32 - 1, 2**32, 2**32 + 1]
    df = spark.createDataFrame([(k, s) for k in (b"", b"k", b"hello") for s in seqs], "k binary, s long")
    ik = X.internal_key(F.col("k"), F.col("s"), F.lit(1))
    key, seq, vtype = X.split_internal_key(F.col("ik"))
    rows = df.withColumn("ik", ik).select("k", "s", key.alias("k2"), seq.alias("s2"), vtype.alias("v2")).collect()
    assert all((bytes(r.k), r.s, 1) == (bytes(r.k2), r.s2, r.v2) for r in rows)
    one = spark.createDataFrame([(0x0807060504030201,)], "n long").select(F.hex(X.fixed64(F.col("n"))).alias("h"), X.from_fixed64(X.fixed64(F.col("n"))).alias("n")).first()
    assert (one.h, one.n) == ("0102030405060708", 0x0807060504030201)


def test_file_names(spark):
    good = {"100.log": ("log", 100), "0.sst": ("table", 0), "0.ldb": ("table", 0), "MANIFEST-7": ("descriptor", 7), "LOG": ("info", 0), "LOG.old": ("info", 0), "CURRENT": ("current", 0), "18446744073709551615.log": ("log", 18446744073709551615)}
    bad = ["", "foo", "foo-dx-100.log", ".log", "CURRENTX", "MANIFEST-", "MANIFEST-3x", "18446744073709551616.log", "100", "100.", "100.lop"]
    df = spark.createDataFrame([(n,) for n in [*good, *bad]], "name string").select("name", X.parse_file_name(F.col("name")).alias("p"))
    got = {r["name"]: (r.p.kind, int(r.p.number)) if r.p else None for r in df.collect()}
    assert got == good | dict.fromkeys(bad)


def test_text_functions(spark):
    one = spark.range(1)
    assert one.select(X.debug_string(F.lit("The \"key\" in 'single quotes'"), F.lit(42), F.lit(1))).first()[0] == "'The \"key\" in 'single quotes'' @ 42 : 1"
    assert X.escape_bytes(b"\x00\x00\x00\x00\x0b a") == "\\x00\\x00\\x00\\x00\\x0b a"
    nums = [one.select(X.decimal_prefix(F.lit(t))).first()[0] for t in ("18446744073709551615x", "18446744073709551616", "x1")]
    assert [None if n is None else int(n) for n in nums] == [18446744073709551615, None, None]
    assert [one.select(X.string_to_bool(F.lit(t))).first()[0] for t in (" TRUE", "0")] == [True, False]
    left, right = X.split_composite(F.lit("a:b:c"))
    assert tuple(one.select(left, right).first()) == ("a", "b:c")
    assert one.select(X.status_text(F.lit("CORRUPTION"), F.lit("x"))).first()[0] == "Corruption: x"


def test_fnv_matches_wrapping_integers(spark):
    def fnv(n):
        h = 0xCBF29CE484222325
        for i in range(8):
            h = ((h ^ (n >> 8 * i & 255)) * 0x100000001B3) & (1 << 64) - 1
        return h

    rows = spark.range(0, 500, 7).select("id", X.unsigned(X.fnv64("id")).alias("h")).collect()
    assert all(int(r.h) == fnv(r.id) for r in rows)


def test_many_hashes_and_nulls(spark):
    """Hashes of all values at once are those of one value each; nulls stay null."""
    values = [b"", b"a", None, b"ab", b"abc", b"abcd", b"abcde", "é中".encode(), bytes(range(256)), b"a"]
    df = spark.createDataFrame([(i, v, 7 + i) for i, v in enumerate(values)], "i int, v binary, n long")
    one = lambda f: [None if v is None else f(v) for v in values]
    rows = df.select("i", X.hash32("v", F.lit(X.BLOOM_SEED)).alias("h"), X.crc32c("v").alias("c"), X.separator("v", "v").alias("s")).orderBy("i").collect()
    assert [r.h for r in rows] == one(lambda v: X.hash32_bytes(v, X.BLOOM_SEED))
    assert [r.c for r in rows] == one(X.crc32c_bytes)
    assert rows[2].s is None
    ns = [0, 1, 127, 128, 300, 1 << 35, (1 << 63) - 1, -1, None]
    got = [r.e for r in spark.createDataFrame([(i, n) for i, n in enumerate(ns)], "i int, n long").select("i", X.varint("n").alias("e")).orderBy("i").collect()]
    assert [None if e is None else bytes(e) for e in got] == [None if n is None else X.varint_bytes(n % (1 << 64)) for n in ns]
    rows = spark.range(-3, 400, 7).select(X.fnv64("id").alias("a"), X.fnv64_of(F.col("id")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_filters():
    assert K.probes(10) == 6
    assert [K.may_match(k, b"") for k in (b"x",)] == [False]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=90_000), max_size=4))
def test_log_round_trip(records):
    assert LF.read_log(LF.write_log(records)) == [(r, "OK") for r in records]


def test_log_damage():
    data = bytearray(LF.write_log([b"a" * 10, b"b" * 40_000, b"c"]))
    data[8] ^= 1
    assert (None, "CORRUPTION") in LF.read_log(bytes(data))
    assert LF.read_log(LF.write_log([b"abc", b"defg"])[:-2]) == [(b"abc", "OK")]


def test_batches_and_edits():
    ops = [(1, b"foo", b"bar"), (0, b"box", None), (1, b"baz", b"boo")]
    data = LF.encode_batch(100, ops)
    assert LF.decode_batch(data) == ([(100 + i, *o) for i, o in enumerate(ops)], "OK")
    assert LF.decode_batch(data[:-1])[1] == "MALFORMED"
    assert LF.decode_batch(data[:5])[1] == "TOO_SMALL"
    edit = {"comparator": "bytewise", "log_number": 5, "next_file": 9, "last_seq": 1 << 40, "pointers": [(1, b"k")], "deleted": [(2, 7)], "added": [(3, 8, 100, b"a", b"z")]}
    assert LF.decode_edit(LF.encode_edit(edit)) == edit


def test_load_logs(spark, tmp_path):
    (tmp_path / "000001.log").write_bytes(LF.write_log([LF.encode_batch(1, [(1, b"a", b"1"), (0, b"b", None)]), b"short"]))
    rows = LF.load_logs(spark, str(tmp_path)).orderBy("record_no", "seq").collect()
    assert [(r.seq, r.vtype, r.status) for r in rows] == [(1, 1, "OK"), (2, 0, "OK"), (None, None, "TOO_SMALL")]


def test_rows_and_choosers(spark):
    row = {"field0": b"x" * 100, "field1": b""}
    assert X.decode_row(X.encode_row(row)) == row
    u = spark.range(1000).select((F.col("id") / 1000).alias("u"))
    n = u.select(R.choose(F.col("u"), R.MIXES["a"]).alias("op")).groupBy("op").count().collect()
    assert {r.op: r["count"] for r in n} == {"read": 500, "update": 500}
    ranks = [r[0] for r in u.select(R.zipf_rank(F.col("u"), 100)).collect()]
    assert ranks == sorted(ranks) and 0 <= min(ranks) and max(ranks) < 100
    assert R.settings({"a": "1"}, {"a": "2", "b": "3"}) == {"a": "2", "b": "3"}
    assert X.lehmer(1, 2) == [16807, 282475249]
