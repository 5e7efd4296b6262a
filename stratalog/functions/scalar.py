"""Scalar functions: encodings, hashes, keys and names. SQL expressions where these suffice, else vectorized on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hash constants that results depend on.
FNV_BASIS, FNV_PRIME_LOW = -3750763034362895579, 435  # the prime is 2**40 + 435
HASH_M, HASH_R, BLOOM_SEED = 0xC6A4A793, 24, 0xBC9F1D34
CRC_POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
LEHMER_A, LEHMER_M = 16807, 2**31 - 1


def fnv64(id_sql: str) -> Column:
    """64-bit FNV of an integer's eight octets, low first: xor, then multiply, in wrapped signed arithmetic. Lambdas bind the
    steps, so the expression does not grow with the rounds; the product is put together from parts that cannot overflow."""
    product = f"(shiftleft((shiftrightunsigned(x, 32) * {FNV_PRIME_LOW}L + shiftrightunsigned(t, 32) + shiftleft(x & 16777215L, 8)) & 4294967295L, 32) | (t & 4294967295L))"
    multiply = f"aggregate(array((x & 4294967295L) * {FNV_PRIME_LOW}L), 0L, (u, t) -> {product})"
    step = f"aggregate(array(h ^ (shiftrightunsigned({id_sql}, 8 * i) & 255L)), 0L, (z, x) -> {multiply})"
    return F.expr(f"aggregate(sequence(0, 7), {FNV_BASIS}L, (h, i) -> {step})")


def fnv64_of(n: Column) -> Column:
    """fnv64() of a column that has no name, as a lambda's variable."""
    low = F.lit(4294967295).cast("long")
    shift = lambda c, k: F.call_function("shiftrightunsigned", c, k)

    def multiply(x: Column) -> Column:
        high = lambda t: (shift(x, F.lit(32)) * FNV_PRIME_LOW + shift(t, F.lit(32)) + F.shiftleft(x.bitwiseAND(F.lit(16777215).cast("long")), 8)).bitwiseAND(low)
        product = lambda t: F.shiftleft(high(t), 32).bitwiseOR(t.bitwiseAND(low))
        return F.aggregate(F.array(x.bitwiseAND(low) * FNV_PRIME_LOW), F.lit(0).cast("long"), lambda _, t: product(t))

    octet = lambda i: shift(n, i * 8).bitwiseAND(F.lit(255).cast("long"))
    step = lambda h, i: F.aggregate(F.array(h.bitwiseXOR(octet(i))), F.lit(0).cast("long"), lambda _, x: multiply(x))
    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(FNV_BASIS).cast("long"), step)


def unsigned(c: Column) -> Column:
    """A signed 64-bit value read as unsigned."""
    d = c.cast("decimal(20,0)")
    return F.when(c < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def key_name(number: Column, width: int = 1) -> Column:
    text = number.cast("string")
    return F.concat(F.lit("user"), F.lpad(text, F.greatest(F.length(text), F.lit(width)), "0"))


def bench_key(number: Column, width: int = 16) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def pack_tag(seq: Column, vtype: Column) -> Column:
    return seq * 256 + vtype


def unpack_tag(tag: Column) -> tuple[Column, Column]:
    return F.shiftright(tag, 8), tag.bitwiseAND(F.lit(255))


def fixed64(n: Column) -> Column:
    """Little-endian 8 bytes."""
    return F.unhex(F.concat(*[F.substring(F.lpad(F.hex(n), 16, "0"), 15 - 2 * i, 2) for i in range(8)]))


def from_fixed64(b: Column) -> Column:
    swapped = F.concat(*[F.substring(F.hex(b), 15 - 2 * i, 2) for i in range(8)])
    return F.conv(swapped, 16, -10).cast("long")


def varint(n: str) -> Column:
    """A 64-bit number (a column's name) as a variable-length integer: seven bits a byte, low first, the top bit set on all
    but the last; a negative number is read as unsigned. Null stays null."""
    low = "shiftrightunsigned({0}, 7 * i) & 127".format(n)
    length = f"if({n} < 0, 10, greatest(1, ceil(length(regexp_replace(bin({n}), '^0+(?=.)', '')) / 7)))"
    octet = f"lpad(hex(({low}) + if(i + 1 < {length}, 128, 0)), 2, '0')"
    return F.expr(f"if({n} is null, null, unhex(array_join(transform(sequence(0, cast({length} as int) - 1), i -> {octet}), '')))")


def varint_length(n: Column) -> Column:
    return F.when(n < 0, 10).otherwise(F.greatest(F.lit(1), F.ceil(F.length(F.regexp_replace(F.bin(n), "^0+(?=.)", "")) / 7))).cast("int")


def internal_key(key: Column, seq: Column, vtype: Column) -> Column:
    return F.concat(key, fixed64(pack_tag(seq, vtype)))


def split_internal_key(k: Column) -> tuple[Column, Column, Column]:
    n = F.octet_length(k) - 8
    seq, vtype = unpack_tag(from_fixed64(F.substr(k, n + 1, F.lit(8))))
    return F.substr(k, F.lit(1), n), seq, vtype


def debug_string(key: Column, seq: Column, vtype: Column) -> Column:
    return F.concat(F.lit("'"), key, F.lit("' @ "), seq.cast("string"), F.lit(" : "), vtype.cast("string"))


def file_name(number: Column, kind: str) -> Column:
    text = number.cast("string")
    padded = F.lpad(text, F.greatest(F.length(text), F.lit(6)), "0")
    return F.concat(F.lit("MANIFEST-"), padded) if kind == "MANIFEST" else F.concat(padded, F.lit(f".{kind}"))


def parse_file_name(name: Column) -> Column:
    """struct<kind, number> of a store's file name, or null; numbers are below 2**64."""
    digits = F.regexp_extract(name, r"^(?:MANIFEST-)?([0-9]+)(?:$|\.(?:log|sst|ldb|dbtmp)$)", 1)
    number = F.when(F.length(F.ltrim(F.lit("0"), digits)) <= 20, F.coalesce(F.nullif(digits, F.lit("")), F.lit("0"))).cast("decimal(38,0)")
    kind = (
        F.when(name == "CURRENT", "current").when(name == "LOCK", "lock").when(name.isin("LOG", "LOG.old"), "info")
        .when(name.rlike(r"^MANIFEST-[0-9]+$"), "descriptor").when(name.rlike(r"^[0-9]+\.log$"), "log")
        .when(name.rlike(r"^[0-9]+\.(sst|ldb)$"), "table").when(name.rlike(r"^[0-9]+\.dbtmp$"), "temp")
    )
    fits = number <= F.lit("18446744073709551615").cast("decimal(38,0)")
    return F.when(kind.isNotNull() & fits, F.struct(kind.alias("kind"), number.cast("decimal(20,0)").alias("number")))


def decimal_prefix(text: Column) -> Column:
    """The leading digits as an unsigned 64-bit number, or null without digits or beyond the range."""
    d = F.regexp_extract(text, "^([0-9]+)", 1)
    n = F.when((d != "") & (F.length(F.regexp_replace(d, "^0+(?=.)", "")) <= 20), d).cast("decimal(38,0)")
    return F.when(n <= F.lit("18446744073709551615").cast("decimal(38,0)"), n)


def string_to_bool(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1"), F.lit(True)).when(t.isin("false", "0"), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))


def split_composite(c: Column) -> tuple[Column, Column]:
    """key:field at the first colon."""
    at = F.instr(c, ":")
    return F.substr(c, F.lit(1), at - 1), F.substr(c, at + 1)


def status_text(code: Column, message: Column) -> Column:
    # The prefixes of statuses.
    prefix = F.create_map(*[F.lit(x) for x in ("NOT_FOUND", "NotFound: ", "CORRUPTION", "Corruption: ", "NOT_SUPPORTED", "Not implemented: ", "INVALID_ARGUMENT", "Invalid argument: ", "IO_ERROR", "IO error: ")])
    return F.when(code == "OK", F.lit("OK")).otherwise(F.concat(prefix[code], message))


def hash32_bytes(data: bytes, seed: int) -> int:
    """32-bit multiplicative hash of 4-byte little-endian words, then of the tail."""
    mask = 0xFFFFFFFF
    h, whole = (seed ^ (len(data) * HASH_M)) & mask, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = ((h + int.from_bytes(data[i : i + 4], "little")) * HASH_M) & mask
        h ^= h >> 16
    tail = data[whole:]
    if tail:
        h = ((h + int.from_bytes(tail, "little")) * HASH_M) & mask
        h ^= h >> HASH_R
    return h


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CRC_POLYNOMIAL), t >> 1)
    return t


_CRC = _crc_table().tolist()


def crc32c_bytes(data: bytes, start: int = 0) -> int:
    c = start ^ 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def mask_crc(c: int) -> int:
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def unmask_crc(m: int) -> int:
    r = (m - MASK_DELTA) & 0xFFFFFFFF
    return ((r >> 17) | (r << 15)) & 0xFFFFFFFF


def varint_bytes(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, most_bits: int = 64) -> tuple[int, int] | None:
    """(value, bytes read), or None if the number is cut short or too large."""
    n = 0
    for i, b in enumerate(data[: -(-most_bits // 7)]):
        n |= (b & 127) << 7 * i
        if b < 128:
            return (n, i + 1) if n < 1 << most_bits else None
    return None


def short_separator(start: bytes, limit: bytes) -> bytes:
    """A short string s with start <= s < limit."""
    i = next((i for i, (a, b) in enumerate(zip(start, limit, strict=False)) if a != b), None)
    if i is None or start[i] == 255 or start[i] + 1 >= limit[i]:
        return start
    return start[:i] + bytes([start[i] + 1])


def short_successor(key: bytes) -> bytes:
    """A short string at or after key."""
    i = next((i for i, b in enumerate(key) if b != 255), None)
    return key if i is None else key[:i] + bytes([key[i] + 1])


def escape_bytes(data: bytes) -> str:
    return "".join(chr(b) if 32 <= b <= 126 else f"\\x{b:02x}" for b in data)


def encode_row(fields: dict[str, bytes]) -> bytes:
    """u32 length and bytes of each name and value."""
    parts = [x for k, v in fields.items() for x in (k.encode(), v)]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def decode_row(data: bytes) -> dict[str, bytes]:
    parts, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        parts.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return {k.decode(): v for k, v in zip(parts[::2], parts[1::2], strict=True)}


def lehmer(seed: int, n: int) -> list[int]:
    """n values of the minimal-standard generator."""
    out, x = [], seed & LEHMER_M or 1
    for _ in range(n):
        x = x * LEHMER_A % LEHMER_M
        out.append(x)
    return out


def _by_length(values: list | pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes as a matrix) of the values of each length; nulls are left out. Arrow's binaries are read in place."""
    if isinstance(values, pa.Array) and len(values):
        values = values.cast(pa.binary())
        _, offsets, data = values.buffers()
        start = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        data = np.frombuffer(data or b"", np.uint8)
        n = np.where(values.is_null().to_numpy(zero_copy_only=False), -1, np.diff(start))
        return [(at := np.flatnonzero(n == k), data[start[at][:, None] + np.arange(k)]) for k in np.unique(n[n >= 0])]
    n = np.array([-1 if v is None else len(v) for v in values], np.int64)
    return [(at := np.flatnonzero(n == k), np.frombuffer(b"".join(bytes(values[i]) for i in at), np.uint8).reshape(len(at), int(k))) for k in np.unique(n[n >= 0])]


def hash32_many(values: list | pa.Array, seed) -> np.ndarray:
    """hash32_bytes() of each value (-1 for null), all values of a length at once. seed: one, or one a value."""
    out, seeds = np.full(len(values), -1, np.int64), np.broadcast_to(np.asarray(seed, np.int64), (len(values),))
    for at, data in _by_length(values):
        m, n = np.uint32(HASH_M), data.shape[1]
        h = seeds[at].astype(np.uint32) ^ (np.full(len(at), n, np.uint32) * m)
        for i in range(0, n // 4 * 4, 4):
            h = (h + np.ascontiguousarray(data[:, i : i + 4]).view("<u4")[:, 0]) * m
            h ^= h >> np.uint32(16)
        if n % 4:
            tail = np.zeros((len(at), 4), np.uint8)
            tail[:, : n % 4] = data[:, n // 4 * 4 :]
            h = (h + tail.view("<u4")[:, 0]) * m
            h ^= h >> np.uint32(HASH_R)
        out[at] = h
    return out


def crc32c_many(values: list) -> np.ndarray:
    """crc32c_bytes() of each value (-1 for null), all values of a length at once."""
    out, table = np.full(len(values), -1, np.int64), _crc_table()
    for at, data in _by_length(values):
        c = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for i in range(data.shape[1]):
            c = table[(c ^ data[:, i]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
        out[at] = c ^ np.uint32(0xFFFFFFFF)
    return out


def _told(x: np.ndarray) -> pd.Series:
    return pd.Series(x).astype("Int64").mask(x < 0)


def _each(f, kind: T.DataType):
    return F.pandas_udf(lambda s: pd.Series([None if x is None else f(bytes(x)) for x in s]), kind)


hash32 = F.pandas_udf(lambda s, seed: _told(hash32_many(list(s), seed.fillna(0).to_numpy(np.int64))), T.LongType())
crc32c = F.pandas_udf(lambda s: _told(crc32c_many(list(s))), T.LongType())
escape = _each(escape_bytes, T.StringType())
successor = _each(short_successor, T.BinaryType())
separator = F.pandas_udf(lambda a, b: pd.Series([None if x is None or y is None else short_separator(bytes(x), bytes(y)) for x, y in zip(a, b, strict=True)]), T.BinaryType())
serialize_row = F.pandas_udf(lambda s: pd.Series([encode_row({k: bytes(v) for k, v in (x.items() if isinstance(x, dict) else x)}) for x in s]), T.BinaryType())
deserialize_row = F.pandas_udf(lambda s: pd.Series([decode_row(bytes(x)) for x in s]), T.MapType(T.StringType(), T.BinaryType()))
