"""Numpy over the bytes of many texts at once: words, their hashes, and slices of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

#: Byte classes: ASCII white space (0x20, 0x09-0x0D), and letters (ASCII letters and all bytes of other characters).
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_batches(spark) -> None:
    """Arrow batches that stay small though single texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, last row + 1, bytes, offsets) of consecutive rows with about `limit` bytes; nulls are empty."""
    col = pc.fill_null(column.cast(pa.large_utf8()), "").cast(pa.large_binary())
    n = len(col)
    if not n:
        return
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        p[0] = 1
        have = np.cumprod(p)
        if n <= 4 * SLICE_BYTES:
            _POWERS[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finalizer of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes whose class is `inside`; no run crosses a document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first[0] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = w[1:]
    ends = np.flatnonzero(w & (~after | np.r_[first[1:-1], True])) + 1
    return starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the byte runs, the same wherever a run stands: differences of one running polynomial sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    b = (LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(b * _powers("up", _PRIME, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers("down", _INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def doc_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The document of each run."""
    return np.searchsorted(offsets, starts, "right") - 1


def text_hash(words: str) -> int:
    """word_hashes() of one word."""
    raw = np.frombuffer(words.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])
