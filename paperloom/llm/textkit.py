"""Words, shingles and row keys of Arrow text batches as flat numpy arrays.

A batch is handled as the bytes of its column: no Python string is made for a
word.  All hashes depend on the text alone, so they agree between tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 16

#: Bytes of text that are worked on at once; a longer text is a piece of its own.  Hashes, words and shingles of a piece take
#: some thirty times its bytes in every worker.
PIECE_BYTES = 1 << 20


def _powers(base: int) -> np.ndarray:
    out = np.empty(_BLOCK, np.uint64)
    x = 1
    for i in range(_BLOCK):
        out[i] = x
        x = x * base & 0xFFFFFFFFFFFFFFFF
    return out


_UP = _powers(_STEP)
_DOWN = _powers(pow(_STEP, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of unsigned 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span ``data[start:end]``, in one pass over the bytes."""
    n = len(data)
    blocks = -(-n // _BLOCK) or 1
    big_up = pow(_STEP, _BLOCK, 2**64)
    big_down = pow(_STEP, -_BLOCK, 2**64)
    ups = np.array([pow(big_up, i, 2**64) for i in range(blocks + 1)], np.uint64)
    downs = np.array([pow(big_down, i, 2**64) for i in range(blocks + 1)], np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    for b in range(blocks):
        part = data[b * _BLOCK : (b + 1) * _BLOCK]
        sums[b * _BLOCK + 1 : b * _BLOCK + 1 + len(part)] = _BYTE[part] * _UP[: len(part)] * ups[b]
    np.cumsum(sums, out=sums)
    down = downs[starts // _BLOCK] * _DOWN[starts % _BLOCK]
    return mix((sums[ends] - sums[starts]) * down + (ends - starts).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of a batch: hash, byte span, row, and the first word of each row (one more at the end)."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, gaps: np.ndarray = _SPACE) -> Words:
    """Runs of bytes that are no gaps, ``[^\\x20\\x09-\\x0D]+`` unless told otherwise."""
    space = gaps[data]
    gap = np.ones(len(data) + 1, bool)
    gap[1:-1] = space[:-1]
    gap[offsets] = True  # a row ends a word
    solid = ~space
    start = np.flatnonzero(solid & gap[:-1])
    after = np.ones(len(data) + 1, bool)
    after[:-1] = space
    after[offsets] = True
    end = np.flatnonzero(solid & after[1:]) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets)
    return Words(span_hashes(_LOWER[data] if lower else data, start, end), start, end, row, first)


_ROLE = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the row of each; a row with fewer words gives one run of all of them."""
    n = len(w.hash)
    full = max(0, n - size + 1)
    total = np.zeros(full, np.uint64)
    for j in range(size):
        total += w.hash[j : j + full] * _ROLE[j % 64]
    keep = w.row[:full] == w.row[size - 1 : size - 1 + full]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < size))
    extra = np.array(
        [int(sum(int(h) * int(_ROLE[j % 64]) for j, h in enumerate(w.hash[w.first[r] : w.first[r + 1]])) + int(_ROLE[63]) * int(count[r])) % 2**64 for r in short],
        np.uint64,
    )
    hashes = np.concatenate([mix(total[keep]), mix(extra)])
    rows = np.concatenate([w.row[:full][keep], short])
    order = np.argsort(rows, kind="stable")
    return hashes[order], rows[order]


def pieces(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Row ranges of about ``PIECE_BYTES`` each."""
    out, lo = [], 0
    while lo < len(offsets) - 1:
        hi = int(np.searchsorted(offsets, offsets[lo] + PIECE_BYTES, "right")) - 1
        hi = min(max(hi, lo + 1), len(offsets) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def row_key(doc_id: Column, text: Column) -> Column:
    """A key of a row's content: repeated rows share it, rows that only share an id don't."""
    return F.xxhash64(doc_id.cast("string"), text)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves ``part``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
