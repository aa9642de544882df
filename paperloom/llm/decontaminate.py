"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact weighted-shingle similarity.

Every benchmark item has a 64-bit SimHash of its weighted word shingles.  A
document's windows of exactly an item's length are fingerprinted from running sums
of signed bit weights.  Fingerprints are cut into ``BLOCKS`` blocks: two that differ
in at most ``RADIUS`` bits differ in at most RADIUS / BLOCKS bits of some block, so a
table of the block values near each item finds them all.  What is found is compared
exactly: weights of shared shingles to weights of all shingles, both with repeats.

A window that has less than the least similarity of its weight in shingles of any
items is less similar to each of them, so only the others are fingerprinted; this
loses nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .textkit import pieces, shingles, text_bytes, words

SHINGLE = 5
LEAST = 0.8
RADIUS = 24
BLOCKS = 8
#: Bytes of item texts that go with every task at once; a larger benchmark takes several passes.
BLOCK_BYTES = 16 << 20
_BYTES = np.arange(256, dtype=np.uint8)


def count_words(text: str) -> int:
    return len(words(*text_bytes(pa.array([text]))).hash)


def weighted_shingles(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and weights (bytes of their words) in text order."""
    w = words(*text_bytes(pa.array([text])))
    h, _ = shingles(w, size)
    return h, shingle_weights(w.end - w.start, len(h), size)


def shingle_weights(lengths: np.ndarray, count: int, size: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(count)
    return total[np.minimum(at + size, len(lengths))] - total[at]


def running_bits(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Running sums of the signed weights of each of the 64 bits."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    out = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum((2 * bits - 1) * weight[:, None].astype(np.int32), axis=0, out=out[1:])
    return out


def simhashes(sums: np.ndarray, start: np.ndarray, count: int | np.ndarray) -> np.ndarray:
    """Fingerprints (8 bytes each) of the windows of ``count`` shingles at ``start``."""
    return np.packbits(sums[start + count] - sums[start] > 0, axis=1)


def weighted_bag(h: np.ndarray, weight: np.ndarray) -> tuple[Counter, dict[int, int]]:
    """How often each shingle occurs, and its weight."""
    keys = h.tolist()
    return Counter(keys), dict(zip(keys, weight.tolist()))


def similarity(a: tuple[Counter, dict], b: tuple[Counter, dict]) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    shared = sum(a[1][x] * min(n, b[0][x]) for x, n in a[0].items() if x in b[0])
    every = sum(w[x] * n for bag, w in (a, b) for x, n in bag.items()) - shared
    return shared / every if every else 0.0


@dataclass
class Group:
    """Items of one length and shingle size: fingerprints, tables of near block values, bags."""

    length: int
    prints: np.ndarray
    near: np.ndarray  # BLOCKS x 256 x items
    numbers: list[int]
    bags: list[tuple[Counter, dict]]


class Index:
    """The items of one block of the benchmark."""

    def __init__(self, texts: list[str], size: int = SHINGLE, radius: int = RADIUS):
        self.radius = radius
        by: dict[tuple[int, int], list] = {}
        for number, text in enumerate(texts):
            if n := count_words(text):
                by.setdefault((min(size, n), n), []).append((number, *weighted_shingles(text, min(size, n))))
        self.sizes: dict[int, tuple[np.ndarray, list[Group]]] = {}
        for (k, n), items in sorted(by.items()):
            prints = np.concatenate([simhashes(running_bits(h, w), np.zeros(1, np.int64), len(h)) for _, h, w in items])
            apart = np.bitwise_count(prints.T[:, None, :] ^ _BYTES[None, :, None])
            group = Group(n, prints, apart <= radius // BLOCKS, [x[0] for x in items], [weighted_bag(x[1], x[2]) for x in items])
            known, groups = self.sizes.get(k, (np.zeros(0, np.uint64), []))
            self.sizes[k] = np.unique(np.concatenate([known, *(x[1] for x in items)])), [*groups, group]
        self.coarse = {k: np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=1 << 20) > 0 for k, (h, _) in self.sizes.items()}

    def hits(self, k: int, h: np.ndarray) -> np.ndarray:
        """Places whose shingle is one of an item."""
        known = self.sizes[k][0]
        at = np.flatnonzero(self.coarse[k][(h >> np.uint64(44)).astype(np.int64)])
        return at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]]

    def matches(self, k: int, h: np.ndarray, weight: np.ndarray, n_words: int, hits: np.ndarray, least: float) -> dict[int, tuple]:
        """Best window (similarity, start word, words, differing bits) by item number, of one document's shingles."""
        best: dict[int, tuple] = {}
        groups = self.sizes[k][1]
        reach = max(g.length for g in groups)
        for part in np.split(hits, np.flatnonzero(np.diff(hits) > 2 * reach) + 1):
            lo, hi = max(0, int(part[0]) - reach), min(len(h), int(part[-1]) + reach)
            sums = running_bits(h[lo:hi], weight[lo:hi])
            own, every = np.zeros(hi - lo, np.int64), np.concatenate([[0], np.cumsum(weight[lo:hi])])
            own[part - lo] = weight[part]
            own = np.concatenate([[0], np.cumsum(own)])
            for g in groups:
                count = min(g.length, n_words) - k + 1
                if count < 1:
                    continue
                marks = np.zeros(hi - lo + 2, np.int64)
                np.add.at(marks, np.maximum(part - lo - count + 1, 0), 1)
                np.add.at(marks, part - lo + 1, -1)
                start = np.flatnonzero(np.cumsum(marks)[: max(0, hi - lo - count + 1)] > 0)
                start = start[own[start + count] - own[start] >= least * (1 - 1e-9) * (every[start + count] - every[start])]
                if not len(start):
                    continue
                prints = simhashes(sums, start, count)
                found = np.zeros((len(start), len(g.numbers)), bool)
                for b in range(BLOCKS):
                    found |= g.near[b][prints[:, b]]
                ws, numbers = np.nonzero(found)
                bits = np.bitwise_count(prints[ws] ^ g.prints[numbers]).sum(axis=1)
                near = bits <= self.radius
                for w, i, apart in zip(ws[near], numbers[near], bits[near].tolist()):
                    at = lo + int(start[w])
                    s = similarity(weighted_bag(h[at : at + count], weight[at : at + count]), g.bags[i])
                    if s >= least:
                        new = (s, -at, min(g.length, n_words), apart)
                        best[g.numbers[i]] = max(best.get(g.numbers[i], new), new)
        return {i: (s, -at, n, apart) for i, (s, at, n, apart) in best.items()}


def found_type(item_id: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType().add("item_id", item_id).add("similarity", "double").add("start_word", "long").add("n_words", "long").add("bits_apart", "integer"))


def _scan(index, least: float, text: str, name: str, kind: T.DataType):
    """Adds the matches of every row of a batch with a block's items (index and item ids)."""
    arrow = to_arrow_type(found_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, ids = index.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
            found: list[list[dict]] = [[] for _ in range(len(batch))]
            for lo, hi in pieces(offsets):
                part = offsets[lo : hi + 1]
                w = words(data[part[0] : part[-1]], part - part[0])
                count = np.diff(w.first)
                for k in items.sizes:
                    h, row = shingles(w, k)
                    cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                    places = items.hits(k, h)
                    for r in np.unique(row[places]):
                        if count[r] < k:
                            continue
                        own = slice(cuts[r], cuts[r + 1])
                        lengths = (w.end - w.start)[w.first[r] : w.first[r + 1]]
                        at = places[np.searchsorted(places, cuts[r]) : np.searchsorted(places, cuts[r + 1])] - cuts[r]
                        best = items.matches(k, h[own], shingle_weights(lengths, len(h[own]), k), int(count[r]), at, least)
                        found[lo + r] += [dict(item_id=ids[i], similarity=s, start_word=a, n_words=n, bits_apart=d) for i, (s, a, n, d) in best.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=[*batch.schema.names, name])

    return run


def with_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, size: int = SHINGLE, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """Adds ``leaks``: an array of (item_id, similarity, start_word, n_words, bits_apart), one for each item found.

    Words are runs without white space, A-Z lower-cased; a shingle has ``size``
    words, of an item with fewer all its words.  An item is found where a window of
    its length (the whole text, where that is shorter) has a SimHash within
    ``radius`` bits and a weighted similarity of ``least`` or more; its best window is
    given, of equal ones the first.  Items and texts that are null or have no word
    match nothing; items of equal text or id are found one by one.  Rows are
    handled by themselves and all kept; a column of the name ``leaks`` is replaced.
    The benchmark goes through the driver in blocks of about ``BLOCK_BYTES``.
    """
    spark = docs.sparkSession
    out = docs.drop("leaks")
    items = benchmark.where("text is not null").select("item_id", "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_BYTES)
    parts = []
    kind = benchmark.schema["item_id"].dataType
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        index = spark.sparkContext.broadcast((Index(rows.column("text").to_pylist(), size, radius), rows.column("item_id").to_pylist()))
        name = f"_leaks_{b}"
        out = out.mapInArrow(_scan(index, least, text, name, kind), T.StructType([*out.schema.fields, T.StructField(name, found_type(kind))]))
        parts.append(F.col(name))
    kept = [c for c in docs.columns if c != "leaks"]
    return out.select(*(F.col(f"`{c}`") for c in kept), (F.concat(*parts) if parts else F.array().cast(found_type(kind))).alias("leaks"))
