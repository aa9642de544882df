"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are made from the bytes of whole Arrow batches.  The trees are complete
binary trees of one depth, kept as flat arrays of features, thresholds and leaf
values, so a batch goes down all trees level by level in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import Words, pieces, row_key, shingles, span_hashes, text_bytes, words

#: Most labelled rows that training reads; of more, those with the least hash of their id; equal rows count once.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2 = 80, 3, 48, 0.15, 2.0
#: Rows that go down the trees at once; a row has a place in every tree.
SCORE_ROWS = 1024

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "symbol": b"#*$%&|<>",
    "exclaim": b"!?",
    "stop": b".,;:",
    "quote": b"\"'()[]{}=/\\@_+-",
    "high": range(128, 256),
    "blank": b" \t\r\v\f",
}
_MATRIX = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES.values()):
    _MATRIX[list(_c), _i] = 1

NAMES = [
    *(f"{c}_share" for c in _CLASSES),
    *"log_words mean_word word_spread distinct_words top_word distinct_pairs distinct_triples upper_words log_lines line_words dup_lines long_words".split(),
]


def _row_stats(hashes: np.ndarray) -> tuple[float, float]:
    """Share of distinct values, and of the most frequent one."""
    if not len(hashes):
        return 1.0, 0.0
    _, count = np.unique(hashes, return_counts=True)
    return len(count) / len(hashes), count.max() / len(hashes)


def _line_stats(data: np.ndarray) -> tuple[float, float]:
    ends = np.r_[np.flatnonzero(data == 10), len(data)]
    starts = np.r_[0, ends[:-1] + 1]
    full = ends > starts
    return float(full.sum()), 1 - _row_stats(span_hashes(data, starts[full], ends[full]))[0]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of numbers (``NAMES``) for each text of a column; null counts as empty."""
    data, offsets = text_bytes(column)
    out = np.zeros((len(offsets) - 1, len(NAMES)))
    for lo, hi in pieces(offsets):
        part = offsets[lo : hi + 1] - offsets[lo]
        raw = data[offsets[lo] : offsets[hi]]
        w: Words = words(raw, part)
        grams = [shingles(w, k) for k in (2, 3)]
        size = (w.end - w.start).astype(float)
        capital = (raw[w.start] >= 65) & (raw[w.start] <= 90)
        for r in range(hi - lo):
            own, n = raw[part[r] : part[r + 1]], int(w.first[r + 1] - w.first[r])
            span = slice(w.first[r], w.first[r + 1])
            shares = np.bincount(own, minlength=256) @ _MATRIX / max(1, len(own))
            distinct, top = _row_stats(w.hash[span])
            more = [_row_stats(h[np.searchsorted(row, r) : np.searchsorted(row, r + 1)])[0] for h, row in grams]
            lines, dup = _line_stats(own)
            mean = size[span].mean() if n else 0.0
            rest = (np.log1p(n), mean, size[span].std() if n else 0.0, distinct, top, *more, capital[span].mean() if n else 0.0, np.log1p(lines), n / max(1, lines), dup, (size[span] > 20).mean() if n else 0.0)
            out[lo + r] = (*shares, *rest)
    return out


@dataclass
class Trees:
    """All trees as arrays: ``feature`` and ``threshold`` (trees, 2^depth - 1), ``leaf`` (trees, 2^depth)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, of ``SCORE_ROWS`` rows at a time."""
        return np.concatenate([np.zeros(0), *(self._score(x[at : at + SCORE_ROWS]) for at in range(0, len(x), SCORE_ROWS))])

    def _score(self, x: np.ndarray) -> np.ndarray:
        """Every row goes down all trees, one level at a time."""
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(self.leaf.shape[1])) if len(trees) else 0):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        margin = self.base + self.leaf[trees, at - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = L2) -> Trees:
    """Boosted trees on log loss; splits are sought among histogram bins of equal counts.

    Without rows, or with one label only, there are no trees and the score is the share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if len(set(y.tolist())) < 2:
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    offset = np.arange(x.shape[1]) * bins
    cells = code + offset
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            flat = ((node - first)[:, None] * (x.shape[1] * bins) + cells).ravel()
            shape = (width, x.shape[1], bins)
            g, h = (np.bincount(flat, np.repeat(v, x.shape[1]), width * x.shape[1] * bins).reshape(shape) for v in (grad, hess))
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i, b in enumerate(best):
                f, cut = divmod(int(b), bins)
                feature[t, first + i] = f
                if gain[i, f, cut] > 1e-9 and cut < len(edges[f]):
                    threshold[t, first + i] = edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        at = node - inner
        g, h = np.bincount(at, grad, inner + 1), np.bincount(at, hess, inner + 1)
        leaf[t] = rate * g / (h + l2)
        margin += leaf[t, at]
    return Trees(base, feature, threshold, leaf)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text") -> Trees:
    """Trees from (doc_id, ``text``) and labels (doc_id, quality 0/1); rows without such a label teach nothing.

    At most ``sample`` different labelled ids are read, and of the rows that bear them at most
    ``sample`` different ones, however often an id or a row repeats.  Only their statistics
    reach the driver, ``sample`` times ``len(NAMES)`` numbers.
    """
    ids = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    h = F.xxhash64(F.col("doc_id").cast("string"))
    ids = ids.orderBy(h, "doc_id", "quality").limit(sample)
    labelled = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(ids), "doc_id").withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    chosen = labelled.select(h.alias("h"), "key", "quality").distinct().orderBy("h", "key", "quality").limit(sample).select("key", "quality")
    rows = labelled.join(F.broadcast(chosen), ["key", "quality"]).groupBy("key", "quality").agg(F.first("text").alias("text")).select("text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [row.tobytes() for row in statistics(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], names=["x", "quality"])

    got = rows.mapInArrow(run, "x binary, quality int").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), float).reshape(-1, len(NAMES))
    y = got.column("quality").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same trees whatever the order of arrival
    return fit(x[order], y[order])


def score(docs: DataFrame, trees: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the score of every row's whole text, an empty or null one included; a column of that name is replaced."""
    kept = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(statistics(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())]))
