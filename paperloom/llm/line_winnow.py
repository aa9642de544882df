"""Repeated runs of lines by winnowing over line hashes.

A *gram* is the shortest run of lines from a line on that holds ``gram_words``
words.  Of the grams that start within the next ``gram_words`` words the one with the
least hash is a fingerprint, so any run of lines that two places share contains
the same fingerprint at both, as soon as it is about three grams long; a line of
``gram_words`` words or more is always one.  Fingerprints found at two places mark
their documents; there a match is extended both ways to its last line, and a run of
at least ``least_words`` words is deleted.  For that a *back gram*, the shortest run
of lines up to a line that holds ``gram_words`` words, stands beside the grams: the
lines of a shared run behind its last gram are those of its back grams.  So a line
is covered exactly where it belongs to a run of ``gram_words`` words or more that
occurs at any earlier place.  Only hashes and positions are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.plans.scratch import cut

from .textkit import mix, pieces, row_key, span_hashes, text_bytes, words

GRAM_WORDS = 16
LEAST_WORDS = 50
_NEXT = np.uint64(0x9E3779B97F4A7C15)


def line_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number within the row, words and hash of every line with a word; outer white space doesn't count."""
    w = words(data, offsets, lower=False)
    if not len(w.start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    breaks = np.concatenate([[0], np.cumsum(data == 10)])  # line feeds before a byte
    line = breaks[w.start]
    new = np.r_[True, (line[1:] != line[:-1]) | (w.row[1:] != w.row[:-1])]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(w.start)] - 1
    number = line[at] - breaks[offsets[w.row[at]]]
    return w.row[at], number, last - at + 1, span_hashes(data, w.start[at], w.end[last])


def gram_ends(row: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """For each line the line after its gram, or 0 where the row ends before ``size`` words."""
    total = np.concatenate([[0], np.cumsum(count)])
    end = np.searchsorted(total, total[:-1] + size, "left")
    fits = end <= len(row)
    fits[fits] = row[end[fits] - 1] == row[np.flatnonzero(fits)]
    return np.where(fits, end, 0)


def gram_hashes(hashes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the lines of each gram, in order."""
    out = np.zeros(len(hashes), np.uint64)
    live, j = np.flatnonzero(end > 0), 0
    while len(live):
        out[live] = mix(out[live] * _NEXT + hashes[live + j])
        j += 1
        live = live[live + j < end[live]]
    return out


def back_grams(row: np.ndarray, count: np.ndarray, hashes: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, the line after the last, and hash of the back grams that are not grams themselves."""
    total = np.concatenate([[0], np.cumsum(count)])
    start = np.searchsorted(total, total[1:] - size, "right") - 1  # -1 where fewer words precede
    own = start >= 0
    own[own] = row[start[own]] == row[own]
    stop = np.flatnonzero(own) + 1
    start = start[own]
    other = end[start] != stop
    start, stop = start[other], stop[other]
    out = np.zeros(len(start), np.uint64)
    live, j = np.arange(len(start)), 0
    while len(live):
        out[live] = mix(out[live] * _NEXT + hashes[start[live] + j])
        j += 1
        live = live[start[live] + j < stop[live]]
    return start, stop, mix(out + _NEXT)


def fingerprints(grams: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Lines whose gram is the least of some window: the grams that start within one gram's lines."""
    starts = np.flatnonzero(end > 0)
    best, live, j = starts.copy(), starts, 0
    while len(live):
        at = live + j
        low = (end[at] > 0) & (grams[at] < grams[best[np.searchsorted(starts, live)]])
        best[np.searchsorted(starts, live[low])] = at[low]
        j += 1
        live = live[live + j < end[live]]
    return np.unique(best)


NUMBERS = ("line", "lines", "number", "number_to", "before", "after")


def _positions(size: int):
    """Grams and back grams of rows (key, doc_id, text), and whether they are fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(2))
            for lo, hi in pieces(offsets):
                part = offsets[lo : hi + 1]
                row, number, count, h = line_table(data[part[0] : part[-1]], part - part[0])
                end = gram_ends(row, count, size)
                grams = gram_hashes(h, end)
                at = np.flatnonzero(end > 0)
                chosen = np.zeros(len(grams), bool)
                chosen[fingerprints(grams, end)] = True
                start, stop, back = back_grams(row, count, h, end, size)
                marks = np.concatenate([chosen[at], np.zeros(len(start), bool)])
                prints = np.concatenate([grams[at], back])
                at, to = np.concatenate([at, start]), np.concatenate([end[at], stop])
                first = np.searchsorted(row, row)  # first line of the row
                total = np.concatenate([[0], np.cumsum(count)])
                arrays = [pa.array(prints.view(np.int64)), pa.array(key[lo + row[at]]), batch.column(1).take(pa.array(lo + row[at])), pa.array(marks)]
                extra = [at - first[at], to - at, number[at], number[to - 1], total[at] - total[first[at]], total[to] - total[first[at]]]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(x.astype(np.int32)) for x in extra)], names=["gram", "key", "doc_id", "chosen", *NUMBERS])

    return run


def repeated_runs(docs: DataFrame, gram_words: int = GRAM_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, from_line, to_line, words): the runs to delete, in line numbers of the text, ends included.

    ``key`` is ``textkit.row_key``.  The first place of a gram is that of the smallest
    (doc_id, key, line), null ids last; it stays.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType().add("gram", "long").add("key", "long").add("doc_id", kind).add("chosen", "boolean")
    for name in NUMBERS:
        schema = schema.add(name, "integer")
    slim = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "line")

    grams = cut(slim.mapInArrow(_positions(gram_words), schema), "grams")
    prints = grams.where("chosen").select("gram", "key", "line")
    spots = F.struct("key", "line")
    shared = prints.groupBy("gram").agg(F.min(spots).alias("lo"), F.max(spots).alias("hi")).where("lo < hi").select("gram")
    anchor = cut(prints.join(shared, "gram").select("key", "line").distinct().withColumn("anchor", F.lit(True)), "anchors")
    grams = grams.join(anchor.select("key").distinct(), "key")
    first = grams.groupBy("gram").agg(F.min(place).alias("first"), F.max(place).alias("other")).where("first < other").select("gram", "first")
    again = grams.join(first, "gram").where(F.col("first") != place)
    again = again.join(anchor, ["key", "line"], "left").select("key", *NUMBERS, "anchor")
    # a set, merged before the shuffle: rows that repeat add nothing, and a document's grams are bounded by its text
    runs = again.groupBy("key").agg(F.sort_array(F.collect_set(F.struct(*NUMBERS, "anchor"))).alias("g"))
    return runs.mapInArrow(_islands(least_words), "key long, from_line long, to_line long, words long")


def _islands(least_words: int):
    """Unites the overlapping and adjoining grams of a document; runs that are long enough and hold a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, grams in zip(batch.column(0), batch.column(1)):  # one document at a time: its grams as Python objects are large
                runs: list[list] = []  # end line, first and last line number, words before and after, anchored
                for g in grams.as_py():
                    if runs and g["line"] <= runs[-1][0]:
                        last = runs[-1]
                        if g["line"] + g["lines"] > last[0]:
                            last[0], last[2], last[4] = g["line"] + g["lines"], g["number_to"], g["after"]
                        last[5] |= bool(g["anchor"])
                    else:
                        runs.append([g["line"] + g["lines"], g["number"], g["number_to"], g["before"], g["after"], bool(g["anchor"])])
                out += [(key.as_py(), x[1], x[2], x[4] - x[3]) for x in runs if x[5] and x[4] - x[3] >= least_words]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["key", "from_line", "to_line", "words"])

    return run


def dedup_lines(docs: DataFrame, gram_words: int = GRAM_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """All columns of ``docs`` with the later repeated runs cut out of ``text``; adds n_removed_lines, n_removed_words.

    A line is a \\n-split line, compared without outer white space; lines without a
    word separate nothing and count nothing, and go with a run that encloses them.
    A null text stays null, a text without repeats stays as it is, one that is a
    repeat as a whole becomes empty.  Rows with the same id and text are one
    document: they share its fate, and none of them is a repeat of another.  Every
    row is kept.  Columns of the added names, ``_key`` or ``_cut`` are replaced.
    """
    added = ("n_removed_lines", "n_removed_words", "_key", "_cut")
    columns = [c for c in docs.columns if c not in added]
    runs = repeated_runs(docs, gram_words, least_words).groupBy("key").agg(F.collect_list(F.struct("from_line", "to_line")).alias("_cut"), F.sum("words").alias("n_removed_words"))
    keyed = docs.select(*columns, row_key(F.col("doc_id"), F.col("text")).alias("_key"))
    out = keyed.join(runs.withColumnRenamed("key", "_key"), "_key", "left")
    kept = lambda text: F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.exists("_cut", lambda c: (i >= c["from_line"]) & (i <= c["to_line"]))), "\n")
    gone = F.coalesce(F.aggregate("_cut", F.lit(0).cast("long"), lambda a, c: a + c["to_line"] - c["from_line"] + 1), F.lit(0).cast("long"))
    text = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(kept(F.col("text")))
    return out.select(*((text.alias("text") if c == "text" else F.col(c)) for c in columns), gone.alias("n_removed_lines"), F.coalesce("n_removed_words", F.lit(0).cast("long")).alias("n_removed_words"))
