"""Exact Jaccard self-join of word-shingle sets by signature trees.

Equal sets are one *entry*.  An entry has its size and a bitmap of its shingles;
a tree node has the OR of its entries' bitmaps and their size range.  Two entries
can only link if they share a shingle among their rarest ones (prefix filter), so
the dual traversal starts at the pairs of roots that do, instead of at all pairs:

1. every entry is compared with two pivots of the shingle buckets it shares most: the
   most central entry, whose rare shingles most others share (in a group of copies the
   one with the fewest changes), and the one with the largest hash; links make clusters;
2. a cluster is the root of a tree, cut into nodes of about ``LEAVES`` entries;
   pairs of roots, then nodes, then entries are dropped by the largest overlap that
   the places of shared shingles, size ranges and bitmaps allow;
3. the pairs that are left are compared shingle by shingle.

Pairs inside a cluster are never visited: they are connected already.  All bounds
are upper bounds, so no link between entries of different clusters is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.plans.scratch import cut

from .graph import components
from .textkit import pieces, row_key, shingles, text_bytes, words

#: Cells of the frequency sketch, a fixed number.  It only orders shingles, so sharing a cell costs time, not results.
SKETCH_BITS = 20
#: Bits of the filter that spares most texts the shuffle, a fixed number; false hits are dropped by the join after it.
FILTER_BITS = 23
SEGMENTS = 16
LEAVES = 256


def need(a, b, percent: int):
    """Least shared shingles with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit per cell, in at least four times as many cells as there are shingles."""
    size = max(64, 1 << int(4 * len(hashes) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap as 64-bit words, folded to ``size`` words."""
    x = np.frombuffer(bits, np.uint64)
    return np.bitwise_or.reduce(x.reshape(-1, size), axis=0) if len(x) > size else x


def sets_of(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Row number and sorted distinct shingle hashes of the rows of a text column, piece by piece."""
    data, offsets = text_bytes(column)
    for lo, hi in pieces(offsets):
        part = offsets[lo : hi + 1]
        h, row = shingles(words(data[part[0] : part[-1]], part - part[0]), size)
        cuts = np.searchsorted(row, np.arange(hi - lo + 1))
        yield lo, [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def set_key(hashes: np.ndarray) -> int:
    """A 64-bit key of a set."""
    x = hashes * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return int((x ^ (x >> np.uint64(29))).sum(dtype=np.uint64) ^ np.uint64(len(hashes))) - (1 << 63)


def _segments(counts: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.split(counts, SEGMENTS)]


def _merged(rows: DataFrame, dtype, how: str) -> np.ndarray:
    """Adds or ORs the tasks' arrays of one fixed length, each in ``SEGMENTS`` pieces, and fetches the one result."""

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(batch.schema.get_field_index("data")):
                part = np.frombuffer(x.as_buffer(), dtype)
                total = part.copy() if total is None else (np.add if how == "add" else np.bitwise_or)(total, part, out=total)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["seg", "data"])

    got = rows.groupBy("seg").applyInArrow(merge, "seg int, data binary").collect()
    by = {r["seg"]: np.frombuffer(r["data"], dtype) for r in got}
    return np.concatenate([by[i] for i in range(SEGMENTS)]) if by else np.zeros(1, dtype)


def _scanned(docs: DataFrame, size: int) -> DataFrame:
    """(key, doc_id, n, entry, bits) of every row, and the frequency sketch of each task as rows (seg, data)."""
    slim = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType.fromDDL("key long, n long, entry long, bits binary, seg int, data binary").add("doc_id", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        seen: set[int] = set()
        ids = None
        for batch in batches:
            ids = batch.schema.field("doc_id").type
            for lo, sets in sets_of(batch.column(2), size):
                entry = [set_key(s) if len(s) else None for s in sets]
                fresh = []
                for e, s in zip(entry, sets):
                    if e is not None and e not in seen:
                        seen.add(e)
                        fresh.append(s)
                if fresh:
                    np.add.at(sketch, (np.concatenate(fresh) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                part = batch.slice(lo, len(sets))
                none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
                bits = [bitmap(s) if len(s) else None for s in sets]
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(entry, pa.int64()), pa.array(bits, pa.binary()), *none, part.column(1)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        if seen:
            rest = [pa.nulls(SEGMENTS, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            columns = [*rest, pa.array(range(SEGMENTS), pa.int32()), pa.array(_segments(sketch), pa.binary()), pa.nulls(SEGMENTS, ids)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return slim.mapInArrow(run, schema)


def _prefixes(docs: DataFrame, sketch: np.ndarray, size: int, percent: int) -> DataFrame:
    """(token, entry, pos): the rarest shingles of each entry and their places in the common order, once in a task."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = shared.value, set()
        for batch in batches:
            for _, sets in sets_of(batch.column(0), size):
                tokens, entries, places = [], [], []
                for s in sets:
                    if not len(s) or (e := set_key(s)) in seen:
                        continue
                    seen.add(e)
                    order = np.lexsort((s, count[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                    tokens.append(s[order[: prefix_length(len(s), percent)]])
                    entries.append(np.full(len(tokens[-1]), e, np.int64))
                    places.append(np.arange(len(tokens[-1]), dtype=np.int32))
                if tokens:
                    arrays = [np.concatenate(tokens).view(np.int64), np.concatenate(entries), np.concatenate(places)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["token", "entry", "pos"])

    return docs.select("text").mapInArrow(run, "token long, entry long, pos int")


def _possible(percent: int):
    """Keeps pairs of entries whose sizes and bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "n_a", "n_b", "bits_a", "bits_b"))
            keep = [
                _fits(p.as_py(), q.as_py(), np.frombuffer(u.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint64), percent)
                for p, q, u, v in zip(na, nb, x, y)
            ]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _fits(na: int, nb: int, x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    if len(x) > len(y):
        x, y, na, nb = y, x, nb, na
    if len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    spare = min(na - int(np.bitwise_count(x).sum()), nb - int(np.bitwise_count(y).sum()))
    return spare + int(np.bitwise_count(x & y).sum()) >= need(na, nb, percent)


def _leaf_pairs(percent: int):
    """Descends from two tree nodes to the pairs of entries that may link."""

    def descend(one: dict, two: dict) -> Iterator[tuple[int, int]]:
        size = min(min(map(len, one["bits"])), min(map(len, two["bits"]))) // 8
        x, y = (np.stack([folded(b, size) for b in side["bits"]]) for side in (one, two))
        na, nb = np.array(one["n"]), np.array(two["n"])
        stack = [(np.argsort(na, kind="stable"), np.argsort(nb, kind="stable"))]
        while stack:
            i, j = stack.pop()
            if 100 * na[i[-1]] < percent * nb[j[0]] or 100 * nb[j[-1]] < percent * na[i[0]]:
                continue
            if len(i) * len(j) <= 64:
                ones = np.bitwise_count(y[j]).sum(axis=1).astype(np.int64)
                for p in i:
                    both = np.bitwise_count(x[p] & y[j]).sum(axis=1).astype(np.int64)
                    most = np.minimum(na[p] - int(np.bitwise_count(x[p]).sum()), nb[j] - ones) + both
                    ok = (most >= need(na[p], nb[j], percent)) & (100 * np.minimum(na[p], nb[j]) >= percent * np.maximum(na[p], nb[j]))
                    yield from ((one["entry"][p], two["entry"][q]) for q in j[ok])
                continue
            ors = np.bitwise_or.reduce(x[i], axis=0) & np.bitwise_or.reduce(y[j], axis=0)
            slack = max(int((na[i] - np.bitwise_count(x[i]).sum(axis=1)).max()), int((nb[j] - np.bitwise_count(y[j]).sum(axis=1)).max()))
            if slack + int(np.bitwise_count(ors).sum()) < need(int(na[i[0]]), int(nb[j[0]]), percent):
                continue
            if len(i) >= len(j):
                stack += [(i[: len(i) // 2], j), (i[len(i) // 2 :], j)]
            else:
                stack += [(i, j[: len(j) // 2]), (i, j[len(j) // 2 :])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p for one, two in zip(batch.column(0), batch.column(1)) for p in descend(one.as_py(), two.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _key_filter(keys: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, np.uint8)
        for batch in batches:
            bits[batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) & ((1 << FILTER_BITS) - 1)] = 1
        yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array(_segments(np.packbits(bits)), pa.binary())], names=["seg", "data"])

    return _merged(keys.coalesce(8).mapInArrow(run, "seg int, data binary"), np.uint8, "or")


def _entry_sets(docs: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """(entry, set) for the rows with these keys, one row an entry."""
    shared = docs.sparkSession.sparkContext.broadcast(_key_filter(keys))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value) if len(shared.value) > 1 else np.zeros(1 << FILTER_BITS, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False) & ((1 << FILTER_BITS) - 1)
            yield batch.filter(pa.array(bits[at] == 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in sets_of(batch.column(1), size):
                arrays = [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["entry", "set"])

    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "text").mapInArrow(sift, "key long, text string")
    one = texts.join(keys, "key").dropDuplicates(["key"]).select("key", "text")
    return one.mapInArrow(run, "entry long, set binary")


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(batch.schema.get_field_index("set_a")), batch.column(batch.schema.get_field_index("set_b"))
            keep = []
            for u, v in zip(x, y):
                a, b = np.frombuffer(u.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                same = int((b[at] == a).sum())
                keep.append(100 * same >= percent * (len(a) + len(b) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of entries that link by their whole sets."""
    pairs = cut(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("entry")).distinct()
    keys = cut(rows.join(wanted, "entry").groupBy("entry").agg(F.min("key").alias("key")).select("key"), "keys")
    sets = cut(_entry_sets(docs, keys, size), "sets")
    both = _with_both(pairs, sets, ["set"])
    return cut(both.mapInArrow(_linked(percent), "a long, b long"), "links")


def _with_both(pairs: DataFrame, entries: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the columns of both ends, as ``column_a`` and ``column_b``."""
    for end in ("a", "b"):
        pairs = pairs.join(entries.select(F.col("entry").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
    return pairs


def _traversed(buckets: DataFrame, entries: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Pairs of entries of different clusters that may link: dual traversal from pairs of roots.

    Roots meet at a shared rare shingle.  Two linked sets have all they share from
    the first such shingle on, so both must have ``need`` shingles left there.
    """
    member = entries.join(clusters.select(F.col("node").alias("entry"), "component"), "entry", "left").withColumn("root", F.coalesce("component", "entry")).drop("component")
    member = cut(member, "members")
    root = member.groupBy("root").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left = (F.col("n") - F.col("pos")).alias("left")
    held = buckets.select("token", "entry", "pos").join(member.select("entry", "root", "n"), "entry").select("token", "root", left)
    held = held.groupBy("token", "root").agg(F.max("left").alias("left"))
    mixed = held.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("token")
    held = cut(held.join(mixed, "token").join(root, "root"), "held")
    other = held.select("token", *(F.col(c).alias(f"{c}_b") for c in ("root", "low", "high", "left")))
    sizes = (100 * F.col("high") >= percent * F.col("low_b")) & (100 * F.col("high_b") >= percent * F.col("low"))
    enough = (100 + percent) * F.least("left", "left_b") >= percent * (F.col("low") + F.col("low_b"))
    meet = held.join(other, "token").where((F.col("root") < F.col("root_b")) & sizes & enough)
    pairs = cut(meet.select("root", "root_b").distinct(), "roots")
    used = pairs.select(F.explode(F.array("root", "root_b")).alias("root")).distinct()
    used = member.join(used, "root").groupBy("root").agg(F.ceil(F.count("*") / LEAVES).alias("slots"))
    leaves = member.join(used, "root").withColumn("slot", F.pmod(F.xxhash64("entry"), F.col("slots")))
    nodes = leaves.groupBy("root", "slot").agg(F.collect_list(F.struct("entry", "n", "bits")).alias("m"))
    node = nodes.select("root", F.struct(F.col("m.entry").alias("entry"), F.col("m.n").alias("n"), F.col("m.bits").alias("bits")).alias("node"))
    down = pairs.join(node.withColumnRenamed("node", "one"), "root").join(node.select(F.col("root").alias("root_b"), F.col("node").alias("two")), "root_b")
    fits = (100 * F.array_max("one.n") >= percent * F.array_min("two.n")) & (100 * F.array_max("two.n") >= percent * F.array_min("one.n"))
    return down.where(fits).select("one", "two").mapInArrow(_leaf_pairs(percent), "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs without white space, A-Z lower-cased; a set holds the distinct
    shingles of ``size`` words, or the whole sequence where there are fewer words.
    Rows link where 100 * intersection >= percent * union; ``component_id`` is the
    smallest doc_id that links reach, the row's own included.  A null, empty or
    blank text has no shingles and is linked with nothing.  Null ids take part in
    links but are never the smallest unless there is no other; repeated rows are
    copies of each other.  An empty table gives no rows.
    """
    grouped = cut(row_components(docs, size, percent).drop("key"), "grouped")
    smallest = grouped.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = grouped.join(smallest, "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def row_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(key, doc_id, n, component) of every row of ``docs``, linked as by ``jaccard_components``.

    ``key`` is ``textkit.row_key``, ``n`` the number of shingles; ``component`` tells
    groups apart whatever their ids are, and is null where there is no shingle.
    """
    docs = docs.select("doc_id", "text")
    scanned = cut(_scanned(docs, size), "scanned")
    sketch = _merged(scanned.where("seg is not null").select("seg", "data"), np.int32, "add")
    rows = scanned.where("seg is null").drop("seg", "data")
    buckets = rows.limit(0).select(F.col("key").alias("token"), "entry", F.lit(0).alias("pos"), F.col("key").alias("hi"), F.col("key").alias("size"))
    if len(sketch) > 1:
        tokens = cut(_prefixes(docs, sketch, size, percent), "tokens")
        several = tokens.groupBy("token").agg(F.min("entry").alias("lo"), F.max("entry").alias("hi"), F.count("*").alias("size")).where("lo < hi")
        buckets = cut(tokens.join(several.drop("lo"), "token"), "buckets")
    held = rows.where("entry is not null").groupBy("entry").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    entries = cut(held.join(buckets.select("entry").distinct(), "entry"), "entries")

    central = buckets.groupBy("entry").agg(F.sum("size").alias("s")).join(entries, "entry").select("entry", (F.col("s") / F.col("n")).alias("c"))
    hubs = buckets.join(central, "entry").groupBy("token").agg(F.max(F.struct("c", "entry"))["entry"].alias("hub"))
    most = lambda df, p: df.where(F.col("entry") != F.col(p)).groupBy("entry", p).count().groupBy("entry").agg(F.max(F.struct("count", p))[p].alias("b"))
    stars = most(buckets.join(hubs, "token"), "hub").unionByName(most(buckets, "hi")).select(F.least("entry", "b").alias("a"), F.greatest("entry", "b").alias("b")).distinct()
    near = _with_both(stars, entries, ["n", "bits"]).mapInArrow(_possible(percent), "a long, b long")
    first = _verified(near, rows, docs, size, percent)
    more = _verified(_traversed(buckets, entries, components(first), percent).distinct(), rows, docs, size, percent)
    label = components(first.unionByName(more)).select(F.col("node").alias("entry"), "component")

    return rows.join(label, "entry", "left").select("key", "doc_id", "n", F.coalesce("component", "entry").alias("component"))
