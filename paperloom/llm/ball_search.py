"""Exact ranked lexical search by ball trees over sparse document vectors.

A document's vector holds an integer for each of its terms that any item holds; its
score for an item is the inner product with the item's integer weights.  Every task
builds trees over pieces of its documents: a node knows the centroid of its
documents and the radius around it, so no document below it scores more than
``weights . centroid + |weights| * radius``.  The bound is computed in doubles and
rounded up by more than all errors of the sum.  Nodes are taken in the order of
their bounds; a tree is left as soon as the best bound is below the item's worst
kept score.  Leaves are scored in 64-bit integers.

Documents are read twice, for the counts and for the search; neither texts nor
vectors are shuffled, only counts of the items' terms and each task's best rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import pieces, text_bytes, words

TOP = 10
#: Bytes of item texts that go with every task at once; more items take several passes.
BLOCK_BYTES = 16 << 20
#: Documents, and entries of their vectors, in one tree; documents of a leaf.
TREE_DOCS, TREE_ENTRIES, LEAF_DOCS = 4096, 2_000_000, 32
#: Subspaces of terms; a ball has a radius in each, so that a bound only feels the terms near the item's own.
SPACES = 4096
#: Share by which bounds are raised; rounding errors of a sum of n products are below n * 2**-52 of it.
SLACK = 1e-9
#: Parts of an item's candidates that are ranked apart before all of them.
SALTS = 64

#: Bytes that separate terms: all of ASCII but letters and digits.
GAPS = np.ones(256, bool)
GAPS[0x30:0x3A] = GAPS[0x41:0x5B] = GAPS[0x61:0x7B] = GAPS[0x80:] = False


def terms_of(texts: pa.Array):
    """Hashes of the terms of every text, A-Z lower-cased."""
    return words(*text_bytes(texts), gaps=GAPS)


class Items:
    """The items of one block: their terms, numbered, and how often each item holds them."""

    def __init__(self, rows: pa.Table):
        self.ids, self.copies = rows.column("item_id").combine_chunks(), rows.column("copies").to_numpy()
        w = terms_of(rows.column("text"))
        self.vocabulary = np.unique(w.hash)
        number = np.searchsorted(self.vocabulary, w.hash)
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        for a, b in zip(w.first[:-1], w.first[1:]):
            t, n = np.unique(number[a:b], return_counts=True)
            self.terms.append(t)
            self.counts.append(n.astype(np.int64))
        self.coarse = np.bincount((self.vocabulary >> np.uint64(44)).astype(np.int64), minlength=1 << 20) > 0
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are terms of items, and the numbers of these terms."""
        at = np.flatnonzero(self.coarse[(hashes >> np.uint64(44)).astype(np.int64)])
        number = np.searchsorted(self.vocabulary, hashes[at])
        hit = self.vocabulary[np.minimum(number, len(self.vocabulary) - 1)] == hashes[at]
        return at[hit], number[hit]

    def weigh(self, found: dict[int, int], n_docs: int) -> None:
        for t, df in found.items():
            self.weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def frequencies(items: Items, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of a text column: number of the first row, terms of each row, and (row, term, times) of the items' terms."""
    data, offsets = text_bytes(column)
    for lo, hi in pieces(offsets):
        part = offsets[lo : hi + 1]
        w = words(data[part[0] : part[-1]], part - part[0], gaps=GAPS)
        at, number = items.find(w.hash)
        key, times = np.unique(w.row[at] * len(items.vocabulary) + number, return_counts=True)
        yield lo, np.diff(w.first), key // max(1, len(items.vocabulary)), key % max(1, len(items.vocabulary)), times.astype(np.int64)


def _count(shared):
    """(term, number of documents) of a partition; term -1 for documents with a term, -2 for all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, n_docs, n_terms = shared.value, 0, 0
        found = np.zeros(len(items.vocabulary), np.int64)
        for batch in batches:
            for _, n, _, term, _ in frequencies(items, batch.column(0)):
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
                found += np.bincount(term, minlength=len(found))
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[seen, -1, -2]), pa.array(np.r_[found[seen], n_docs, n_terms])], names=["term", "n"])

    return run


@dataclass
class Node:
    """A ball: sorted columns and values of its centroid, sorted subspaces and their radii, and children or rows (first, end)."""

    columns: np.ndarray
    values: np.ndarray
    spaces: np.ndarray
    radii: np.ndarray
    children: tuple[Node, ...] = ()
    rows: tuple[int, int] = (0, 0)


class Tree:
    """A ball tree over some documents' vectors (row by row: terms and integer values)."""

    def __init__(self, size: np.ndarray, term: np.ndarray, value: np.ndarray, weights: np.ndarray):
        self.terms, column = np.unique(term, return_inverse=True)
        # in these units each term counts by the root of its weight, on both sides of the product
        self.scale = np.sqrt(weights[self.terms].astype(np.float64))
        self.space = self.terms % SPACES
        row = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((row, self.space[column]))
        self.leaves: list[tuple[np.ndarray, ...]] = []
        self.root = self._build(np.arange(len(size)), row[order], column[order], value[order])

    def _build(self, rows: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray) -> Node:
        """The ball of ``rows``; entries are sorted by (subspace, row), with rows numbered from 0."""
        n = len(rows)
        x, space = value * self.scale[column], self.space[column]
        centroid = np.bincount(column, x, minlength=len(self.terms)) / n
        held = np.flatnonzero(centroid)
        length = np.bincount(self.space[held], centroid[held] ** 2, minlength=SPACES)  # of the centroid, by subspace
        # squared distance of each row from the centroid in each subspace that it has entries in
        one = np.flatnonzero(np.r_[True, (space[1:] != space[:-1]) | (row[1:] != row[:-1])])
        own, at = space[one], np.add.reduceat(x * (x - 2 * centroid[column]), one)
        each = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        far = np.maximum.reduceat(at, each)
        missing = np.diff(np.r_[each, len(own)]) < n  # some row has no entry there: the centroid's own length
        far = np.where(missing, np.maximum(far, 0), far) + length[own[each]]
        # the squares are large beside their difference: what rounding may take is added
        big = np.maximum.reduceat(np.add.reduceat(x * x, one), each) + length[own[each]]
        node = Node(held, centroid[held], own[each], np.sqrt(np.maximum(far, 0) + SLACK * big) * (1 + SLACK))
        if n <= LEAF_DOCS:
            node.rows = len(self.leaves), n
            order = np.argsort(row, kind="stable")
            self.leaves.append((rows, np.flatnonzero(np.r_[True, np.diff(row[order]) != 0]), column[order], value[order]))
            return node

        def apart(centre: np.ndarray) -> np.ndarray:
            return np.bincount(row, x * (x - 2 * centre[column]), minlength=n)

        def dense(r: int) -> np.ndarray:
            mine = row == r
            return np.bincount(column[mine], x[mine], minlength=len(self.terms))

        first = dense(int(apart(centroid).argmax()))
        second = dense(int(apart(first).argmax()))
        side = np.bincount(row, x * (first - second)[column], minlength=n)
        left = np.zeros(n, bool)
        left[np.argpartition(side, n // 2)[: n // 2]] = True
        number = np.where(left, np.cumsum(left), np.cumsum(~left)) - 1
        mine = left[row]
        node.children = tuple(self._build(rows[k], number[row[e]], column[e], value[e]) for k, e in ((left, mine), (~left, ~mine)))
        return node


class Best:
    """The best documents of each item so far, with integer scores; ties go to the smaller id, null ids last."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * n_items
        self.least = [1] * n_items  # only scores above 0 count
        self.leaves = self.nodes = 0

    def add(self, item: int, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        s, n, d = (np.concatenate(x) for x in zip(self.found[item], (score, null, ids)))
        order = np.lexsort((d, n, -s))[: self.top]
        self.found[item] = s[order], n[order], d[order]
        if len(order) == self.top:
            self.least[item] = int(s[order[-1]])


def matched(sorted_keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted keys, 0 where a key is missing."""
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return values[at] * (sorted_keys[at] == wanted)


def search(tree: Tree, items: Items, null: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Offers the tree's documents to every item."""
    exact = np.zeros(len(tree.terms), np.int64)
    for item, (terms, counts) in enumerate(zip(items.terms, items.counts)):
        at = np.minimum(np.searchsorted(tree.terms, terms), max(0, len(tree.terms) - 1))
        known = tree.terms[at] == terms
        at = at[known]
        if not len(at):
            continue
        exact[at] = counts[known] * items.weights[terms[known]]
        rooted = counts[known] * tree.scale[at]
        spaces, of = np.unique(tree.space[at], return_inverse=True)
        length = np.sqrt(np.bincount(of, rooted * rooted)) * (1 + SLACK)

        def bound(node: Node) -> float:
            inner = float(matched(node.columns, node.values, at) @ rooted)
            return (inner + float(matched(node.spaces, node.radii, spaces) @ length)) * (1 + SLACK) + 1

        heap, order = [(-bound(tree.root), 0, tree.root)], 0
        while heap:
            high, _, node = heapq.heappop(heap)
            if -high < best.least[item]:
                break
            best.nodes += 1
            for child in node.children:
                if (b := min(-high, bound(child))) >= best.least[item]:
                    order += 1
                    heapq.heappush(heap, (-b, order, child))
            if not node.children:
                best.leaves += 1
                rows, start, column, value = tree.leaves[node.rows[0]]
                score = np.add.reduceat(exact[column] * value, start)
                good = score >= best.least[item]
                if good.any():
                    best.add(item, score[good], null[rows[good]], ids[rows[good]])
        exact[at] = 0


def _search(shared, n_docs: int, n_terms: int, top: int, given: T.DataType):
    """The best rows of a partition: number of the item, its id and copies, doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = Best(len(items.terms), top)
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> None:
            if held:
                size, column, value, null, ids = (np.concatenate(x) for x in zip(*held))
                held.clear()
                search(Tree(size, column, value, items.weights), items, null, ids, best)

        for batch in batches:
            ids = batch.column(0)
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for lo, n, row, term, times in frequencies(items, batch.column(1)):
                m = 100 - 75 + 75 * n * n_docs // n_terms if n_terms else n
                value = 1_000_000_000 * times // (1000 * times + 8 * m[row])
                docs, size = np.unique(row, return_counts=True)
                for a in range(0, len(docs), TREE_DOCS):
                    some, count = docs[a : a + TREE_DOCS], size[a : a + TREE_DOCS]
                    x, y = int(size[:a].sum()), int(size[: a + TREE_DOCS].sum())
                    held.append((count, term[x:y], value[x:y], null[lo + some], ids[lo + some]))
                    if sum(len(h[0]) for h in held) >= TREE_DOCS or sum(len(h[1]) for h in held) >= TREE_ENTRIES:
                        flush()
        flush()
        for item, (score, null, ids) in enumerate(best.found):
            if len(score):
                at = pa.array(np.full(len(score), item))
                yield pa.RecordBatch.from_arrays(
                    [at.cast(pa.int32()), items.ids.take(at), pa.array(items.copies[np.full(len(score), item)]), pa.array(ids, mask=null), pa.array(score)],
                    names=["number", "item_id", "copies", "doc_id", "score"],
                )

    return run


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item, best first.

    ``docs`` has doc_id (an integer) and text, ``items`` item_id and text; other columns are ignored.
    Terms are runs of ASCII letters, digits and characters beyond ASCII; only A-Z are
    lower-cased.  Documents of equal score are ranked by doc_id, null ids last; scores
    of 0 are not listed, so items and documents that are null, empty or without a known
    term give no row.  Repeated documents are ranked one by one; every repeated item
    row gets its own list.  Items go through the driver in blocks of about ``block_bytes``;
    each block takes two passes over the documents.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    # equal rows are searched once
    each = items.where("text is not null").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    total = each.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    schema = T.StructType().add("number", "integer").add("item_id", kind).add("copies", "long").add("doc_id", "long").add("score", "long")
    out = spark.createDataFrame([], schema).withColumn("block", F.lit(0))
    for b in range(blocks if total else 0):
        block = Items(each.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow())
        if not len(block.vocabulary):
            continue
        shared = spark.sparkContext.broadcast(block)
        counts = slim.select("text").mapInArrow(_count(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        found = dict(zip(counts.column("term").to_pylist(), counts.column("n").to_pylist()))
        n_docs, n_terms = found.pop(-1, 0), found.pop(-2, 0)
        block.weigh(found, n_docs)
        weighed = spark.sparkContext.broadcast(block)
        out = out.unionByName(slim.mapInArrow(_search(weighed, n_docs, n_terms, top, kind), schema).withColumn("block", F.lit(b)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = out.withColumn("_part", F.spark_partition_id() % SALTS).withColumn("rank", F.row_number().over(W.partitionBy("block", "number", "_part").orderBy(*order)))
    some = some.where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("block", "number").orderBy(*order))).where(F.col("rank") <= top)
    every = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return every.select("item_id", "rank", "doc_id", "score")
