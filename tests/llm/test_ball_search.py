import math
import re
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import ball_search
from paperloom.llm.queries import QUERIES

from .conftest import documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, b in bags:
            m = 100 - 75 + 75 * sum(b.values()) * n_docs // n_terms
            score = 0
            for t in terms(text):
                if t in b:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def run(docs, items, **k):
    return sorted((tuple(r) for r in ball_search.rank_documents(docs, items, **k).collect()), key=str)


@pytest.fixture(scope="module")
def items(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()
    return [(r["item_id"], r["text"]) for r in rows]


@pytest.mark.parametrize("leaf,docs_in_tree,spaces", [(32, 4096, 4096), (1, 50, 4096), (3, 64, 1), (2, 4096, 7)])
def test_documents(spark, items, monkeypatch, leaf, docs_in_tree, spaces):
    """Any leaf, tree and number of subspaces gives the same; with one subspace a node is an ordinary ball."""
    for name, value in (("LEAF_DOCS", leaf), ("TREE_DOCS", docs_in_tree), ("SPACES", spaces)):
        monkeypatch.setattr(ball_search, name, value)
    df = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert run(df.repartition(3), bench) == brute(rows, items)


def test_query_and_blocks(spark, items):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    got = QUERIES["op11_ball_search"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute(rows, items)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert run(documents(spark), bench, block_bytes=300) == want


def test_odd_rows(spark, odd, none):
    """Nulls, empty and very long texts, ties, repeated rows and items, clashing names."""
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [("a", "word1 word2 WORD3"), ("a", "word1 word2 WORD3"), (None, "x 日本"), ("b", None), ("c", ""), ("d", "nothing-known!"), ("e", "A é ß w5x5 w5x5")]
    bench = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in items], "item_id string, text string, score int, rank int, block string")
    assert run(odd, bench) == brute(rows, items)
    assert run(odd.where("text is null"), bench) == [] and run(none, bench) == [] and run(odd, bench.limit(0)) == []


def test_ties_and_copies(spark):
    """Many equal documents: the smallest ids win, wherever they are, and null ids come last."""
    rows = [(i, "alpha beta gamma") for i in range(300, 0, -1)] + [(None, "alpha beta gamma")] * 20 + [(i, "delta") for i in range(500, 560)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = [(1, "beta gamma beta"), (2, "delta alpha")]
    assert run(df, spark.createDataFrame(items, "item_id int, text string")) == brute(rows, items)


def test_bounds_hold():
    """No document of a ball scores more than the bound, and most leaves are left out once ten are found."""
    rng = np.random.default_rng(5)
    size = rng.integers(1, 12, 500)
    term = np.concatenate([np.sort(rng.choice(900, n, replace=False)) for n in size])
    value, weights = rng.integers(1, 10**6, len(term)), rng.integers(1, 9000, 900)
    tree = ball_search.Tree(size, term, value, weights)
    dense = np.zeros((500, 900))
    dense[np.repeat(np.arange(500), size), term] = value
    roots = np.sqrt(weights)

    def check(node, rows):
        x = (dense[rows] * roots)[:, tree.terms]
        centre = np.zeros(len(tree.terms))
        centre[node.columns] = node.values
        for space, radius in zip(node.spaces, node.radii):
            mine = tree.space == space
            assert np.sqrt(((x[:, mine] - centre[mine]) ** 2).sum(axis=1)).max() <= radius
        for child in node.children:
            check(child, below(child))

    def below(node):
        return np.concatenate([below(c) for c in node.children]) if node.children else tree.leaves[node.rows[0]][0]

    assert sorted(below(tree.root)) == list(range(500))
    check(tree.root, below(tree.root))
