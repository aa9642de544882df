import random
import re
from itertools import combinations

import numpy as np
import pytest

from paperloom.llm import ngram_join
from paperloom.llm.graph import components

from .conftest import documents


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent):
    """{row number: (n, component)} by comparing all pairs."""
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return [(d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x or 0) for x in r])


def near_copies():
    """Chains and groups around the threshold, with words that most texts share."""
    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(25))
    rows = []
    for base in range(12):
        words = [f"b{base}w{rng.randrange(10**6)}" for _ in range(rng.choice([6, 12, 40, 90, 300]))]
        for _ in range(rng.choice([1, 2, 25])):
            own = list(words)
            for _ in range(rng.randrange(0, max(1, len(words) // 12))):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1009, (common + " " if rng.random() < 0.5 else "") + " ".join(own)))
            words = own if rng.random() < 0.3 else words
    return rows


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_all_links(spark, odd, size, percent):
    given = [(r["doc_id"], r["text"]) for r in (documents(spark) if size == 4 else odd).collect()]
    for rows in (given, near_copies()):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = ngram_join.jaccard_components(df, size, percent)
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        assert order(got.collect()) == order(brute(rows, size, percent))


def test_empty(spark, none):
    assert ngram_join.jaccard_components(none).count() == 0


def test_traversal_finds_what_pivots_miss():
    """All pairs of a leaf descent against plain comparison."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(200)[: 200 - k]], rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in rng.integers(0, 40, 60)]
    rows = lambda part: {"entry": list(part), "n": [len(sets[i]) for i in part], "bits": [ngram_join.bitmap(sets[i]) for i in part]}
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"one": rows(range(30)), "two": rows(range(30, 60))}])
    found = {(a.as_py(), b.as_py()) for out in ngram_join._leaf_pairs(80)(iter([batch])) for a, b in zip(out.column(0), out.column(1))}
    real = {(i, j) for i in range(30) for j in range(30, 60) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert real and real <= found and len(found) < 900


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (100, 75), (75, 75), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 75: 50, 100: 50}
