"""Nearest references by balls against all pairs."""

import numpy as np

from paperloom.operators import analysis as an


def clustered(rng, n, d=16, centres=300):
    middle = rng.normal(size=(centres, d))
    return middle[rng.integers(0, centres, n)] + 0.05 * rng.normal(size=(n, d))


def test_as_all_pairs_with_fewer_scored():
    rng = np.random.default_rng(2)
    refs, queries = clustered(rng, 100_000), clustered(np.random.default_rng(2), 200)
    refs[5000:5040] = refs[:40]  # ties: equal references, the earlier one first
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    refs, queries = unit(refs), unit(queries)
    balls = an.Balls.build(refs, np.arange(len(refs)))
    place, score, pairs = balls.top(queries, 3)
    every = np.round(queries @ refs.T, 9)
    for i in range(len(queries)):
        want = np.lexsort((np.arange(len(refs)), -every[i]))[:3]
        assert balls.ranks[place[i]].tolist() == want.tolist() and np.allclose(score[i], every[i][want])
    assert pairs < len(queries) * len(refs) / 2


def test_tables(spark, monkeypatch):
    rng = np.random.default_rng(4)
    refs = [(f"r{i}", 500 - i, v.tolist()) for i, v in enumerate(clustered(rng, 300, 6, 20))] + [("zero", 900, [0.0] * 6), ("none", 901, None)]
    clauses = [(i, v.tolist()) for i, v in enumerate(clustered(rng, 80, 6, 20))] + [(100, None), (101, [0.0] * 6), (102, refs[7][2])]
    r = spark.createDataFrame(refs, "ref_id string, ref_rank int, vector array<double>")
    c = spark.createDataFrame(clauses, "clause_id long, vector array<double>")
    plain = {}
    for i, v in clauses:
        if v and any(v):
            cos = [(-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9), rank, name) for name, rank, w in refs if w and any(w)]
            plain[i] = [(name, rank) for _, rank, name in sorted(cos)[:3]]
    for limit in (an.MOST_REF_BYTES, 0):
        monkeypatch.setattr(an, "MOST_REF_BYTES", limit)
        got: dict = {}
        for x in an.nearest_references(c.where("clause_id <> 101"), r.where("ref_id <> 'zero'"), 3).orderBy("clause_id", "rank").collect():
            got.setdefault(x["clause_id"], []).append((x["ref_id"], x["ref_rank"]))
        assert got == plain
    monkeypatch.undo()
    assert {x["clause_id"] for x in an.nearest_references(c, r, 3).collect()} == set(plain)
    assert an.nearest_references(c, r.limit(0)).count() == 0 and an.nearest_references(c.limit(0), r).count() == 0
    assert an.nearest_references(c.where("clause_id = 1"), r.where("ref_rank > 498"), 9).count() == 2
