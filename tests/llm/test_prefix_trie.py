import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paperloom.llm import prefix_trie
from paperloom.llm.queries import op13_prefix_trie

EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = "conv_id long, turn int, role string, text string, length string, pos int, extra int"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:30]


def brute(rows):
    """Every rebuilt conversation written out, every node by its turns, every subtree by walking."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(built) + 1):
            members[built[:d]].append((c, len(built) == d))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, found in members.items():
        under, leaves, saved = [node], 0, 0
        while under:
            x = under.pop()
            under += children[x]
            leaves += not children[x]
            saved += (len(members[x]) - 1) * len(x[-1][1].encode()) if x else 0
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        ends = ",".join(str(c) for c in sorted(c for c, e in found if e))
        out.append((min(c for c, _ in found), len(node), parent, len(found), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


class Folder:
    """Stands for a session whose reader gives one table."""

    def __init__(self, df):
        self.df = df
        self.read = self

    def parquet(self, _):
        return self.df


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in op13_prefix_trie(Folder(df.repartition(parts)), "").collect()), key=str)


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 60), n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 14])):
            turn = rng.choice([None, t, t, t, 0])
            rows.append((c, turn, rng.choice(["user", "user", None]), rng.choice(["a", "a", "b", "é", "", None, f"own {c}"])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rows = random_rows(seed, 25)
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    one = [(0, i, "user", f"t{i}") for i in range(12)]
    copies = [(5 * c, i, "user", "same") for c in range(3, 40) for i in range(3)]
    rows = [*one, *copies, *copies[:2], (None, 1, "user", "x"), (None, None, None, None), (1, None, None, None), (2, 0, "", ""), (7, 1, "user", "long " * 20_000), (-3, 0, "a", "b"), (-5, 0, "a", "b")]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "user", "x")]) == []


def test_long_conversations(spark, monkeypatch):
    """One conversation with most rows, one turn that repeats, many chunks and many pieces of ends."""
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    rows = [(10, i % 700, "user", "again" if i % 3 else f"t{i}") for i in range(900)] + [(10, None, "user", "again")] * 200
    rows += [(15 + 5 * i, 0, "user", "hello") for i in range(40)] + [(11, i, "user", "x") for i in range(30)]
    got = run(spark, rows, 6)
    want = brute(rows)
    assert got == want


def test_collisions_lead_to_other_bases(spark, monkeypatch):
    """Primes so small that prefixes collide are noticed; the tries with other bases fail too and say so."""
    rows = random_rows(7, 30)
    monkeypatch.setattr(prefix_trie, "PRIMES", (2, 3, 2))
    monkeypatch.setattr(prefix_trie, "BASES", ((1, 1, 1), (1, 1, 1)))
    with pytest.raises(ValueError, match="collide"):
        run(spark, rows)


def test_references_lead_to_the_turn(spark):
    rows = random_rows(4, 20)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    trie = prefix_trie.prefix_trie(df, lambda c: c - c % 5, lambda c: F.crc32(c.cast("string").cast("binary")) % 9)
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, digest(role or "", text or "")))
    for r in trie.nodes.where("depth > 0").collect():
        assert len(own[r["ref_conv"]]) >= r["ref_pos"] >= 1
    assert trie.nodes.select("conv_id", "depth").distinct().count() == trie.nodes.count()
