import random
import re
from collections import Counter

from paperloom.llm import decontaminate

from .conftest import documents


def bag(words, size):
    k = min(size, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def alike(a, b):
    weight = lambda c: sum(n * sum(len(w.encode()) for w in g) for g, n in c.items())
    shared = weight(a & b)
    return shared / (weight(a) + weight(b) - shared)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, least=0.8, size=5):
    """Best window of each item's length by comparing every window that shares a word with the item."""
    out = {}
    for i, t in items:
        own = split(t)
        if not own:
            continue
        known, target = set(own), bag(own, size)
        for d, text in docs:
            words = split(text)
            n = min(len(own), len(words))
            if not n or n < min(size, len(own)) or not known & set(words):
                continue
            best = max((alike(bag(words[a : a + n], min(size, len(own))), target), -a) for a in range(len(words) - n + 1))
            if best[0] >= least:
                out[d, i] = best
    return out


def found(df):
    return {(r["doc_id"], x["item_id"]): (x["similarity"], -x["start_word"]) for r in df.collect() for x in r["leaks"]}


def test_planted(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 9, 30, 45, 60])))) for i in range(25)] + [(90, None), (91, " "), (92, "dup of text"), (92, "dup of text")]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rng.choice([0, 4, 80, 300]))]
        if d % 2:
            own = rng.choice(items[:25])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = word()
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
        docs.append((d, " ".join(text).title() if d % 3 == 0 else " ".join(text)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got, want = found(decontaminate.with_leaks(df, bench)), brute(docs, items)
    assert len(want) > 10 and got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def test_documents(spark):
    df, bench = documents(spark), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    some = [(r["doc_id"], r["text"]) for r in df.collect() if len(r["text"]) < 6000]
    got = {k for k in found(decontaminate.with_leaks(df, bench)) if k[0] in dict(some)}
    verbatim = {(d, i) for d, t in some for i, x in items if " ".join(split(x)) in " ".join(split(t))}
    assert verbatim and verbatim <= got
    assert got == brute(some, items).keys()


def test_edges(spark, odd, none):
    bench = spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6"), (2, "x"), (None, "a b c d e f g h")], "item_id long, text string")
    got = decontaminate.with_leaks(odd, bench)
    assert got.columns == [c for c in odd.columns if c != "leaks"] + ["leaks"] and got.count() == odd.count()
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(sorted((x["item_id"] or 0) for x in r["leaks"]))
    assert by[None] == [[], [1]] or by[None] == [[1], []]
    assert sorted(by[4]) == [[], [1], [1]] and by[5] == [[1]] and by[7] == [[2]] and by[9] == [[0]]
    assert by[1] == by[2] == by[3] == by[6] == by[8] == [[]]
    assert decontaminate.with_leaks(none, bench).count() == 0
    assert all(r["leaks"] == [] for r in decontaminate.with_leaks(odd, bench.limit(0)).collect())
    blocks, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, 20
    try:
        assert sorted(map(str, decontaminate.with_leaks(odd, bench).select("doc_id", "leaks").collect())) == sorted(map(str, got.select("doc_id", "leaks").collect()))
    finally:
        decontaminate.BLOCK_BYTES = blocks


def test_rare_far_fingerprints(spark):
    """Of windows of similarity 0.806 about one in a hundred has a fingerprint more than 16 bits away; all are found."""
    rng = random.Random(5)
    items = [[f"{rng.randrange(16**6):06x}" for _ in range(32)] for _ in range(600)]
    near = [x[:-3] + ["zzzzzz"] + x[-2:] for x in items]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(near)], "doc_id long, text string")
    hits = lambda **kw: {r["doc_id"] for r in decontaminate.with_leaks(docs, bench, **kw).collect() if [x["item_id"] for x in r["leaks"]] == [r["doc_id"]]}
    assert hits() == set(range(600)) and 570 < len(hits(radius=16)) < 600
