"""Two-level scans against a sequential pass, with one key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.plans import scan as sc


def sequential(rows):
    out = {}
    state = {}
    for key, pos, v in rows:
        s = state.setdefault(key, dict(total=0, top=None, last=None, prev=None, run=0, first=None, any=False))
        before = s["last"]
        s["run"] += 1 if not s["any"] or s["prev"] != v else 0
        prev = s["prev"]
        if v is not None:
            s["total"] += v
            s["top"] = v if s["top"] is None else max(s["top"], v)
            s["last"] = v
        s["first"] = pos if s["first"] is None else s["first"]
        s["prev"], s["any"] = v, True
        out[(key, pos)] = (s["total"], s["top"], s["last"], before, prev, s["run"], s["first"])
    return out


@pytest.mark.parametrize("chunk", [None, 1, 3, 7, 1000])
def test_matches_sequential_pass(spark, chunk):
    rnd = random.Random(chunk or 0)
    rows = []
    for key, n in [("hot", 400), ("a", 1), ("b", 17), ("c", 60)]:
        rows += [(key, i, rnd.choice([None, 0, 1, 1, 2, 5])) for i in range(n)]
    expected = sequential(rows)
    nxt = {(k, p): rows[i + 1][2] if i + 1 < len(rows) and rows[i + 1][0] == k else None for i, (k, p, _) in enumerate(rows)}
    df = spark.createDataFrame(rows, "k string, pos long, v long").repartition(5)
    v = F.col("v")
    got = sc.ordered_scan(
        df,
        ["k"],
        ["pos"],
        {
            "total": sc.running_sum(F.coalesce(v, F.lit(0))),
            "top": sc.running_max(v),
            "last": sc.last_value(v),
            "before": sc.last_before(v),
            "prev": sc.previous(v),
            "run": sc.island(v),
            "first": sc.first_value(F.struct("pos")),
            "next": sc.following(v),
        },
        None if chunk is None else F.floor(F.col("pos") / chunk),
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        seen = (r.total, r.top, r.last, r.before, r.prev, r.run, r.first.pos)
        assert seen == expected[(r.k, r.pos)], (r, expected[(r.k, r.pos)])
        assert r.next == nxt[(r.k, r.pos)]


def test_island_predicate(spark):
    times = [0, 1, 2, 9, 10, 30, 31, 32, 33, 60]
    df = spark.createDataFrame([("x", t) for t in times], "k string, t long")
    got = sc.ordered_scan(
        df, ["k"], ["t"], {"run": sc.island(F.col("t"), lambda p, c: c - p >= 5)}, F.floor(F.col("t") / 3)
    ).orderBy("t").collect()
    assert [r.run for r in got] == [1, 1, 1, 2, 2, 3, 3, 3, 3, 4]


@pytest.mark.parametrize("rows, pages", [(4, 3), (1, 1)])
def test_queries_do_not_depend_on_the_chunk_size(spark, monkeypatch, rows, pages):
    from catalog import QUERIES

    names = ["wn9_suppress_reference_headings", "wn14_merge_adjacent_zones", "wn15_mark_toc", "wn20_with_tree_parent", "wn25_merge_short_sections",
             "sc14_shape_clauses", "wn7_build_clauses"]
    folder = "/root/testdata/sf0.001"

    def run(name):
        df = QUERIES[name](spark, folder)
        return sorted(map(str, df.select(*sorted(df.columns)).collect()))

    whole = {n: run(n) for n in names}
    monkeypatch.setattr(sc, "CHUNK_ROWS", rows)
    monkeypatch.setattr(sc, "CHUNK_PAGES", pages)
    for n in names:
        assert run(n) == whole[n], n


def test_null_keys_are_one_key(spark):
    df = spark.createDataFrame([(None, i) for i in range(6)], "k string, pos long")
    got = sc.ordered_scan(df, ["k"], ["pos"], {"n": sc.running_sum(F.lit(1))}, F.floor(F.col("pos") / 2)).orderBy("pos").collect()
    assert [r.n for r in got] == [1, 2, 3, 4, 5, 6]


def test_trigrams_are_counted_whole(spark, monkeypatch):
    """Counts inside batches against a plain loop: nulls, short and wide texts, keys that span batches."""
    from collections import Counter

    from paperloom.operators import clauses as cl

    monkeypatch.setattr(cl, "GRAM_CHARS", 10)
    rows = [(1, "aaaa"), (1, "ab"), (2, None), (None, "日本語🎉日本"), (2, "xyzxyz" * 7), (1, "aab"), (2, "")]
    got = {}
    for r in cl.gram_counts(spark.createDataFrame(rows, "k long, t string").repartition(2), "k", "t").collect():
        gram = "".join(chr(r["gram"] >> s & 0x1FFFFF) for s in (42, 21, 0))
        got[r["k"], gram] = got.get((r["k"], gram), 0) + r["n"]
    want = Counter((k, (t or "")[i : i + 3]) for k, t in rows for i in range(len(t or "") - 2))
    assert got == want


def test_trigrams_of_more_characters_than_fit_a_number():
    """Keys and characters that need more than 64 bits together are counted in parts."""
    import pyarrow as pa

    from paperloom.operators import clauses as cl

    texts = [chr(0x20000 + 5 * i) + chr(0x20001 + 5 * i) + chr(0x1000 + 5 * i) + "ab" for i in range(8200)] + [""]
    texts = [t + "".join(chr(0x30000 + 9 * i + j) for j in range(6)) for i, t in enumerate(texts)]
    assert len({c for t in texts for c in t}) > 1 << 16 and len(texts) > 1 << 13
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    parts = list(cl._grams_of(batch, "k"))
    got = {(k, g): n for p in parts for k, g, n in zip(*(c.to_pylist() for c in p.columns))}
    code = lambda t: ord(t[0]) << 42 | ord(t[1]) << 21 | ord(t[2])
    assert len(parts) > 1 and got == {(k, code(t[i : i + 3])): 1 for k, t in enumerate(texts) for i in range(len(t) - 2)}


def test_only_ends_of_clauses_are_put_in_order(spark, monkeypatch):
    """Languages by whole contracts, with trigrams across empty clauses; no text goes through a scan."""
    from collections import Counter

    from paperloom.operators import clauses as cl

    rng, scanned, whole = random.Random(4), [], cl.ordered_scan
    monkeypatch.setattr(cl, "ordered_scan", lambda df, *a: scanned.append(df) or whole(df, *a))
    rows = [(c, i, 100 * c + i, rng.choice([None, "", "A", "Xy", "\n", "".join(rng.choices("abxy", k=9))])) for c in range(40) for i in range(c % 7 + 1)]
    texts = {c: "".join((t or "").lower() + "\n" for k, _, _, t in rows if k == c) for c in range(40)}
    grams = sorted({t[i : i + 3] for t in texts.values() for i in range(len(t) - 2)})
    weight = {(lang, g): float(rng.randint(1, 1 << 20)) for lang in ("de", "en", "fr") for g in grams if rng.random() < 0.8}
    code = lambda t: ord(t[0]) << 42 | ord(t[1]) << 21 | ord(t[2])
    profiles = spark.createDataFrame([(lang, code(g), w) for (lang, g), w in weight.items()], "lang string, gram long, weight double")
    clauses = spark.createDataFrame(rows, "contract_id long, sort_order long, clause_id long, text string").repartition(5)
    got = {r["contract_id"]: r["lang"] for r in cl.dominant_language(clauses, profiles).collect()}
    want = {}
    for c, t in texts.items():
        n = Counter(t[i : i + 3] for i in range(len(t) - 2))
        score = {lang: sum(k * weight[lang, g] for g, k in n.items() if (lang, g) in weight) for lang in ("de", "en", "fr") if any((lang, g) in weight for g in n)}
        if score:
            want[c] = max(score, key=lambda x: (score[x], x))
    assert got == want and len(want) > 30
    for df in scanned:
        names = [x for x, kind in df.dtypes if kind == "string"]
        assert names and all(r is None or len(r) <= 2 for row in df.select(*names).collect() for r in row)
