import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import contextual_pii as pii
from paperloom.llm.queries import QUERIES

from .conftest import documents


def plain(text):
    """The contract's forms, one finditer each."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1@.+- (%2é\n45", max_size=60))
def test_forms(text):
    assert pii.base_spans(text) == plain(text)


def test_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark).collect()}
    got = QUERIES["op5_contextual_pii"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain(texts[r["doc_id"]])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{n}"] for n in pii.KINDS] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(text.split(",")) <= set(r["spans"].split(","))


def test_patterns_discover(spark):
    rows = [(i, f"Please call me at +49 30 12345{i:02d} today") for i in range(30)]
    rows += [(100, "Please call me at 030 7654321 today"), (101, "the order of 030 7654321 units"), (102, "sum total 1234567890")]
    rows += [(200 + i, f"an order of +49 30 99{i:05d} and") for i in range(6)] + [(300 + i, f"an order of 55{i:06d} and") for i in range(20)]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[100]["spans"]] == [(18, 3, 29)] and got[100]["base"] == []
    assert got[101]["spans"] == [] and got[102]["spans"] == [] and got[300]["spans"] == []
    assert all(len(got[i]["spans"]) == 1 for i in range(30))


def test_edges(spark, odd, none):
    assert pii.find_pii(odd).count() == odd.count() and pii.find_pii(none).count() == 0
    twice = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (1, "x"), (None, "+1 234 567 890")], "doc_id long, text string")
    assert sorted(len(r["spans"]) for r in pii.find_pii(twice).collect()) == [0, 1, 1, 1]


def test_discovered_strings_induce_patterns(spark):
    """Numbers found behind a pattern of fixed forms make the next pattern known, and that one the next; a word before a few does not."""
    rows = [(i, f"Please call me at +49 30 12345{i:02d} today") for i in range(60)]
    rows += [(100 + i, f"Please call me at 030 76543{i:02d} today") for i in range(8)]
    rows += [(200 + i, f"or just ring us: 030 76543{i:02d} now") for i in range(8)] + [(210 + i, f"or just ring us: 040 11122{i:02d} now") for i in range(1)]
    rows += [(220 + i, f"or just ring us: 040 11133{i:02d} now") for i in range(1)]
    rows += [(300, "the order of 030 7654301 units"), (301, "the order of 050 9998877 units")]
    more = [(400 + i, f"or just ring us: 060 55566{i:02d} now") for i in range(6)] + [(500 + i, f"then reach out via 060 55566{i:02d} soon") for i in range(6)] + [(510, "then reach out via 070 4443322 soon")]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(len(got[i]["spans"]) == 1 and got[i]["base"] == [] for i in (*range(100, 108), *range(200, 208), 210, 220))
    assert got[300]["spans"] == [] and got[301]["spans"] == []
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows + more, "doc_id long, text string")).collect()}
    assert all(len(got[i]["spans"]) == 1 for i in (*range(200, 208), *range(400, 406), *range(500, 506), 510))


def test_texts_without_white_space_take_linear_time():
    """Megabytes without a space, of digits, dots, brackets or addresses: seconds, not hours."""
    import time

    texts = ['{"a":"x1","b":[1,2,3],"phone":"030 7654321"},' * 50_000, "ab1,cd2;" * 250_000, "1" * 1_000_000, "1." * 500_000, "(" * 1_000_000, "(1" * 500_000, "a" * 2_000_000]
    texts += ["a@" * 500_000, "+1" * 500_000, "+1 " + " " * 1_000_000, "a@" + "b" * 1_000_000, "1-" * 500_000, "1 " * 500_000, "x" * 1_000_000 + " 030 7654321 " * 1000]
    for text in texts:
        began = time.time()
        pii.occurrences(text)
        assert time.time() - began < 20, text[:20]


def test_context_takes_whole_words():
    long = "w" * 500
    assert pii.patterns_at(f"{long} {long}: 030 7654321 now", 1003, 1014) == [f"2 {long} {long}", f"s {long} 000 0000000", f"1 {long}", "> now"]
    assert pii.patterns_at("x/1.2.3.4/y", 2, 9) == [] and pii.patterns_at("1.2.3.4", 0, 7) == []


def brute_trusted(seen, trust=pii.TRUST, seeds=pii.SEEDS, rounds=pii.ROUNDS):
    """The pattern graph with dictionaries: the same steps, one arc at a time."""
    import math
    from collections import defaultdict

    kinds, may = {}, defaultdict(int)
    for p, i, kind, bits in seen:
        may[p, i] |= bits
        if kind is not None:
            kinds[p, i] = max(kind, kinds.get((p, i), -1))
    size = defaultdict(int)
    for p, _ in may:
        size[p] += 1
    arcs = {(p, i, k) for (p, i), bits in may.items() for k in ([kinds[p, i]] if (p, i) in kinds else [k for k in range(4) if bits >> k & 1])}
    sure = {(i, kinds[p, i]) for p, i in kinds}

    def worths(arcs):
        miss, best = defaultdict(float), defaultdict(float)
        for p, i, k in arcs:
            miss[i, k, p[0]] += math.log1p(-min(score[p, k], 0.999999))
        for (i, k, _), m in miss.items():
            best[i, k] = max(best[i, k], 1 - math.exp(m))
        return best

    while True:
        held = defaultdict(int)
        for p, i, k in arcs:
            held[p, k] += (i, k) in sure
        known = {key: n for key, n in held.items() if n}
        score = {(p, k): n / (size[p] + 1) for (p, k), n in known.items()}
        loose = [(p, i, k) for p, i, k in arcs if (i, k) not in sure]
        for _ in range(rounds):
            worth = worths((p, i, k) for p, i, k in loose if (p, k) in score)
            total = defaultdict(float)
            for p, i, k in loose:
                if (p, k) in score:
                    total[p, k] += worth[i, k]
            score = {(p, k): (n + total[p, k]) / (size[p] + 1) for (p, k), n in known.items()}
        fresh = {x for x, w in worths((p, i, k) for p, i, k in loose if known.get((p, k), 0) >= seeds).items() if w >= trust}
        if not fresh:
            return {(p, k) for (p, k), n in known.items() if n >= seeds and score[p, k] >= trust}
        sure |= fresh


def test_graph_against_brute_force(spark):
    import random

    rng = random.Random(8)
    found = 0
    for _ in range(2):
        rows = []
        for p in range(9):
            share = rng.choice([0.3, 0.75, 0.95])
            for _ in range(rng.choice([4, 12, 40])):
                i, kind = rng.randint(0, 120), p % 2
                fixed = (i * 7919 % 100) / 100 < share
                rows.append((f"{'21>'[p % 3]} {p}", f"i{i}", kind if fixed else None, 1 << kind if fixed else rng.choice([1, 2, 3])))
        df = spark.createDataFrame(rows, "pattern string, instance string, kind int, may int")
        got = {(r["pattern"], r["kind"]) for r in pii.trusted_patterns(df).collect()}
        assert got == brute_trusted(rows)
        found += len(got)
    assert found


def test_general_patterns_reach_where_special_ones_do_not(spark):
    """Different words before the last one: the pair of words is seen once each, the last word and the shape often."""
    rows = [(i, f"for item{chr(97 + i % 26)}{chr(97 + i // 26)} phone: +49 30 12345{i:02d} thanks") for i in range(40)] + [(100, "my own phone: 030 7654321 thanks"), (101, "sold parts: 030 7654321 away")]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[100]["spans"]] == [(14, 3, 25)] and got[101]["spans"] == []
