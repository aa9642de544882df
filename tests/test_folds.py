"""Order-dependent operators against plain sequential models."""

import datetime
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.operators import quota as qu
from paperloom.operators import sections as se
from paperloom.plans import packed as pk
from paperloom.plans import scan as sc
from paperloom.sources import tables as src


def number(h):
    for rx in (r"^\s*(\d+(?:\.\d+)*)\s", r"^\s*(\d+(?:\.\d+)*)[.)]\s", r"^\s*(\d+(?:\.\d+)*)[.)]\s*$"):
        m = re.match(rx, h)
        if m:
            return m.group(1)
    m = re.match(r"^\s*(?:ARTICLE|CLAUSE|SECTION|CHAPTER|PART)\s+(\d+(?:\.\d+)*)\b", h, re.I)
    return m.group(1) if m else None


def child(a, b):
    x, y = number(a), number(b)
    return bool(x and y and y.startswith(x + "."))


def merge_model(headings, contents):
    """Expected headings and contents, walking one document from the front."""
    deep = re.compile(r"^\s*\d+(?:\.\d+){2,}\s")
    bare = [not c.strip() and h.strip() != "" for h, c in zip(headings, contents)]
    loose = [b and not deep.match(h) for b, h in zip(bare, headings)]
    out, i, n = [], 0, len(headings)
    while i < n:
        if not loose[i]:
            out.append((headings[i], contents[i]))
            i += 1
            continue
        got = [headings[i]]
        j = i + 1
        while j < n and loose[j]:
            if child(got[-1], headings[j]):
                break
            have = [number(g) for g in got if number(g)]
            if have and number(headings[j]) and have[0] != number(headings[j]):
                break
            got.append(headings[j])
            j += 1
        if j == n:
            out += [(headings[k], contents[k]) for k in range(i, j)]
            i = j
            continue
        t = headings[j]
        m = re.search(r"\s+(\d+\.\d+(?:\.\d+)*)\s+\S", t)
        if any(child(g, t) for g in got) or (m and any(number(g) and m.group(1).startswith(number(g) + ".") for g in got)):
            out.append((" ".join(got), contents[i]))
            i = j
        else:
            out.append((" ".join(got + ([t] if t else [])), contents[j]))
            i = j + 1
    return out


def test_heading_fragments(spark, monkeypatch):
    monkeypatch.setattr(sc, "CHUNK_ROWS", 3)
    rnd = random.Random(4)
    pool = ["1.1", "Definitions", "1", "1 General", "1.1 Scope", "ARTICLE 6", "COMMENCEMENT", "6.1 Start", "COMMENCEMENT 6.1 Start x", "1.1.1.2 Deep text", "", "7 Other", "6."]
    rows, want = [], {}
    for doc in range(60):
        n = rnd.randint(1, 14)
        hs = [rnd.choice(pool) for _ in range(n)]
        cs = [rnd.choice(["", "", "", "body"]) for _ in range(n)]
        rows += [(doc, i, h, 1, "contract_body", i, i, c) for i, (h, c) in enumerate(zip(hs, cs))]
        want[doc] = merge_model(hs, cs)
    df = spark.createDataFrame(
        rows, "contract_id long, section_index long, heading string, level int, zone_hint string, page_start int, page_end int, content string"
    )
    got: dict[int, list] = {}
    for r in se.merge_heading_fragments(df).orderBy("contract_id", "section_index").collect():
        got.setdefault(r.contract_id, []).append((r.heading, r.content))
    assert got == want


def test_words_to_lines(spark):
    rnd = random.Random(1)
    rows = []
    for page in range(6):
        for k in range(40):
            rows.append((1, page, 800.0, k, f"w{k}", float(rnd.randint(0, 500)), 700.0 - rnd.randint(0, 12) * 1.7, 20.0, rnd.choice([4.0, 10.0]), rnd.choice(["Bold", "Plain"])))
    df = spark.createDataFrame(
        rows, "contract_id long, page int, page_height double, seq long, text string, tx double, ty double, width double, font_size double, font_name string"
    )
    want = []
    for page in range(6):
        items = sorted((r for r in rows if r[1] == page), key=lambda r: (-r[6], r[5], r[3]))
        group, anchor = [], None
        groups = []
        for r in items:
            if anchor is not None and abs(r[6] - anchor) <= max(2, r[8] * 0.4):
                group.append(r)
            else:
                group = [r]
                groups.append(group)
                anchor = r[6]
        want += [(page, i, " ".join(x[4] for x in sorted(g, key=lambda x: (x[5], x[3])))) for i, g in enumerate(groups)]
    got = [(r.page, r.line_no, r.text) for r in src.words_to_lines(df).orderBy("page", "line_no").collect()]
    assert got == want


def test_throttle_with_bursts(spark):
    rnd = random.Random(9)
    base = datetime.datetime(2024, 1, 1)
    rows, want, n = [], set(), 0
    for contract in range(12):
        ms = 0
        last_ms, last = None, None
        for _ in range(300 if contract == 0 else 40):
            ms += rnd.choice([200, 900, 1500, 2999, 3000, 3500, 9000, 3_600_000 if contract == 0 and rnd.random() < 0.02 else 100])
            value = rnd.randint(0, 2)
            rows.append((n, contract, base + datetime.timedelta(milliseconds=ms), value))
            if value != last and (last_ms is None or ms - last_ms >= 3000):
                want.add(n)
                last_ms, last = ms, value
            n += 1
    df = spark.createDataFrame(rows, "event_id long, contract_id long, ts timestamp_ntz, percent int").repartition(6)
    assert {r.event_id for r in qu.throttle_progress(df).collect()} == want


@pytest.mark.parametrize("alpha", [0.3, 0.95, 0.0, 0.999])
def test_eta_smoothing_over_many_rows(spark, alpha):
    base = datetime.datetime(2024, 1, 1)
    rows, want, s, before = [], {}, None, None
    for i in range(3000):
        p, stage = float(10 + (i * 37) % 80), 2 + (i // 1100) % 2
        early, done = i % 50 == 7, i % 61 == 5
        rows.append((i, 1, base + datetime.timedelta(seconds=i), stage, p, 5_000 if early else 20_000, 10_000, p, done))
        if early:
            want[i] = None
            continue
        if done:
            want[i] = 0
            continue
        raw = 10_000 / (p / 100) * (1 - p / 100) + (50_000 if stage == 2 else 20_000)
        s = raw if stage != before else alpha * s + (1 - alpha) * raw
        before = stage
        want[i] = round(s)
    df = spark.createDataFrame(
        rows, "event_id long, contract_id long, ts timestamp_ntz, stage int, stage_progress double, elapsed_ms long, stage_elapsed_ms long, overall double, done boolean"
    )
    got = {r.event_id: r.eta_ms for r in qu.eta(df, alpha=alpha).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == want[i] or abs(got[i] - want[i]) <= 1 for i in want)


def test_untitled_documents_take_the_next_heading(spark, monkeypatch):
    from paperloom.operators import toc as tc

    monkeypatch.setattr(sc, "CHUNK_PAGES", 2)
    sections = spark.createDataFrame(
        [(1, i, h, "", p, p) for i, (h, p) in enumerate([("", 1), ("Alpha", 2), ("Beta", 6), ("", 8), ("Gamma", 9), ("Late", 7)])],
        "contract_id long, section_index int, heading string, content string, page_start int, page_end int",
    )
    parts = spark.createDataFrame(
        [(1, 0, "contract_body", "", 1, 5), (1, 1, "cover_page", "", 8, 9), (1, 2, "cover_page", "Named", 20, 22)],
        "contract_id long, part_index int, part_type string, title string, page_start int, page_end int",
    )
    got = [(r.title, r.page_start, r.page_end) for r in tc.sub_documents(sections, parts).orderBy("subdoc_index").collect()]
    # the second group starts at page 8, so headings from page 7 on count, in section order;
    # a cover page behind a cover page opens nothing
    assert got == [("Alpha", 1, 5), ("Gamma", 8, 22)]


def exact_eta(rows, alpha):
    """Smoothing in fractions; (contract, event) -> milliseconds."""
    from fractions import Fraction as Q

    alpha, state, out = Q(alpha), {}, {}
    for contract, event, stage, p, elapsed, stage_elapsed in rows:
        p = min(Q(p), Q(99))
        expected = Q({1: 5_000, 2: 180_000, 3: 30_000, 4: 20_000}[stage])
        left = Q(stage_elapsed) * (100 - p) / p if p > 5 and stage_elapsed > 3000 else expected * (100 - p) / 100
        raw = left + sum(v for s, v in {1: 5_000, 2: 180_000, 3: 30_000, 4: 20_000}.items() if s > stage)
        before = state.get(contract)
        x = raw if before is None or before[0] != stage else alpha * before[1] + (1 - alpha) * raw
        if x.denominator > 10**60:
            x = Q(round(x * 10**40), 10**40)
        state[contract] = (stage, x)
        out[contract, event] = int(x + Q(1, 2))
    return out


@pytest.mark.parametrize("alpha", ["0.3", "0", "1", "0.999", "0.5"])
def test_eta_of_one_hot_contract(spark, monkeypatch, alpha):
    """Any smoothing, runs over many pieces and several levels of pieces, exact halves, one contract with most rows."""
    monkeypatch.setattr(sc, "FOLD_ROWS", 4)
    rnd = random.Random(3)
    base = datetime.datetime(2024, 1, 1)
    rows, model = [], []
    for contract, n in ((1, 700), (None, 60), (2, 3)):
        stage = 1
        for i in range(n):
            stage = rnd.choice([1, 2, 3, 4]) if rnd.random() < 0.02 else stage
            p, stage_elapsed = float(rnd.choice([0, 3, 5, 6, 10, 20, 25, 50, 99, 100])), rnd.choice([0, 3000, 3001, 4001, 10_000, 20_001])
            model.append((contract, i, stage, p, 10_000, stage_elapsed))
            rows.append((i, contract, base + datetime.timedelta(minutes=37 * i), stage, p, 10_000, stage_elapsed, 5.0, False))
    df = spark.createDataFrame(rows, "event_id long, contract_id long, ts timestamp, stage int, stage_progress double, elapsed_ms long, stage_elapsed_ms long, overall double, done boolean")
    got = {(r["contract_id"], r["event_id"]): r["eta_ms"] for r in qu.eta(df.repartition(5), alpha=alpha).collect()}
    assert got == exact_eta(model, alpha)


def test_throttle_plan_holds_no_python(spark):
    from catalog import QUERIES

    for name in ("wn32_throttle_progress", "wn33_eta"):
        text = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "InPandas" not in text and "InArrow" not in text


def test_throttle_of_one_hot_contract(spark, monkeypatch):
    """One burst that never pauses, null values and equal times, against a row loop."""
    rnd = random.Random(11)
    base = datetime.datetime(2024, 1, 1)
    for step in ([100, 500, 1000], [0, 0, 2500, 2999], [1000, 3000, 40_000]):
        rows, want, ms = [], set(), 0
        kept_ms = kept = seen = None
        for i in range(800):
            ms += rnd.choice(step)
            value = rnd.choice([None, 1, 1, 2, 2, 3])
            rows.append((i, None, base + datetime.timedelta(milliseconds=ms), value))
            if seen is None or (value != kept and ms - kept_ms >= 3000):
                kept, kept_ms, seen = value, ms, True
                want.add(i)
        df = spark.createDataFrame(rows, "event_id long, contract_id long, ts timestamp, percent int").repartition(4)
        assert {r["event_id"] for r in qu.throttle_progress(df).collect()} == want


def test_eta_of_stages_that_are_not_listed(spark):
    """They take ``other_ms``, by default what the reference takes; the query's SQL has the fifth stage's time for them."""
    row = [(1, 1, datetime.datetime(2024, 1, 1), 7, 0.0, 10_000, 0, 5.0, False)]
    df = spark.createDataFrame(row, "event_id long, contract_id long, ts timestamp, stage int, stage_progress double, elapsed_ms long, stage_elapsed_ms long, overall double, done boolean")
    assert qu.eta(df).first()["eta_ms"] == 30_000
    assert qu.eta(df, other_ms=qu.STAGE_MS[5]).first()["eta_ms"] == 60_000


def test_pages_are_folded_row_by_row(spark):
    """A page of several Arrow batches in shuffled rows; the plan gathers no page into one row."""
    from paperloom.operators import layout as ly

    rnd = random.Random(5)
    rows, want = [], {}
    for page in (1, 2):
        left = bottom = None
        block, y = -1, 0.0
        for i in range(15_000):
            y += rnd.choice([0.5, 2.0, 30.0])
            x, low = float(rnd.choice([10, 60, 120])), y + 10
            if bottom is None or y - bottom > 9.0 or abs(x - left) > 80:
                left, block = x, block + 1
            left, bottom = min(left, x), low
            want[page, i] = block
            rows.append((1, page, i, "t", x, y, 200.0, low))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "contract_id long, page int, ord long, text string, x0 double, y0 double, x1 double, y1 double")
    out = ly.assign_blocks(df)
    assert {(r["page"], r["ord"]): r["block_id"] for r in out.collect()} == want
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    words = df.selectExpr("contract_id", "page", "1000000D as page_height", "ord as seq", "text", "x0 as tx", "-y0 as ty", "5D as width", "10D as font_size", "'Helvetica' as font_name")
    lines, anchor, n = {}, {}, {}
    for _, page, i, _, _, y, _, _ in sorted(rows, key=lambda r: (r[1], r[5], r[4], r[2])):
        if page not in anchor or y - anchor[page] > 4.0:
            anchor[page], n[page] = y, n.get(page, -1) + 1
        lines[page, n[page]] = lines.get((page, n[page]), 0) + 1
    got = {(r["page"], r["line_no"]): r["text"].count("t") for r in src.words_to_lines(words).collect()}
    assert got == lines


def test_words_travel_once_as_packed_columns(spark):
    """Lines of items with nulls, NaN and items that come twice; no item is shuffled as a row, none a second time."""
    rnd = random.Random(7)
    some = lambda v, p=0.06: None if rnd.random() < p else v
    rows = []
    for page in range(30):
        for k in range(rnd.randint(1, 60)):
            ty = math.nan if rnd.random() < 0.03 else some(700.0 - rnd.randint(0, 12) * 1.7)
            rows.append((some(page % 3), some(page // 3, 0.02), some(800.0, 0.02), k % 20, some(f"w{k}"), some(float(rnd.randint(0, 9))), ty, some(20.0), 10.0 if k % 2 else some(4.0), some(rnd.choice(["BOLD", "Plain"]))))
    rows += rnd.choices(rows, k=300)
    rnd.shuffle(rows)
    df = spark.createDataFrame(
        rows, "contract_id long, page int, page_height double, seq long, text string, tx double, ty double, width double, font_size double, font_name string"
    )
    rank = lambda v: (v is not None, v is not None and math.isnan(v), 0 if v is None or math.isnan(v) else v)
    pages: dict = {}
    for r in rows:
        pages.setdefault(r[:2], []).append(r)
    want = []
    for (contract, page), items in pages.items():
        groups, anchor = [], None
        for r in sorted(items, key=lambda r: (rank(None if r[6] is None else -r[6]), rank(r[5]), r[3])):
            if anchor is not None and r[6] is not None and abs(r[6] - anchor) <= max(2, (r[8] or 0) * 0.4):
                groups[-1].append(r)
            else:
                groups.append([r])
                anchor = r[6]
        for i, g in enumerate(groups):
            text = " ".join(r[4] for r in sorted(g, key=lambda r: (rank(r[5]), r[3], r[4] or "")) if r[4] is not None)
            if text:
                tx = [r[5] for r in g if r[5] is not None]
                bold = [r[9] == "BOLD" for r in g if r[9] is not None]
                size = [r[8] for r in g if r[8] is not None]
                want.append((contract, page, i, text, min(tx, default=None), round(sum(size) / len(size), 6) if size else None, sum(bold) / len(bold) >= 0.5 if bold else None))
    out = src.words_to_lines(df)
    got = [(r["contract_id"], r["page"], r["line_no"], r["text"], r["x0"], None if r["font_size"] is None else round(r["font_size"], 6), r["is_bold"]) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("Repartition") == 1 and "piece" in plan


def test_a_long_part_is_sorted_in_ranges(monkeypatch):
    """Parts beyond what is sorted at once, of few keys: ranges give the rows in the order of one sort."""
    rnd = random.Random(8)
    some = lambda v: rnd.choice([None, math.nan, v, v, v, v])
    rows = [{"k": rnd.choice([1, 2, None]), "v": some(float(rnd.randint(0, 40))), "n": i, "__h": 0} for i in range(2000)]
    for r in rows:
        r["__h"] = {1: 9, 2: -9, None: 4}[r["k"]]
    schema = pa.schema([("k", pa.int64()), ("v", pa.float64()), ("n", pa.int64()), ("__h", pa.int64())])
    whole = pa.RecordBatch.from_pylist(rows, schema=schema)
    pieces = [lambda at=at: whole.slice(at, 130) for at in range(0, 2000, 130)]
    once = pk._in_order(whole, ["k"], ["v", "n"]).column("n").to_pylist()
    monkeypatch.setattr(pk, "SORT_ROWS", 150)
    ranges = [pk._in_order(r, ["k"], ["v", "n"]).column("n").to_pylist() for r in pk._ranges(pieces, "v")]
    assert len(ranges) > 5 and sum(ranges, []) == once
    # keys of one hash still come one after the other
    mixed = whole.set_column(3, "__h", pa.array([5] * 2000))
    keys = pk._in_order(mixed, ["k"], ["v", "n"]).column("k").to_pylist()
    assert sum(a != b for a, b in zip(keys, keys[1:])) == 2
