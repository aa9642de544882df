"""The pipeline on the smallest tables, stage by stage against what each stage promises."""

import re

import corpus_pipeline as cp
from paperloom.plans.scratch import cut

from .conftest import documents
from .test_line_winnow import by_lines
from .test_ngram_join import brute as brute_join

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark):
    docs, at = documents(spark), {}
    for name, stage in cp.STAGES:
        before, docs = docs, cut(stage(spark, docs, FOLDER), "stage")
        at[name] = before, docs
        if name != cp.STAGES[-1][0]:
            assert docs.schema == before.schema
    before, after = at["quality classifier"]
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after.collect()}
    good = [d for d, q in label.items() if q == 1]
    assert set(rows(after)) <= set(rows(before)) and sum(d in kept for d in good) >= 0.95 * len(good)
    before, after = at["line dedup"]
    want = by_lines(rows(before))
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    whole = [(d, t, want[d, t]) for d, t in rows(before)]
    assert rows(after) == sorted((d, left) for d, t, left in whole if left == t or count(left) >= cp.LEAST_LEFT * count(t))
    assert all(left for _, left in rows(after))
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = at["n-gram jaccard join"]
    assert rows(after) == sorted(r for r, (d, n, c) in zip(rows(before), brute_join(rows(before), 5, 80)) if not n or c == d)
    before, after = at["benchmark decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaked = [d for d, t in rows(before) if any(x in t for x in items)]
    assert set(rows(after)) <= set(rows(before)) and not set(leaked) & {d for d, _ in rows(after)}
    before, after = at["bpe encoding and decoding"]
    assert after.count() == before.count()


def test_odd_rows(spark, odd):
    docs = odd.selectExpr("doc_id", "text", "host as lang", "host as source", "cast(length(text) as long) as n_chars")
    for name, stage in cp.STAGES:
        out = cut(stage(spark, docs, FOLDER), "odd")
        assert out.count() <= docs.count()
        if name == cp.STAGES[-1][0]:
            assert out.count() == docs.count()
        else:
            assert out.schema == docs.schema
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_one_row_of_each_group(spark):
    """Ids that are null, repeated or shared between groups keep no copy alive."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    docs = [(3, one), (3, one), (3, one), (5, one + " end"), (None, one), (5, two), (7, two), (5, two + " more"), (None, three), (None, three), (None, three + " x"), (9, ""), (9, ""), (None, None)]
    df = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 5):
        out = [(r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, df.repartition(parts), FOLDER).collect()]
        assert [x for x in out if x[1] and x[1][0] == "a"] == [(3, one)]
        left = [x for x in out if x[1] and x[1][0] == "b"]
        assert len(left) == 1 and left[0][0] == 5
        left = [x for x in out if x[1] and x[1][0] == "c"]
        assert len(left) == 1 and left[0][0] is None
        assert sorted(str(x) for x in out if not x[1]) == ["(9, '')", "(9, '')", "(None, None)"]
