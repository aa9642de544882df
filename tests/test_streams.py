"""Streams over several micro-batches, replays, and state that expires."""

import datetime

from pyspark.sql import functions as F

from catalog import Tables
from catalog.q_structure import contract_files
from paperloom.operators import quota as qu
from paperloom.plans.scratch import scratch_path
from paperloom.sources import tables as src
from paperloom.streaming import jobs as st

BASE = datetime.datetime(2024, 1, 1)


def calls(spark, rows):
    return spark.createDataFrame([(i, m, BASE + datetime.timedelta(milliseconds=ms)) for i, m, ms in rows], "event_id long, model_key string, ts timestamp")


def test_interval_state_crosses_batches(spark, tmp_path):
    """Two batches of calls give what one table gives; the table of limits decides what is too close."""
    rows = [(i, "ab"[i % 2], 700 * i + (i % 5) * 90) for i in range(60)]
    limits = spark.createDataFrame([("a", 5, 1400), ("b", 5, 1)], "model_key string, minute_limit int, min_interval_ms int")
    folder, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:25], rows[25:]):
        calls(spark, part).repartition(3).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(calls(spark, []).schema).parquet(folder)
        st.file_sink(st.interval_stream(stream, limits), sink).awaitTermination()
    got = {r["event_id"]: (r["gap_ms"], r["too_close"]) for r in spark.read.parquet(f"{sink}/rows").collect()}
    want = {r["event_id"]: (r["gap_ms"], r["too_close"]) for r in qu.rate_violations(calls(spark, rows), limits).collect()}
    assert got == want and any(x for _, x in got.values())


def test_state_of_silent_keys_expires(spark, tmp_path):
    """With a time to live the call before is forgotten; without one it is not."""
    limits = spark.createDataFrame([], "model_key string, min_interval_ms int")
    for ttl, gap in ((1, None), (None, 1000)):
        folder, sink = str(tmp_path / f"in{ttl}"), str(tmp_path / f"out{ttl}")
        for part in ([(1, "a", 0)], [(2, "a", 1000)]):
            calls(spark, part).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(calls(spark, []).schema).parquet(folder)
            st.file_sink(st.interval_stream(stream, limits, ttl), sink, trigger={"once": True}).awaitTermination(100)
        assert {r["event_id"]: r["gap_ms"] for r in spark.read.parquet(f"{sink}/rows").collect()} == {1: None, 2: gap}


def test_throttle_crosses_batches(spark, tmp_path):
    rows = [(1, i, BASE + datetime.timedelta(milliseconds=900 * i), (i * i) % 7) for i in range(50)]
    schema = "contract_id long, event_id long, ts timestamp, percent int"
    folder, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part[::-1], schema).repartition(4).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        st.file_sink(st.throttle_stream(stream), sink).awaitTermination()
    got = {r["event_id"] for r in spark.read.parquet(f"{sink}/rows").collect()}
    assert got == {r["event_id"] for r in qu.throttle_progress(spark.createDataFrame(rows, schema)).collect()}


def test_replay_of_a_batch_changes_nothing(spark):
    """The same files as the same batch again: same contracts, zones and clauses, same counts; nothing twice."""
    t = Tables(spark, "/root/testdata/sf0.001")
    inbox, sink = scratch_path(spark, "inbox"), scratch_path(spark, "intake")
    contract_files(t, inbox)
    number = F.regexp_extract("path", r"contract=(\d+)/", 1)

    def state():
        read = lambda n: sorted(map(str, spark.read.parquet(f"{sink}/{n}").collect()))
        return [read(n) for n in ("published/contracts", "published/document_zones", "published/clauses", "rejected", "counts")]

    st.publish_stream(spark, inbox, sink, contract=number).awaitTermination()
    first = state()
    st.publish_stream(spark, inbox, sink, contract=number).awaitTermination()  # no new file: no batch
    assert state() == first
    hadoop = spark._jvm.org.apache.hadoop.fs
    state_path = hadoop.Path(f"{sink}/_state")
    fs = state_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.rename(state_path, hadoop.Path(f"{sink}/_lost"))  # the state is lost: the batch comes again under the same number
    st.publish_stream(spark, inbox, sink, contract=number).awaitTermination()
    assert state() == first
    counts = spark.read.parquet(f"{sink}/counts").first()
    assert counts["files"] == counts["accepted"] + counts["rejected"] and counts["rejected"] > 0 and counts["damaged"] > 0


def test_a_contract_in_several_files_is_one_text(spark):
    """Files too large to be accepted are none any more: the parts of a contract give what its one file gave."""
    t = Tables(spark, "/root/testdata/sf0.001")
    number = F.regexp_extract("path", r"contract=(\d+)/", 1)
    got, files = [], []
    for size in (1 << 24, 3000):
        inbox, sink = scratch_path(spark, "inbox"), scratch_path(spark, "intake")
        contract_files(t, inbox, size)
        st.publish_stream(spark, inbox, sink, contract=number).awaitTermination()
        tables = [st.published(spark, sink, n).drop("batch", "bucket") for n in st.PUBLISHED]
        names = [[c for c in df.columns if c != "name"] for df in tables]
        got.append([sorted(map(str, df.select(c).collect())) for df, c in zip(tables, names)])
        got[-1].append(sorted(map(str, spark.read.parquet(f"{sink}/rejected").select("contract_id", "reject_reason").distinct().collect())))
        files.append(spark.read.parquet(f"{sink}/counts").first()["files"])
        assert all(dict(spark.read.parquet(f"{sink}/published/{n}").dtypes)[c] == kind for n, df in zip(st.PUBLISHED, tables) for c, kind in df.dtypes)
    assert files[0] == 40 and files[1] > 100
    assert got[0] == got[1] and all(got[0])


def test_parts_end_with_their_last_line(spark):
    rows = [(1, "b", "2. Terms\nmore\n\n"), (1, "a", "1. Scope\ntext\n"), (1, "c", "\nend"), (2, "x", "1. One\nbody\n"), (3, "y", "1. One"), (3, "z", None), (None, "p", "1. P\nx"), (None, "q", "1. Q\ny")]
    files = spark.createDataFrame([(i, f"{n}.pdf", f"/in/{n}", t) for i, n, t in rows], "contract_id long, name string, path string, content string")
    parsed = st.parse_files(files, F.col("content"))
    one = spark.createDataFrame([(1, "a.pdf", "1. Scope\ntext\n2. Terms\nmore\n\n\nend"), (2, "x.pdf", "1. One\nbody\n")], "contract_id long, name string, content string")
    want = st.parse_files(one, F.col("content"))
    for table in ("zones", "clauses"):
        rows = [sorted(map(str, p[table].where("contract_id < 3").collect())) for p in (parsed, want)]
        assert rows[0] == rows[1] and rows[0]
    assert [r["contract_id"] for r in parsed["damaged"].collect()] == [3]
    assert sorted(r["name"] for r in parsed["contracts"].collect()) == ["a.pdf", "p.pdf", "q.pdf", "x.pdf", "y.pdf"]
    assert parsed["clauses"].where("contract_id is null").count() == 2


def test_nothing_published_can_be_read(spark, tmp_path, monkeypatch):
    """All files beyond the limit of size: reasons for all, tables without a row, and no content is read."""
    monkeypatch.setattr(src, "MAX_FILE_BYTES", 20)
    inbox, sink = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    for n in range(3):
        (inbox / f"{n}.pdf").write_text("%PDF-1.7\n1. Scope\n" + "text\n" * 9)
    st.publish_stream(spark, str(inbox), sink).awaitTermination()
    assert [st.published(spark, sink, n).count() for n in st.PUBLISHED] == [0, 0, 0]
    assert [r["reject_reason"] for r in spark.read.parquet(f"{sink}/rejected").collect()] == ["size"] * 3
    raw = src.fitting_content(spark.read.format("binaryFile").load(str(inbox)))
    assert raw.where("content is not null").count() == 0 and raw.count() == 3


def test_damaged_files_fail_alone(spark):
    schema = "contract_id long, name string, content binary"
    rows = [(1, "a.pdf", b"%PDF-1.7\nTitle\n1. Scope\nText below."), (2, "b.pdf", b"%PDF-1.7\n\xff\xfe\xff"), (3, "c.pdf", b"%PDF-1.7\n \n"), (4, "d.pdf", b"%PDF")]
    files = spark.createDataFrame([(i, n, bytearray(c)) for i, n, c in rows], schema)
    parsed = st.parse_files(files, st.plain_text(F.col("content")))
    assert sorted(r["contract_id"] for r in parsed["damaged"].collect()) == [2, 3, 4]
    assert {r["contract_id"] for r in parsed["clauses"].collect()} == {1}
    assert parsed["contracts"].count() == 4


def test_lines_give_what_whole_texts_give(spark):
    """Zones and clauses from lines are those of the operators on whole texts; a row that is kept holds a line, not a file."""
    from paperloom.functions.zoning import zone_paragraphs
    from paperloom.operators.clauses import split_clauses_text
    from paperloom.sources.tables import split_text

    texts = [
        "1. Scope\nText\r\nmore\r\n\n\nArticle\n 5.1 Next\nArticle\n\t\n6 more\n\n \n\n Article 7\n제\n3\n조 목적\r\n\n2. Terms\n3. Empty",
        "Intro only\n\n\nTABLE OF CONTENTS\nno heading here\r",
        "1. A\n2. B\n3. C",
        "\n\n\nGENERAL CONDITIONS\n1.1 First\nbody\n\n1.2 Second\n \n1.3 Third\nbody\n\nAPPENDIX A\nSection\n\n9 x\nClause 4 and\nClause\n \n8",
        "plain\n" * 30 + "1.1 a\n1.2 b\n1.3 c\n1.4 d\nArticle 1\nSection 2\nClause 3 Article 9\rArticle 10\nlast",
    ]
    files = spark.createDataFrame([(i, f"{i}.pdf", bytearray(("%PDF-1.7\n" + t).encode())) for i, t in enumerate(texts)], "contract_id long, name string, content binary")
    parsed = st.parse_files(files, st.plain_text(F.col("content")))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert rows(parsed["clauses"], "contract_id", "clause", "text", "needs_review") == rows(split_clauses_text(docs), "doc_id", "clause", "text", "needs_review")
    want, run = {}, {}
    for r in zone_paragraphs(split_text(docs, "paragraph")).orderBy("doc_id", "pos").collect():
        last = run.get(r.doc_id)
        run[r.doc_id] = (last[0] + (last[1] != r.type), r.type) if last else (1, r.type)
        z = want.setdefault((r.doc_id, run[r.doc_id][0], r.type), [r.pos, r.pos, r.confidence])
        z[1], z[2] = r.pos, max(z[2], r.confidence)
    assert rows(parsed["zones"], "contract_id", "zone_index", "zone_type", "page_from", "page_to", "confidence") == sorted((*k, *v) for k, v in want.items())
    plan = parsed["clauses"]._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan


def test_interval_holds_a_key_as_flat_columns(spark):
    """A key of 400,000 calls in one batch: pieces in order, and little more memory than its numbers."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    class Value:
        at = None

        def exists(self):
            return self.at is not None

        def get(self):
            return self.at

        def update(self, row):
            self.at = row

    n = 400_000
    ids = np.random.default_rng(1).permutation(n)
    chunks = (pd.DataFrame({"event_id": ids[i : i + 10_000], "model_key": "m", "ts_ms": ids[i : i + 10_000] // 2 * 10, "min_interval_ms": 5}) for i in range(0, n, 10_000))
    state = st._Interval(None)
    state.last = Value()
    tracemalloc.start()
    at, close = 0, 0
    for part in state.handleInputRows(("m",), chunks, None):
        assert part["event_id"].tolist() == list(range(at, at + len(part)))
        assert part["gap_ms"].tolist()[1:3] == [0, 10] if at == 0 else part["gap_ms"].tolist()[:2] == [10, 0]
        at, close = at + len(part), close + int(part["too_close"].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == n and close == n // 2 and state.last.at == ((n - 1) // 2 * 10,)
    assert peak < 100 * n
