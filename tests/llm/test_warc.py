import hashlib

import pytest

from paperloom.llm import warc
from paperloom.plans.scratch import scratch_path

PAGES = "page_id long, url string, html string, payload string, digest string, rep int"


def read(spark, rows):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path)
    return path, warc.resolved(warc.read_archives(spark, path)).collect()


def test_round_trip(spark):
    big = "é日本\r\n\r\nWARC/1.1\r\n" * 30_000
    copy = "c" * 1200
    texts = [(1, copy), (9, copy), (5, copy), (None, copy), (2, "s" * 999), (3, "s" * 999), (4, big), (6, ""), (7, None), (None, "lone" * 300), (8, big), (9, copy), (10, "0\r\n\r\n")]
    rows = [(i, None if i == 6 else f"http://a/{i}\r\nX: y", t, "p", "d", 1) for i, t in texts]
    path, got = read(spark, rows)
    assert len(got) == len(rows) and all(r["error"] is None for r in got)
    want = []
    for i, t in texts:
        raw = (t or "").encode()
        group = [j for j, u in texts if u == t and j is not None]
        rep = max(group) if len(raw) >= 1000 and len([1 for _, u in texts if u == t]) > 1 and group else None
        back = rep is not None and i != rep
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if back else "response", rep if back else None))
    number = lambda x: int(x) if x is not None else None
    have = [(number(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    segments = [r for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    heads = [h for s in segments for h, _ in warc.parse_archive(__import__("gzip").decompress(s["content"]))]
    assert sum(h["warc-type"] == "continuation" for h in heads) > 5


def test_empty(spark):
    assert read(spark, [])[1] == []


def test_damage():
    with pytest.raises(ValueError, match="segment is missing"):
        warc.assemble([(1, b"a"), (3, b"b")], 2)
    with pytest.raises(ValueError, match="total length"):
        warc.assemble([(2, b"b"), (1, b"a")], 3)
    assert warc.assemble([(2, b"b"), (1, b"a"), (1, b"a")], 2) == b"ab"
    for bad in (b"5\r\nabc", b"3\r\nabcX\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.dechunk(bad)
    assert warc.dechunk(b"3;x=1\r\nabc\r\n1\r\nd\r\n0\r\n\r\n") == b"abcd"
    assert warc._settled({"declared": "00"}, b"HTTP/1.1 200 OK\r\n\r\nabc")["error"] == "payload digest differs"


def test_archives_of_many_members_are_read_as_a_stream(spark, monkeypatch):
    """One gzip member a record, as usual archives have them; batches stay small; a cut archive is an error."""
    import gzip

    import pyarrow as pa

    monkeypatch.setattr(warc, "BATCH_BYTES", 4096)
    payload = b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 500
    record = lambda i: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n" % (i, len(payload)) + payload + b"\r\n\r\n"
    packed = b"".join(gzip.compress(record(i)) for i in range(40))
    batches = list(warc._parsed(iter([pa.RecordBatch.from_arrays([pa.array([packed, b""], pa.binary())], names=["content"])])))
    rows = [r for b in batches for r in b.to_pylist()]
    assert [r["record_id"] for r in rows] == [f"<{i}>" for i in range(40)] and {r["payload_bytes"] for r in rows} == {500}
    assert len(batches) > 5
    for cut in (record(1)[:-5], record(1)[:30], b"GARC" + record(1)):
        with pytest.raises(ValueError):
            list(warc.parse_archive(cut))


def test_repeated_segments_meet_once(spark):
    """Copies of one long page: each comes back, its segments are held once."""
    text = "\n".join(f"line {i} of a long page" for i in range(9000))
    rows = [(7, "http://a/7", text, "p", "d", 1)] * 6
    _, got = read(spark, rows)
    assert len(got) == 6 and {r["payload_bytes"] for r in got} == {len(text)} and all(r["error"] is None for r in got)
