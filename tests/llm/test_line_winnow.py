import re

from paperloom.llm import line_winnow

from .conftest import documents

W = line_winnow.GRAM_WORDS


def sentence(seed, n):
    return " ".join(f"s{seed}q{i}" for i in range(n))


def test_planted(spark):
    long, short = sentence(1, 60), sentence(2, 20)
    lines = [sentence(i, 9) for i in range(10, 18)]  # eight short lines, 72 words
    rows = [
        (1, "\n".join(["a b c", long, "d"])),
        (2, "\n".join(["x y", "  " + long + " ", "z", short])),
        (3, "\n".join(["first", *lines, "last"])),
        (4, "\n".join(["other", *lines[:4], "", *lines[4:], "end"])),
        (5, short),
        (6, "\n".join([long, "between", long])),
    ]
    got = {r["doc_id"]: r for r in line_winnow.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == rows[2][1] and got[5]["text"] == short
    assert got[2]["text"] == "x y\nz\n" + short and got[2]["n_removed_words"] == 60
    assert got[4]["text"] == "other\nend" and got[4]["n_removed_lines"] == 9
    assert got[6]["text"] == "between"


def test_empty(none):
    assert line_winnow.dedup_lines(none).count() == 0


def by_lines(rows):
    """Texts after deletion, line by line: a line is covered where a run of at least W words around it equals lines at an earlier place.

    Runs grow by single lines from every pair of equal lines; a covered stretch of at least 50 words goes.
    """
    unique = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    table, places = [], {}
    for d, (_, text) in enumerate(unique):
        lines = [(i, x.strip(" \t\r\v\f"), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, x in enumerate(text.split("\n"))]
        table.append([x for x in lines if x[2]])
        for a, x in enumerate(table[-1]):
            places.setdefault(x[1], []).append((d, a))
    out = {}
    for d, (doc, text) in enumerate(unique):
        lines, covered = table[d], set()
        for a, x in enumerate(lines):
            for e, c in places[x[1]]:
                if (e, c) >= (d, a):
                    break
                other = table[e]
                if a and c and lines[a - 1][1] == other[c - 1][1]:
                    continue  # this pair belongs to a run that starts before
                n = 0
                while a + n < len(lines) and c + n < len(other) and lines[a + n][1] == other[c + n][1]:
                    n += 1
                if sum(y[2] for y in lines[a : a + n]) >= W:
                    covered |= set(range(a, a + n))
        gone, a = set(), 0
        while a < len(lines):
            b = a
            while b < len(lines) and b in covered:
                b += 1
            if sum(x[2] for x in lines[a:b]) >= line_winnow.LEAST_WORDS:
                gone |= set(range(lines[a][0], lines[b - 1][0] + 1))
            a = max(b, a + 1)
        out[doc, text] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out


def test_short_last_lines(spark):
    """A run goes to its last line, however short; the earlier place of its end may be another than that of its start."""
    rows = []
    for i, sizes in enumerate([(37, 13), (45, 12), (20, 20, 12), (13, 37), (9, 9, 9, 9, 9, 9), (60, 3)]):
        run = [sentence(100 * i + j, n) for j, n in enumerate(sizes)]
        rows += [(10 * i, "\n".join(["before", *run, "after"])), (10 * i + 1, "\n".join(["else", *run, "other"])), (10 * i + 2, "\n".join(run))]
    head, tail = sentence(900, 40), sentence(901, 12)
    rows += [(90, head + "\nx"), (91, f"a\n{head}\n{tail}\nb"), (92, f"c\n{head}\n{tail}\nd")]
    got = {r["doc_id"]: r["text"] for r in line_winnow.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        assert got[10 * i + 1] == "else\nother" and got[10 * i + 2] == ""
    assert got[91] == rows[-2][1] and got[92] == "c\nd"


def test_documents(spark, odd):
    for df in (documents(spark), documents(spark, "sf0.01"), odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        want = by_lines(rows)
        got = sorted((r["doc_id"] or -1, r["text"] or "") for r in line_winnow.dedup_lines(df.repartition(3)).collect())
        assert got == sorted((d or -1, want.get((d, t)) or "") for d, t in rows)


def test_repeated_rows_are_one_document(spark, monkeypatch):
    """Copies of a row neither pile up in one list nor change what is cut."""
    text = "\n".join(sentence(500 + i, 20) for i in range(10))
    rows = [(1, text)] + [(2, text + "\nown line")] * 300 + [(3, "x\n" + text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = by_lines(rows)
    plain = line_winnow._islands

    def watched(least):
        def run(batches):
            for batch in batches:
                assert max(map(len, batch.to_pydict()["g"]), default=0) < 60
                yield from plain(least)(iter([batch]))

        return run

    monkeypatch.setattr(line_winnow, "_islands", watched)
    got = sorted((r["doc_id"], r["text"]) for r in line_winnow.dedup_lines(df).collect())
    assert got == sorted((d, want[d, t]) for d, t in rows)
