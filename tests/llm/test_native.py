"""Host reputation and quality rules on odd rows; that the rules run no Python."""

from paperloom.llm import host_reputation, quality_rules
from paperloom.llm.queries import URL_RULES


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM:8080?x", "x://y/en/a://b", "http://example.com/en/", "http://www.example.com/en/x#f", "http://notexample.com/en/", "http://a.net/es", "http://a.net/es/?q", "http://bad.host.org/1\n2"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    seen = [("bad.host.org", 0)] * 40 + [("good.host.org", 1)] * 40 + [("b.other.org", 1)] * 40 + [(None, 1), ("x.org", None), ("x.org", 7)]
    got = {r["page_id"]: r for r in host_reputation.judge_urls(pages, spark.createDataFrame(seen, "host string, good int"), URL_RULES).collect()}
    assert [(r["host"], r["path"]) for _, r in sorted(got.items())][:6] == [("", "")] * 4 + [("a.example.com:8080", ""), ("y", "/en/a://b")]
    assert got[6]["rule"] == "example.com/en/" and got[7]["rule"] == "www.example.com/en/" and got[8]["rule"] == "com/" and got[9]["rule"] is None and got[10]["rule"] == "net/es/"
    assert got[11]["verdict"] == "block" and got[0]["verdict"] == "allow" and got[5]["verdict"] == "allow"
    empty = host_reputation.judge_urls(pages, spark.createDataFrame([], "host string, good int"), []).collect()
    assert len(empty) == len(urls) and {r["verdict"] for r in empty} == {"allow"}
    assert host_reputation.judge_urls(pages.limit(0), spark.createDataFrame(seen, "host string, good int"), URL_RULES).count() == 0


def test_shrinkage(spark):
    """A small host is drawn to its domain, a large one keeps its own rate."""
    seen = [("big.spam.org", 0)] * 300 + [("tiny.spam.org", 1)] + [("x.fine.org", 1)] * 300 + [("tiny.fine.org", 0)]
    rep = {r["host"]: r for r in host_reputation.reputation(spark.createDataFrame(seen, "host string, good int")).collect()}
    assert rep["big.spam.org"]["post_mean"] < rep["tiny.spam.org"]["post_mean"] < 0.5 < rep["tiny.fine.org"]["post_mean"] < rep["x.fine.org"]["post_mean"]


def covered(words, size=8):
    seen, marks = {}, set()
    for i in range(len(words) - size + 1):
        seen.setdefault(tuple(words[i : i + size]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            marks |= {i + j for i in at for j in range(size)}
    return len(marks)


def test_rules(spark, odd, none):
    import re

    base = [f"w{i}" for i in range(20)]
    texts = [" ".join(base + ["x"] + base), " ".join(["same"] * 30), " ".join(base[:8] + base[:8]), " ".join(["a", "b", "c"] * 9), "one\n\n two\none\n \n"]
    df = odd.unionByName(spark.createDataFrame([(50 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    out = quality_rules.quality_rules(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("BroadcastExchange", "")
    for r in out.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        lines = [x for x in (r["text"] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), covered(words), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(words) < 20 or 100 * covered(words) > 30 * len(words)) and not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(none).count() == 0


def test_unlabelled_hosts(spark):
    """A host without outcomes has the prior of its domain, else of its suffix, else of all; it moves no other."""
    seen = [(f"h{i % 8}.spam.org", 0) for i in range(400)] + [(f"h{i % 8}.fine.org", 1) for i in range(400)] + [(f"d{i % 40}.bad", int(i % 40 == 0)) for i in range(800)]
    outcomes = spark.createDataFrame(seen, "host string, good int")
    hosts = ["new.spam.org", "a.b.spam.org:8080", "new.fine.org", "new.bad", "www.d7.bad", "new.zz", "h1.spam.org", "h1.fine.org"]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r["host"]: r for r in host_reputation.judge_urls(pages, outcomes, []).collect()}
    assert {h: r["verdict"] for h, r in got.items()} == dict(zip(hosts, ["block", "block", "allow", "block", "block", "allow", "block", "allow"]))
    assert all(r["upper_bound"] is not None for r in got.values())
    asked = host_reputation.reputation(outcomes, pages.selectExpr("substring(url, 8, length(url) - 8) as host")).collect()
    plain = {r["host"]: (r["pages"], round(r["post_mean"], 9), round(r["post_strength"], 6)) for r in host_reputation.reputation(outcomes).collect()}
    assert {r["host"]: (r["pages"], round(r["post_mean"], 9), round(r["post_strength"], 6)) for r in asked if r["pages"]} == plain
    assert {r["host"] for r in asked if not r["pages"]} == set(hosts[:6])


def test_clashing_columns_stay(spark):
    """Helper columns take names that are free; columns named like a measure are replaced."""
    df = spark.createDataFrame([(1, "a b", 7, 8, 9, 10, 11, 12)], "doc_id long, text string, _m int, _l int, _words0 int, _lines0 int, n_lines int, kept int")
    r = quality_rules.quality_rules(df).first()
    assert (r["_m"], r["_l"], r["_words0"], r["_lines0"]) == (7, 8, 9, 10) and (r["n_lines"], r["kept"]) == (1, False)
