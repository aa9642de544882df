"""Queries with an SQL twin against it, on the smallest given tables."""

import duckdb
import pytest

from paperloom.llm.oracles import ORACLES
from paperloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark):
    con = duckdb.connect()
    for t in "documents pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    res = con.execute(f"select {', '.join(cols)} from ({ORACLES[name]})")
    assert ordered(df.select(cols).collect()) == ordered(res.fetchall())


def test_reputation_twin_blocks_where_the_method_does(spark, tmp_path):
    """Hosts without outcomes, with few and with many, under all three levels: rows that the method blocks, without any rule."""
    hosts = ["a.bad.org", "b.bad.org", "new.bad.org", "x.good.org", "new.good.org", "c.bad2.xx", "new.yy", "other.xx", ""]
    pages = [(i, f"http://{hosts[i % 9]}/p{i}" if i % 50 else None) for i in range(900)]
    labels = [(i, int(hosts[i % 9].endswith("good.org")), 0) for i in range(900) if hosts[i % 9] and "new" not in hosts[i % 9]] + [(5, 7, 0), (6, None, 0)]
    spark.createDataFrame(pages, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = ordered(QUERIES["op1_host_reputation"](spark, str(tmp_path)).select("host", "page_id", "path", "rule", "verdict").collect())
    assert got == ordered(con.execute(f"select host, page_id, path, rule, verdict from ({ORACLES['op1_host_reputation']})").fetchall())
    blocked = {r[0] for r in got if r[4] == "block"}
    assert {"a.bad.org", "new.bad.org"} <= blocked and "new.good.org" not in blocked
