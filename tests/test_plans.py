"""Plan shapes that must hold at scale."""

from pyspark.sql import functions as F

from catalog import QUERIES, Tables
from paperloom.operators import filters as fl
from paperloom.sources import tables as src

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    df = src.read_table(spark, f"{FOLDER}/events.parquet", ["event_id", "event_type"], {"event_type": "click"}, [])
    text = plan(df)
    assert "EqualTo(event_type,click)" in text and "ReadSchema: struct<event_id:bigint,event_type:string>" in text


def test_status_filter_reaches_the_scan(spark):
    t = Tables(spark, FOLDER)
    text = plan(fl.filter_contracts(t.contracts, "in_progress", "", None).select("contract_id"))
    assert "PushedFilters: [In(status" in text and "ReadSchema: struct<contract_id:bigint,status:string>" in text


def test_line_rules_need_no_shuffle(spark):
    for name in ("wn23_reflow_paragraphs", "wn24_unwrap_lines", "wn28_split_multi_clause", "wn29_resplit_clauses", "wn6_split_clauses_text", "sc14_shape_clauses"):
        text = plan(QUERIES[name](spark, FOLDER))
        if name != "sc14_shape_clauses":
            assert "Exchange" not in text, name


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["tk2_top_references"](spark, FOLDER))
    assert "WindowGroupLimit" in plan(QUERIES["tk4_quality_preview"](spark, FOLDER))


def test_counts_are_partially_aggregated(spark):
    text = plan(QUERIES["ag3_risk_distribution"](spark, FOLDER))
    assert "partial_count" in text


def test_publish_layout(spark, tmp_path):
    from paperloom.sources.sinks import publish_contract_tables

    t = Tables(spark, FOLDER)
    publish_contract_tables(t.contracts, t.zones, t.clauses, str(tmp_path / "out"), buckets=4)
    back = spark.read.parquet(str(tmp_path / "out" / "clauses"))
    assert back.count() == t.clauses.count() and set(r[0] for r in back.select("bucket").distinct().collect()) <= {0, 1, 2, 3}
    assert back.where(F.col("bucket").isNull()).count() == 0


def test_a_scan_shuffles_the_wide_table_once(spark):
    """Exchanges: the wide table by (key, chunk), the summaries by the same and by the key, and back to the join."""
    from paperloom.plans.scan import ordered_scan, running_sum

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.read.parquet(f"{FOLDER}/events.parquet").select("user_id", "event_type", "event_id", "value")
        for by in (["user_id"], ["user_id", "event_type"]):
            text = plan(ordered_scan(df, by, ["event_id"], {"n": running_sum(F.lit(1))}, F.floor(F.col("event_id") / 100)))
            wide = [x for x in text.split("\n") if "Exchange hashpartitioning" in x]
            assert len(wide) == 4, text
            assert text.count("Sort [") + text.count("Sort(") <= 3, text
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
