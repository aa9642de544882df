"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.  The
derived tables are stored before the clock of the first query starts and are
reported as ``prepare``; a first run of the flagship query warms the session up.
Every query is run to its last row without collecting, ``BENCH_RUNS`` times (once
unless told otherwise); the median counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "risk_by_zone",
    "sc6_annotate_numbering",
    "sc9_classify_zones_sections",
    "sc14_shape_clauses",
    "ag7_repeated_lines_layout",
    "jn13_drop_repeated_lines",
    "wn4_assign_blocks",
    "wn8_build_sections",
    "wn9_suppress_reference_headings",
    "wn12_document_parts",
    "wn14_merge_adjacent_zones",
    "wn15_mark_toc",
    "wn20_with_tree_parent",
    "wn22_repair_hyphens",
    "wn24_unwrap_lines",
    "wn25_merge_short_sections",
    "wn28_split_multi_clause",
    "jn3_assign_zone",
    "jn6_zone_text",
    "tk2_top_references",
    "ag3_risk_distribution",
    "ag15_quota_usage",
    "wn30_rate_violations",
    "wn32_throttle_progress",
    "wn17_sub_documents",
    "wn26_merge_heading_fragments",
    "jn9_reconcile_toc",
    "ag23_tree_closure",
    "ag14_dominant_language",
    "xr10_term_usages",
    "wn33_eta",
    "register_rules_sections",
    "score_fn",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config(
        "spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g")
    ).master(f"local[{cpus}]").getOrCreate()
    from catalog import QUERIES, Tables
    from catalog.views import VIEWS
    from paperloom.session import build_session

    spark = build_session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ["BENCH_QUERIES"].split(",") if "BENCH_QUERIES" in os.environ else HEADLINE

    start = time.time()
    tables = Tables(spark, folder)
    for view in VIEWS:
        getattr(tables, view)
    prepare = time.time() - start
    sections = tables.sections.count()

    def run(name: str) -> float:
        begin = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - begin

    run("risk_by_zone")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    times = {name: round(median(run(name) for _ in range(runs)), 3) for name in names}
    total = sum(times.values())
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(total, 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
                "prepare": round(prepare, 3),
                "sections_per_sec_shape_clauses": round(sections / times["sc14_shape_clauses"], 1)
                if "sc14_shape_clauses" in times
                else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
