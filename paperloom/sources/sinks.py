"""Publishing, status views, cascades and export shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..plans.scan import int_chunk, ordered_scan, running_sum

BUCKETS = 64


def publish_contract_tables(
    contracts: DataFrame, zones: DataFrame, clauses: DataFrame, path: str, buckets: int = BUCKETS, batch: str = "0"
) -> None:
    """Add the three tables under ``path`` as one batch; publishing a batch again replaces it.

    A contract with a broken zone row gets status ``error`` and neither zones
    nor clauses; broken clause rows are left out without failing the contract.
    The layout is a fixed number of buckets, and the rebalance hint lets AQE
    split an oversized bucket and merge tiny ones.
    """
    broken = zones.where(F.col("page_from").isNull() | F.col("page_to").isNull() | F.col("zone_type").isNull())
    bad = broken.select("contract_id").distinct().withColumn("__bad", F.lit(True))
    uncertain = zones.groupBy("contract_id").agg((F.count_if(~F.col("is_analysis_target")) > 0).alias("__unsure"))
    marked = contracts.join(bad, "contract_id", "left").join(uncertain, "contract_id", "left")
    status = (
        F.when(F.col("__bad"), "error").when(F.coalesce("__unsure", F.lit(False)), "filtering").otherwise("ready")
    )
    _append(marked.withColumn("status", status).drop("__bad", "__unsure"), f"{path}/contracts", buckets, batch)
    good_zones = zones.join(bad, "contract_id", "left_anti")
    _append(good_zones, f"{path}/document_zones", buckets, batch)
    good_clauses = (
        clauses.where(F.col("text").isNotNull())
        .join(bad, "contract_id", "left_anti")
        .join(good_zones.select("contract_id").distinct(), "contract_id", "left_semi")
    )
    _append(good_clauses, f"{path}/clauses", buckets, batch)


def _append(df: DataFrame, path: str, buckets: int, batch: str) -> None:
    placed = df.withColumn("bucket", F.pmod(F.xxhash64("contract_id"), F.lit(buckets)).cast("int"))
    placed.hint("rebalance", "bucket").write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).option("compression", "zstd").partitionBy(
        "bucket"
    ).parquet(f"{path}/batch={batch}")


def latest_status(status_events: DataFrame) -> DataFrame:
    """Current status per contract from the append-only event table."""
    last = F.max(F.struct("ts", "seq", "status")).alias("e")
    return status_events.groupBy("contract_id").agg(last).select("contract_id", "e.status", "e.ts")


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The four tables without the deleted contracts; running it twice changes nothing."""
    gone = ids.select("contract_id").distinct()
    gone_clauses = tables["clauses"].join(gone, "contract_id", "left_semi").select("clause_id")
    return {
        "contracts": tables["contracts"].join(gone, "contract_id", "left_anti"),
        "zones": tables["zones"].join(gone, "contract_id", "left_anti"),
        "clauses": tables["clauses"].join(gone, "contract_id", "left_anti"),
        "analyses": tables["analyses"].join(gone_clauses, "clause_id", "left_anti"),
    }


def nest_parts(contracts: DataFrame, parts: DataFrame, toc: DataFrame, subdocs: DataFrame) -> DataFrame:
    """Parts, table of contents and sub-documents as array columns of the contract."""

    def nested(df: DataFrame, index: str, cols: list[str], name: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(index, *cols)))
        return df.groupBy("contract_id").agg(items.alias(name))

    out = contracts
    for df, index, cols, name in [
        (parts, "part_index", ["part_type", "title", "page_start", "page_end", "section_count"], "document_parts"),
        (toc, "entry_index", ["title", "page_number", "level", "numbering"], "toc_entries"),
        (subdocs, "subdoc_index", ["title", "page_start", "page_end"], "sub_documents"),
    ]:
        out = out.join(nested(df, index, cols, name), "contract_id", "left")
    return out


def comparison_report(clauses: DataFrame, analyses: DataFrame) -> DataFrame:
    """Report rows: running number, title with fallbacks, risk, comparison text."""
    numbered = ordered_scan(
        clauses.select("clause_id", "contract_id", "sort_order", "title", "number"),
        ["contract_id"],
        ["sort_order", "clause_id"],
        {"no": running_sum(F.lit(1))},
        int_chunk("sort_order"),
    )
    joined = numbered.join(analyses.select("clause_id", "risk_level", "comparison"), "clause_id", "left")
    fallback = F.concat(F.lit("조항 "), F.col("no").cast("string"))
    return joined.select(
        "contract_id",
        "clause_id",
        "no",
        F.coalesce("title", "number", fallback).alias("title"),
        F.coalesce("risk_level", F.lit("-")).alias("risk_level"),
        F.coalesce("comparison", F.lit("")).alias("comparison"),
    )


def table_to_markdown(tables: DataFrame, rows_col: str) -> DataFrame:
    """Add ``markdown``: header row, rule, remaining rows; null cells are empty."""

    def row_text(row: Column) -> Column:
        cells = F.transform(row, lambda c: strip(F.coalesce(c, F.lit(""))))
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    rows = F.transform(F.col(rows_col), row_text)
    width = F.size(F.try_element_at(F.col(rows_col), F.lit(1)))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, F.size(rows))), "\n")
    return tables.withColumn("markdown", F.when(F.size(rows_col) > 0, body).otherwise(""))
