"""Filters and predicates over contracts, zones, clauses and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview, strip
from ..functions.zoning import TARGET_WHITELISTS, analysis_target

# Status groups of a contract.
IN_PROGRESS = ["analyzing", "parsing", "filtering", "partial"]
TERMINAL = ["ready", "partial", "error"]
STAGES = {"parsing": 2, "quality_checking": 3, "filtering": 5, "ready": 6, "partial": 6, "error": 5}

# Zones whose clauses are not sent to analysis.
NOT_ANALYSED_KEYS = ["preamble", "cover_page", "toc"]

RISK_LEVELS = ["high", "medium", "low", "info"]


def with_analysis_target(df: DataFrame, zone_col: str) -> DataFrame:
    return df.withColumn("is_target", analysis_target(F.col(zone_col)))


def is_target_whitelisted(df: DataFrame, zone_col: str, variant: str = "display") -> DataFrame:
    hit = F.col(zone_col).isin(TARGET_WHITELISTS[variant])
    return df.withColumn("is_target", F.coalesce(hit, F.lit(False)))


def split_by_confidence(zones: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    sure = F.col("confidence") >= threshold
    return zones.where(sure), zones.where(~sure)


def uncertain_zones(zones: DataFrame) -> DataFrame:
    """Zones nobody has decided on yet, with a text preview."""
    open_zone = (F.col("is_analysis_target") == False) & F.col("user_confirmed").isNull()  # noqa: E712
    return zones.where(open_zone).select(
        F.col("zone_id").alias("id"),
        F.col("zone_type").alias("type"),
        "confidence",
        preview(F.col("text"), 200).alias("preview"),
        "page_from",
        "page_to",
    )


def apply_zone_decisions(zones: DataFrame, include: DataFrame, exclude: DataFrame) -> DataFrame:
    """User decisions by zone id; a zone in both lists ends up excluded."""
    inc = include.select("zone_id").distinct().withColumn("__inc", F.lit(True))
    exc = exclude.select("zone_id").distinct().withColumn("__exc", F.lit(True))
    joined = zones.join(inc, "zone_id", "left").join(exc, "zone_id", "left")
    decided = F.col("__inc").isNotNull() | F.col("__exc").isNotNull()
    return joined.withColumns(
        {
            "is_analysis_target": F.when(F.col("__exc"), False)
            .when(F.col("__inc"), True)
            .otherwise(F.col("is_analysis_target")),
            "user_confirmed": F.when(decided, True).otherwise(F.col("user_confirmed")),
        }
    ).drop("__inc", "__exc")


def status_after_decisions(contracts: DataFrame, decided: DataFrame) -> DataFrame:
    """Contracts with confirmed zone decisions become ``ready``."""
    done = decided.select("contract_id").distinct().withColumn("__done", F.lit(True))
    return (
        contracts.join(done, "contract_id", "left")
        .withColumn("status", F.when(F.col("__done"), "ready").otherwise(F.col("status")))
        .drop("__done")
    )


def analysable_clauses(clauses: DataFrame) -> DataFrame:
    return clauses.where(F.col("zone_key").isNull() | ~F.col("zone_key").isin(NOT_ANALYSED_KEYS))


def filter_clauses(clauses: DataFrame, risk: str = "ALL", zone: str = "ALL", query: str = "") -> DataFrame:
    """Risk, zone and free-text filter of the clause list."""
    out = clauses
    if risk != "ALL":
        out = out.where(F.upper("risk_level") == risk)
    if zone != "ALL":
        out = out.where(F.col("zone_key").isNull() | (F.col("zone_key") == zone))
    if query.strip():
        q = F.lit(query.lower())
        found = [F.coalesce(F.contains(F.lower(c), q), F.lit(False)) for c in ("text", "title", "number")]
        out = out.where(found[0] | found[1] | found[2])
    return out


def filter_contracts(contracts: DataFrame, status_group: str, query: str, deleted: DataFrame | None) -> DataFrame:
    out = contracts
    if deleted is not None:
        out = out.join(deleted.select("contract_id"), "contract_id", "left_anti")
    if status_group == "in_progress":
        out = out.where(F.col("status").isin(IN_PROGRESS))
    elif status_group != "all":
        out = out.where(F.col("status") == status_group)
    if query.strip():
        out = out.where(F.contains(F.lower("name"), F.lit(query.strip().lower())))
    return out


def secure_view(df: DataFrame, contracts: DataFrame, user_id: object, role: str, clauses: DataFrame | None = None) -> DataFrame:
    """Row-level access: everything for the service role, else rows of own contracts.

    Contracts carry the owner, zones and clauses a contract id, analyses only
    a clause id (then ``clauses`` leads to the contract).
    """
    if role == "service_role":
        return df
    if "user_id" in df.columns:
        return df.where(F.col("user_id") == F.lit(user_id))
    own = contracts.where(F.col("user_id") == F.lit(user_id)).select("contract_id")
    if "contract_id" in df.columns:
        return df.join(own, "contract_id", "left_semi")
    own_clauses = clauses.join(own, "contract_id", "left_semi").select("clause_id")
    return df.join(own_clauses, "clause_id", "left_semi")


visible_rows = secure_view


def with_status_class(df: DataFrame) -> DataFrame:
    stage = F.lit(1)
    for status, n in STAGES.items():
        stage = F.when(F.col("status") == status, n).otherwise(stage)
    return df.withColumns(
        {"in_progress": F.col("status").isin(IN_PROGRESS), "done": F.col("status").isin(TERMINAL), "stage": stage}
    )


def with_auto_number_flag(clauses: DataFrame) -> DataFrame:
    n = F.coalesce(F.col("number"), F.lit(""))
    auto = (n == "") | n.contains("-auto-") | n.startswith("preamble") | n.endswith("-intro") | n.rlike(r"^[a-z_]+-\d+$")
    return clauses.withColumn("is_auto_number", auto)


def with_confidence_band(zones: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return zones.withColumn("band", F.when(c >= 0.90, "high").when(c >= 0.82, "medium").otherwise("low"))


def drop_lines_in_tables(lines: DataFrame, table_boxes: DataFrame, tol: float = 2.0) -> DataFrame:
    """Lines that lie inside a detected table of their page are removed.

    The pairing stays inside one page, which bounds it by nature.
    """
    boxes = table_boxes.select(
        F.col("contract_id").alias("b_contract"),
        F.col("page").alias("b_page"),
        F.col("x0").alias("bx0"),
        F.col("y0").alias("by0"),
        F.col("x1").alias("bx1"),
        F.col("y1").alias("by1"),
    )
    inside = (
        (F.col("contract_id") == F.col("b_contract"))
        & (F.col("page") == F.col("b_page"))
        & (F.col("x0") >= F.col("bx0") - tol)
        & (F.col("y0") >= F.col("by0") - tol)
        & (F.col("x1") <= F.col("bx1") + tol)
        & (F.col("y1") <= F.col("by1") + tol)
    )
    return lines.join(boxes, inside, "left_anti")


def ghost_table(rows: Column) -> Column:
    """A table that is noise: too small, too short or mostly bracketed notes."""
    cells = F.filter(
        F.transform(F.flatten(rows), lambda c: F.trim(c)), lambda c: c.isNotNull()
    )
    filled = F.filter(cells, lambda c: c != "")
    bracketed = F.filter(filled, lambda c: c.startswith("[") | c.endswith("]"))
    width = F.array_max(F.transform(rows, F.size))
    return F.coalesce(
        (F.size(rows) <= 1)
        | (width <= 1)
        | (F.length(F.array_join(cells, " ")) < 15)
        | ((F.size(filled) > 0) & (F.size(bracketed) / F.size(filled) > 0.5)),
        F.lit(True),
    )


def drop_ghost_tables(tables: DataFrame, rows_col: str = "rows") -> DataFrame:
    return tables.where(~ghost_table(F.col(rows_col)))


def detect_scans(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Contracts without sections whose pages hold almost no words on average."""
    bare = pages.join(sections.select("contract_id").distinct(), "contract_id", "left_anti")
    t = strip(F.col("text"))
    words = F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))
    avg = F.sum(words) / F.count(F.lit(1))
    return (
        bare.groupBy("contract_id")
        .agg(avg.alias("avg_words"))
        .withColumn("is_scan", F.col("avg_words") < 10)
    )


def risk_level(level: Column, summary: Column) -> Column:
    """The recognised level, else the level the summary talks about, else info."""
    s = F.lower(F.coalesce(summary, F.lit("")))
    return (
        F.when(level.isin(RISK_LEVELS), level)
        .when(s.rlike(r"\bhigh\b|높음|심각"), "high")
        .when(s.rlike(r"\bmedium\b|중간|주의"), "medium")
        .when(s.rlike(r"\blow\b|낮음"), "low")
        .otherwise("info")
    )


def normalize_risk(level: Column) -> Column:
    """Case-insensitive recognised level or null (display rule)."""
    return F.when(F.lower(level).isin(RISK_LEVELS), F.lower(level))
