"""Aggregates, lists and trees behind the dashboard and detail views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import clause_depth
from ..functions.zoning import ZONE_ORDER
from ..plans.scan import int_chunk, island, last_value, ordered_scan, page_chunk, range_chunked, running_max, running_sum, time_chunk
from ..plans.scratch import cut
from .filters import IN_PROGRESS, RISK_LEVELS, normalize_risk

# Risk categories of the dashboard and the words that name them.
RISK_CATEGORIES = {
    "liability": ["limitation of liability", "liability", "책임 제한"],
    "delay damages": ["liquidated damages", "delay damages", "지체상금"],
    "termination": ["termination", "terminate", "계약 해지"],
    "indemnity": ["indemnity", "indemnif", "면책"],
    "force majeure": ["force majeure", "불가항력"],
}

# Share of each processing stage in the overall progress.
STAGE_WEIGHTS = {1: 0.01, 2: 0.93, 3: 0.05, 4: 0.01, 5: 0.0}


def _one_row(frames: list[DataFrame]) -> DataFrame:
    """Merge one-row aggregates side by side without a cross join."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in out.columns])


def dashboard_stats(contracts: DataFrame, clauses: DataFrame, analyses: DataFrame) -> DataFrame:
    per_contract = contracts.agg(
        F.count(F.lit(1)).alias("total_contracts"),
        F.count_if(F.col("status").isin("ready")).alias("completed"),
        F.count_if(F.col("status").isin(IN_PROGRESS)).alias("in_progress"),
    )
    level = normalize_risk(F.col("risk_level"))
    known = analyses.join(clauses.select("clause_id"), "clause_id", "left_semi")
    per_clause = known.agg(
        F.count(F.lit(1)).alias("analysed_clauses"), *[F.count_if(level == r).alias(r) for r in RISK_LEVELS]
    )
    return _one_row([per_contract, per_clause])


def status_counts(contracts: DataFrame) -> DataFrame:
    s = F.col("status")
    return contracts.agg(
        F.count(F.lit(1)).alias("all"),
        F.count_if(s == "ready").alias("ready"),
        F.count_if(s.isin(IN_PROGRESS)).alias("in_progress"),
        F.count_if(s == "error").alias("error"),
    )


def risk_distribution(clauses: DataFrame, analyses: DataFrame) -> DataFrame:
    joined = clauses.select("clause_id", "contract_id").join(
        analyses.select("clause_id", "risk_level", F.lit(True).alias("__seen")), "clause_id", "left"
    )
    level = normalize_risk(F.col("risk_level"))
    return joined.groupBy("contract_id").agg(
        *[F.count_if(level == r).alias(r) for r in RISK_LEVELS],
        F.count_if(F.col("__seen").isNotNull()).alias("analysed"),
        F.count_if(F.col("__seen").isNull()).alias("unanalysed"),
    )


def section_risk_stats(clauses: DataFrame, analyses: DataFrame) -> DataFrame:
    """Counts per zone; the level info is counted nowhere, as in the view."""
    joined = clauses.select("clause_id", "contract_id", "zone").join(
        analyses.select("clause_id", "risk_level"), "clause_id", "left"
    )
    level = F.lower("risk_level")
    return joined.groupBy("contract_id", "zone").agg(
        *[F.count_if(level == r).alias(r) for r in ("high", "medium", "low")],
        F.count_if(F.col("risk_level").isNull()).alias("unanalysed"),
    )


def with_bar_ratio(stats: DataFrame) -> DataFrame:
    """Long form of one row of risk counts with value / max(values, 1)."""
    top = F.greatest(*[F.col(r) for r in RISK_LEVELS], F.lit(1))
    bars = F.array(
        *[F.struct(F.lit(r).alias("level"), F.col(r).alias("value"), (F.col(r) / top).alias("ratio")) for r in RISK_LEVELS]
    )
    keep = [c for c in stats.columns if c == "contract_id"]
    return stats.select(*keep, F.explode(bars).alias("b")).select(*keep, "b.*")


def zone_totals(zones: DataFrame) -> DataFrame:
    target = F.col("is_analysis_target")
    return zones.groupBy("contract_id").agg(
        F.count_if(target).alias("targets"),
        F.count_if(~target).alias("uncertain"),
        F.when(F.count_if(~target) > 0, "filtering").otherwise("ready").alias("status"),
    )


def clauses_by_zone(clauses: DataFrame) -> DataFrame:
    """Clause ids per zone in reading order.

    A zone of ordinary size is one row (``piece`` 0).  A huge one comes in
    pieces of bounded length, so no array grows with the data.
    """
    ids = F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "clause_id"))), lambda x: x["clause_id"])
    return clauses.groupBy("contract_id", "zone", int_chunk("sort_order").alias("piece")).agg(ids.alias("clauses"))


def group_zones(zones: DataFrame, depth: int = 1) -> DataFrame:
    """Zones grouped by part (depth 1) or by sub-document and part (depth 2).

    Groups appear in the order of their first zone, whose pages also give the
    group its label.
    """
    keys = ["contract_id", "part_title"] if depth == 1 else ["contract_id", "subdoc_title", "part_title"]
    label = F.when(
        F.col("page_from").isNotNull() & F.col("page_to").isNotNull(),
        F.concat(F.lit("pp."), F.col("page_from").cast("string"), F.lit("–"), F.col("page_to").cast("string")),
    )
    members = F.transform(F.array_sort(F.collect_list(F.struct("zone_index", "zone_id"))), lambda x: x["zone_id"])
    first = F.min_by(F.struct(label.alias("v")), "zone_index")["v"]
    groups = zones.groupBy(*keys).agg(
        F.min("zone_index").alias("first_zone"), first.alias("page_label"), members.alias("zones")
    )
    if depth == 1:
        return groups
    parts = F.array_sort(F.collect_list(F.struct("first_zone", "part_title", "page_label", "zones")))
    return groups.groupBy("contract_id", "subdoc_title").agg(
        F.min("first_zone").alias("first_zone"), parts.alias("parts")
    )


def first_index(df: DataFrame, key: list[str], idx: str) -> DataFrame:
    return df.groupBy(*key).agg(F.min(idx).alias(idx))


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / F.lit(size)))


def duplicate_census(clauses: DataFrame) -> DataFrame:
    return clauses.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))


def top_risk_categories(clauses: DataFrame, categories: dict[str, list[str]] | None = None, k: int = 5) -> DataFrame:
    """Clauses per risk category, most frequent first; categories without a hit stay with 0."""
    cats = categories or RISK_CATEGORIES
    text = F.lower(F.concat_ws(" ", "title", "text"))
    hits = []
    for name, words in cats.items():
        test = F.lit(False)
        for w in words:
            test = test | text.contains(w)
        hits.append(F.count_if(F.coalesce(test, F.lit(False))).alias(name))
    wide = clauses.agg(*hits)
    pairs = F.array(*[F.struct(F.lit(n).alias("category"), F.col(n).alias("n")) for n in cats])
    return wide.select(F.explode(pairs).alias("p")).select("p.*").orderBy(F.desc("n"), "category").limit(k)


def stage_progress(progress: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """Overall percentage: weights of finished stages plus the share of the current one."""
    w = weights or STAGE_WEIGHTS
    done = F.lit(0.0)
    for stage, weight in w.items():
        part = F.when(F.col("stage") > stage, F.lit(weight)).when(
            F.col("stage") == stage, F.lit(weight) * F.col("stage_progress") / 100.0
        )
        done = done + F.coalesce(part, F.lit(0.0))
    overall = F.round(done / F.lit(sum(w.values())) * 1000.0) / 10.0
    return progress.withColumn("overall", F.when(F.col("stage") == 0, 0.0).when(F.col("done"), 100.0).otherwise(overall))


# ---------------------------------------------------------------- lists


def list_contracts(
    contracts: DataFrame, sort: str = "updated_at", asc: bool = False, page: int = 1, limit: int = 20
) -> DataFrame:
    """One page of the contract list; out-of-range arguments are clamped."""
    key = sort if sort in ("created_at", "name", "status") else "updated_at"
    size = min(100, max(1, limit))
    skip = (max(1, page) - 1) * size
    order = F.col(key).asc() if asc else F.col(key).desc()
    return contracts.orderBy(order, "contract_id").offset(skip).limit(size)


def order_zone_sections(groups: DataFrame, zone_order: list[str] | None = None) -> DataFrame:
    """Rank of each zone section: canonical order first, others by first appearance."""
    ranks = zone_order or ZONE_ORDER
    rank = F.coalesce(
        F.try_element_at(
            F.create_map(*[v for i, z in enumerate(ranks) for v in (F.lit(z), F.lit(i))]), F.col("zone")
        ),
        F.lit(99),
    )
    return groups.withColumn("zone_rank", rank).orderBy("contract_id", "zone_rank", "first_seen")


def order_sections(sections: DataFrame) -> DataFrame:
    """Reading order: by first page, then parser order."""
    scanned = ordered_scan(
        sections,
        ["contract_id"],
        ["page_start", "section_index"],
        {"__n": running_sum(F.lit(1))},
        page_chunk(),
    )
    return scanned.withColumn("order_index", F.col("__n") - 1).drop("__n")


def order_parts(parts: DataFrame) -> DataFrame:
    return parts.orderBy("contract_id", "page_start", "part_index")


def order_lines(lines: DataFrame) -> DataFrame:
    return lines.orderBy("contract_id", "page", "y0", "x0")


def quality_preview(clauses: DataFrame, n: int = 8) -> DataFrame:
    """First clauses of a contract as ``k. [len ch] start`` lines."""
    from pyspark.sql import Window as W

    w = W.partitionBy("contract_id").orderBy("sort_order", "clause_id")
    # row_number <= n is turned into a group limit before the shuffle
    top = clauses.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n)
    line = F.concat(
        F.col("__k").cast("string"),
        F.lit(". ["),
        F.length("text").cast("string"),
        F.lit("ch] "),
        F.substring("text", 1, 30),
    )
    items = F.array_sort(F.collect_list(F.struct("__k", line.alias("t"))))
    return top.groupBy("contract_id").agg(
        F.array_join(F.transform(items, lambda x: x["t"]), "\n").alias("preview")
    )


# ---------------------------------------------------------------- positions and trees


def with_position(df: DataFrame, key: list[str], order: list[str], chunk=None, out: str = "idx") -> DataFrame:
    """0-based position inside a key."""
    scanned = ordered_scan(df, key, order, {"__n": running_sum(F.lit(1))}, chunk)
    return scanned.withColumn(out, F.col("__n") - 1).drop("__n")


def backfill_sort_order(clauses: DataFrame) -> DataFrame:
    """Position by creation time.

    Clauses of one import share their time, so the time cannot split a huge
    contract; ranges of the whole order can.
    """
    order = ["created_at", "clause_id"]
    narrow = range_chunked(clauses.select("contract_id", *order), ["contract_id"], order)
    placed = with_position(narrow, ["contract_id"], order, F.col("range_chunk"), "sort_order")
    return clauses.join(placed.select("clause_id", "sort_order"), "clause_id")


def with_tree_parent(clauses: DataFrame) -> DataFrame:
    """Depth of every clause and the nearest earlier clause that is shallower."""
    base = clauses.withColumn("depth", clause_depth(F.col("number")))
    here = F.struct(F.col("sort_order").alias("o"), F.col("clause_id").alias("id"))
    steps = {f"__d{d}": last_value(F.when(F.col("depth") == d, here)) for d in range(4)}
    scanned = ordered_scan(base, ["contract_id"], ["sort_order", "clause_id"], steps, int_chunk("sort_order"))
    above = [F.when(F.col("depth") > d, F.col(f"__d{d}")) for d in range(4)]
    return scanned.withColumn("parent_id", F.greatest(*above)["id"]).drop(*steps)


def tree_closure(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, dist) pairs; depth is at most 4, so are the hops.

    The narrow edges are stored once, so the hops don't compute the tree again.
    """
    edges = cut(
        tree.where(F.col("parent_id").isNotNull()).select(
            "contract_id", F.col("clause_id").alias("descendant"), F.col("parent_id").alias("ancestor")
        ),
        "tree-edges",
    )
    up = edges.select("contract_id", F.col("descendant").alias("ancestor"), F.col("ancestor").alias("__up"))
    level = edges.withColumn("dist", F.lit(1))
    out = level
    for hop in range(2, 5):
        level = level.join(up, ["contract_id", "ancestor"]).select(
            "contract_id", "descendant", F.col("__up").alias("ancestor"), F.lit(hop).alias("dist")
        )
        out = out.unionByName(level)
    return out


def descendant_counts(closure: DataFrame) -> DataFrame:
    return closure.groupBy("contract_id", "ancestor").agg(F.count(F.lit(1)).alias("descendants"))


def subdoc_runs(clauses: DataFrame) -> DataFrame:
    """Number the runs of consecutive clauses with the same sub-document."""
    runs = ordered_scan(
        clauses, ["contract_id"], ["sort_order", "clause_id"], {"__run": island(F.col("subdoc_title"))}, int_chunk("sort_order")
    )
    return runs.withColumn("run_id", F.col("__run") - 1).drop("__run")


def monotone_stage(status_events: DataFrame) -> DataFrame:
    """Stage of a contract over time; it never goes back."""
    return ordered_scan(
        status_events, ["contract_id"], ["ts", "seq"], {"max_stage": running_max(F.col("stage"))}, time_chunk("ts")
    )
