"""Joins between clauses, zones, parts, analyses and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..plans.ranges import first_range_by_page, range_pages


def ordered_text(text, order: list[str], sep: str):
    """Concatenate a text column of a group in the given order."""
    items = F.array_sort(F.collect_list(F.struct(*order, text.alias("__t"))))
    return F.array_join(F.transform(items, lambda x: x["__t"]), sep)


def section_text(heading: str = "heading", content: str = "content"):
    """Heading and content of a section as one text."""
    h, c = F.coalesce(F.col(heading), F.lit("")), F.coalesce(F.col(content), F.lit(""))
    return strip(F.when(h != "", F.concat(h, F.lit("\n"), c)).otherwise(c))


def with_analyses(clauses: DataFrame, analyses: DataFrame) -> DataFrame:
    return clauses.join(analyses.select("clause_id", "risk_level"), "clause_id", "left")


def with_zone_key(clauses: DataFrame, zones: DataFrame) -> DataFrame:
    """Zone type through the zone id, else the clause's own key, else unknown."""
    z = zones.select("zone_id", "zone_type")
    return (
        clauses.join(z, "zone_id", "left")
        .withColumn("zone", F.coalesce("zone_type", "zone_key", F.lit("unknown")))
        .drop("zone_type")
    )


def assign_zone(clauses: DataFrame, zones: DataFrame) -> DataFrame:
    """First zone whose pages hold the clause, else first zone of its type, else 0."""
    by_page = first_range_by_page(
        zones, ["contract_id"], "page_from", "page_to", F.col("zone_index"), {"zp": F.col("zone_index")}
    ).withColumnRenamed("page", "page_start")
    by_type = zones.groupBy("contract_id", F.col("zone_type").alias("zone_key")).agg(F.min("zone_index").alias("zt"))
    return (
        clauses.join(by_page, ["contract_id", "page_start"], "left")
        .join(by_type, ["contract_id", "zone_key"], "left")
        .withColumn("zone_index", F.coalesce("zp", "zt", F.lit(0)))
        .drop("zp", "zt")
    )


def label_zones(zones: DataFrame, parts: DataFrame, subdocs: DataFrame) -> DataFrame:
    """Titles of the first part and sub-document that contain the zone's first page."""
    p = first_range_by_page(
        parts, ["contract_id"], "page_start", "page_end", F.col("part_index"), {"part_title": F.col("title")}
    )
    s = first_range_by_page(
        subdocs, ["contract_id"], "page_start", "page_end", F.col("subdoc_index"), {"subdoc_title": F.col("title")}
    )
    keyed = zones.withColumn("page", F.col("page_from"))
    return keyed.join(p, ["contract_id", "page"], "left").join(s, ["contract_id", "page"], "left").drop("page")


def label_clauses(clauses: DataFrame, zones: DataFrame, subdocs: DataFrame) -> DataFrame:
    """Sub-document of a clause through the first page of its zone."""
    s = first_range_by_page(
        subdocs, ["contract_id"], "page_start", "page_end", F.col("subdoc_index"), {"subdoc_title": F.col("title")}
    )
    z = zones.select("zone_id", F.col("page_from").alias("page"))
    return clauses.join(z, "zone_id", "left").join(s, ["contract_id", "page"], "left").drop("page")


def zone_text(parts: DataFrame, sections: DataFrame) -> DataFrame:
    """Text of the sections that lie completely inside a part."""
    pages = range_pages(
        parts, "page_start", "page_end", ["contract_id", "part_index", F.col("page_end").alias("part_end")], "page_start"
    )
    body = sections.select("contract_id", "section_index", "page_start", "page_end", section_text().alias("__text"))
    inside = pages.join(body, ["contract_id", "page_start"]).where(
        (F.col("page_end") <= F.col("part_end")) & (F.col("__text") != "")
    )
    texts = inside.groupBy("contract_id", "part_index").agg(
        ordered_text(F.col("__text"), ["section_index"], "\n\n").alias("text")
    )
    return parts.join(texts, ["contract_id", "part_index"], "left")


def pending_clauses(clauses: DataFrame, analyses: DataFrame) -> DataFrame:
    return clauses.join(analyses.select("clause_id"), "clause_id", "left_anti")


def owned(df: DataFrame, contracts: DataFrame, user_id: object) -> DataFrame:
    mine = contracts.where(F.col("user_id") == F.lit(user_id)).select("contract_id")
    return df.join(mine, "contract_id", "left_semi")


def resolve_zone_id(clauses: DataFrame, zones: DataFrame) -> DataFrame:
    """Zone position -> stored zone id, falling back to position 0."""
    ids = zones.select("contract_id", "zone_index", "zone_id")
    first = ids.where(F.col("zone_index") == 0).select("contract_id", F.col("zone_id").alias("zone0"))
    return (
        clauses.drop("zone_id")
        .join(ids, ["contract_id", "zone_index"], "left")
        .join(first, "contract_id", "left")
        .withColumn("zone_id", F.coalesce("zone_id", "zone0"))
        .drop("zone0")
    )


def orphan_rows(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key).distinct(), key, "left_anti")


def add_preamble_zone(zones: DataFrame, sections: DataFrame) -> DataFrame:
    """Prepend a synthetic preamble zone (index -1) where no part is one."""
    have = zones.where(F.col("zone_type") == "preamble").select("contract_id").distinct()
    pre = sections.where(F.col("zone_hint") == "preamble").withColumn("__text", section_text())
    made = (
        pre.groupBy("contract_id")
        .agg(
            F.min_by("page_start", "section_index").alias("page_from"),
            F.max_by("page_end", "section_index").alias("page_to"),
            F.array_join(
                F.transform(
                    F.array_sort(
                        F.collect_list(F.when(F.col("__text") != "", F.struct("section_index", F.col("__text"))))
                    ),
                    lambda x: x["__text"],
                ),
                "\n\n",
            ).alias("text"),
        )
        .where(F.col("text") != "")
        .join(have, "contract_id", "left_anti")
        .select(
            "contract_id",
            F.lit(-1).alias("zone_index"),
            "page_from",
            "page_to",
            F.lit("preamble").alias("zone_type"),
            F.lit("전문").alias("title"),
            F.lit(0.85).alias("confidence"),
            F.lit(False).alias("is_analysis_target"),
            "text",
        )
    )
    return zones.unionByName(made, allowMissingColumns=True)


def union_parts(parts: DataFrame, inserts: DataFrame) -> DataFrame:
    return parts.unionByName(inserts, allowMissingColumns=True)


def with_fallback_rows(contracts: DataFrame, rows: DataFrame, sections: DataFrame) -> DataFrame:
    """One auto-split row for every contract that got none.

    Its text is the content of the sections outside TOC and cover page, or of
    all sections when nothing else is left.
    """
    missing = contracts.select("contract_id").join(rows.select("contract_id").distinct(), "contract_id", "left_anti")
    skip = F.coalesce(F.col("zone_hint").isin("toc", "cover_page"), F.lit(False))
    src = sections.join(missing, "contract_id", "left_semi").withColumn("__skip", skip)
    body = F.coalesce(F.col("content"), F.lit(""))
    order = ["page_start", "section_index"]
    made = (
        src.groupBy("contract_id")
        .agg(
            F.min("__skip").alias("__all_skipped"),
            F.array_sort(F.collect_list(F.struct(*order, "__skip", body.alias("t")))).alias("__items"),
        )
        .withColumn(
            "text",
            strip(
                F.array_join(
                    F.transform(
                        F.filter("__items", lambda x: F.col("__all_skipped") | ~x["__skip"]), lambda x: x["t"]
                    ),
                    "\n\n",
                )
            ),
        )
        .where(F.col("text") != "")
        .select(
            "contract_id",
            F.lit(0).cast("long").alias("order_index"),
            F.lit("contract_body-auto-1").alias("number"),
            "text",
            F.lit(True).alias("is_auto_split"),
        )
    )
    return rows.unionByName(made, allowMissingColumns=True)


def distinct_patterns(df: DataFrame) -> DataFrame:
    return df.select("contract_id", "norm").distinct()


def parity_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Row counts per key that differ between two tables."""
    both = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        b.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    counts = both.groupBy(key).agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"))
    return counts.where(F.col("left_rows") != F.col("right_rows"))
