"""Tables of contents, their reconciliation with parts, sub-documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.toc import LEADER, LEADER_WITH_NUMBER, is_toc_heading, parse_toc_line
from ..functions.zoning import with_part, with_zone_hint
from ..plans.ranges import range_pages
from ..plans.scan import first_value, following, int_chunk, ordered_scan, page_chunk, previous, running_max, running_sum
from ..plans.scratch import cut

CONTRACT = ["contract_id"]


def toc_densities(sections: DataFrame, text: str = "content") -> DataFrame:
    """Line counts that tell a table of contents from running text."""
    body = F.coalesce(F.col(text), F.lit(""))
    staged = sections.withColumn("__ln", F.filter(F.split(body, r"\r\n|[\n\r]"), lambda x: strip(x) != ""))
    ends = lambda x: x.rlike(r"\d+\s*$")
    return staged.withColumns(
        {
            "lines": F.size("__ln"),
            "leader": F.size(F.filter("__ln", lambda x: x.rlike(LEADER) & ends(x))),
            "trailing": F.size(F.filter("__ln", ends)),
            "leader_num": F.size(F.filter("__ln", lambda x: x.rlike(LEADER_WITH_NUMBER))),
            "dot_density": (F.length(body) - F.length(F.replace(body, F.lit("."), F.lit(""))))
            / F.greatest(F.length(body), F.lit(1)),
        }
    ).drop("__ln")


def mark_toc(df: DataFrame, unit: str = "section") -> DataFrame:
    """Add ``is_toc``: a heading opens, dense rows continue, the first other row closes.

    A row is inside when the latest opening row comes after the latest closing
    one; both are running maxima.  Sections near the front of a document are
    also recognised by their density alone.
    """
    index = "section_index" if unit == "section" else "page"
    text = "content" if unit == "section" else "text"
    d = toc_densities(df, text)
    if unit == "section":
        heading = strip(F.coalesce("heading", F.lit("")))
        opens = F.coalesce(F.col("is_toc"), F.lit(False)) | is_toc_heading(heading)
        untitled = heading == ""
    else:
        first = F.slice(F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != ""), 1, 5)
        opens = F.exists(first, is_toc_heading)
        untitled = F.lit(False)
    dense = (F.col("leader") >= F.col("lines") * 0.25) | (
        (F.col("trailing") >= F.col("lines") * 0.35) & (F.col("dot_density") >= 0.02)
    )
    goes_on = F.when(F.col("lines") > 0, dense).otherwise(untitled)
    marked = d.withColumns({"__open": opens, "__on": goes_on})
    scanned = ordered_scan(
        marked,
        CONTRACT,
        [index],
        {
            "__o": running_max(F.when(F.col("__open"), F.col(index))),
            "__c": running_max(F.when(~F.col("__open") & ~F.col("__on"), F.col(index))),
            "__pos": running_sum(F.lit(1)),
        },
        int_chunk(index),
    )
    inside = F.col("__o").isNotNull() & (F.col("__o") > F.coalesce("__c", F.lit(-1)))
    toc = F.col("__open") | (inside & F.col("__on"))
    drops = ["__open", "__on", "__o", "__c", "__pos", "lines", "leader", "trailing", "leader_num", "dot_density"]
    if unit == "page":
        return scanned.withColumn("is_toc", toc).drop(*drops)
    total = df.groupBy("contract_id").agg(F.count(F.lit(1)).alias("__total"))
    pos = scanned.join(total, "contract_id")
    front = (F.col("__pos") - 1) < F.greatest(F.lit(1), F.floor(F.col("__total") * F.lit(0.10)) + 1)
    by_density = (
        front
        & (F.col("lines") >= 3)
        & (F.col("dot_density") >= 0.03)
        & (
            (F.col("leader") >= F.col("lines") * 0.5)
            | ((F.col("trailing") >= F.col("lines") * 0.3) & (F.col("leader_num") >= F.col("trailing") * 0.5))
        )
    )
    return pos.withColumn("is_toc", toc | by_density).drop(*drops, "__total")


def toc_entries(toc_lines: DataFrame, total_pages: Column, order: str = "line_no") -> DataFrame:
    """One entry per line with a title, numbered in reading order."""
    parsed = parse_toc_line(toc_lines, "text", total_pages).where(F.col("toc").isNotNull())
    scanned = ordered_scan(parsed, CONTRACT, [order], {"__n": running_sum(F.lit(1))}, int_chunk(order))
    return scanned.select("contract_id", (F.col("__n") - 1).alias("entry_index"), "toc.*")


def reconcile_toc(
    parts: DataFrame, toc: DataFrame, sections: DataFrame, tol: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Parts to insert for unmatched top-level entries, and warnings for the rest."""
    toc_end = (
        parts.where(F.col("part_type") == "toc").groupBy("contract_id").agg(F.max("page_end").alias("__te"))
    )
    has_parts = parts.select("contract_id").distinct()
    top = (
        toc.where((F.col("level") == 1) & F.col("page_number").isNotNull())
        .join(has_parts, "contract_id", "left_semi")
        .join(toc_end, "contract_id", "left")
        .where(F.coalesce(F.col("page_number") > F.col("__te"), F.lit(True)))
        .drop("__te")
    )
    # a part that starts within the tolerance: one equality per candidate page
    near_starts = parts.select(
        "contract_id", F.explode(F.sequence(F.col("page_start") - tol, F.col("page_start") + tol)).alias("page_number")
    ).distinct()
    open_entries = top.join(near_starts, ["contract_id", "page_number"], "left_anti")
    # nearest section: same page first, then lower before higher, then list order
    offsets = [0] + [o for d in range(1, tol + 1) for o in (-d, d)]
    tries = F.array(*[F.struct(F.lit(i).alias("try"), (F.col("page_number") + F.lit(o)).alias("page")) for i, o in enumerate(offsets)])
    first_on_page = (
        range_pages(sections, "page_start", "page_end", ["contract_id", "section_index", F.col("page_end").alias("sec_end")])
        .groupBy("contract_id", "page")
        .agg(F.min(F.struct("section_index", "sec_end")).alias("sec"))
    )
    looked = open_entries.select("*", F.explode(tries).alias("t")).select("*", "t.try", "t.page").drop("t")
    best = (
        looked.join(first_on_page, ["contract_id", "page"], "left")
        .groupBy("contract_id", "entry_index", "title", "page_number")
        .agg(F.min_by("sec", F.when(F.col("sec").isNotNull(), F.col("try"))).alias("sec"))
    )
    best = cut(best, "toc-matches")  # inserts and warnings both start from it
    placed = best.where(F.col("sec").isNotNull() & (F.col("page_number") > 0))
    typed = with_zone_hint(with_part(placed, "title", "sections", "__part"), "title", "__part", "part_type")
    candidates = typed.select(
        "contract_id",
        "entry_index",
        "part_type",
        "title",
        F.col("page_number").alias("page_start"),
        F.col("sec.sec_end").alias("page_end"),
        F.lit(0).cast("long").alias("section_count"),
        F.lit(0.85).alias("confidence"),
    )
    inserts = drop_overlapping(candidates, parts)
    warnings = best.where(F.col("sec").isNull()).select("contract_id", "entry_index", "title", "page_number")
    return inserts, warnings


def drop_overlapping(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """Candidates that share no page with an existing part."""
    taken = range_pages(parts, "page_start", "page_end", ["contract_id"]).distinct()
    hit = (
        range_pages(candidates, "page_start", "page_end", ["contract_id", "entry_index"])
        .join(taken, ["contract_id", "page"], "left_semi")
        .select("contract_id", "entry_index")
        .distinct()
    )
    return candidates.join(hit, ["contract_id", "entry_index"], "left_anti")


def extend_inserted_parts(parts: DataFrame) -> DataFrame:
    """Inserted parts reach to the next part, the last one to the document end."""
    ends = parts.groupBy("contract_id").agg(F.max("page_end").alias("__total"))
    scanned = ordered_scan(
        parts.join(ends, "contract_id"),
        CONTRACT,
        ["page_start", "part_index"],
        {"__next": following(F.col("page_start"))},
        page_chunk(),
    )
    inserted = F.coalesce(F.col("confidence") == 0.85, F.lit(False))
    longer = F.when(F.col("__next").isNull(), F.col("__total")).otherwise(
        F.greatest("page_end", F.col("__next") - 1)
    )
    return scanned.withColumn("page_end", F.when(inserted, longer).otherwise(F.col("page_end"))).drop("__next", "__total")


# Signs of a new document inside one file.
RESTART = r"(?i)^\s*(?:article\s+(?:i|1)\b|(?:clause|section|part)\s+1\b|1\.\s+\S|제\s*1\s*(?:조|장|절))"
PAGE_ONE = r"(?i)\bpage\s+1\s+(?:of\s+\d+)?\b"


def with_boundary_score(sections: DataFrame, parts: DataFrame) -> DataFrame:
    """Add ``signals``, the number of signs that a part opens a new document."""
    text = F.concat(F.coalesce("content", F.lit("")), F.coalesce("heading", F.lit("")))
    signs = range_pages(
        sections.withColumns({"__one": text.rlike(PAGE_ONE), "__re": F.coalesce(F.col("heading").rlike(RESTART), F.lit(False))}),
        "page_start",
        "page_end",
        ["contract_id", "__one", "__re"],
        "page_start",
    )
    by_page = signs.groupBy("contract_id", "page_start").agg(F.max("__one").alias("__one"), F.max("__re").alias("__re"))
    span = parts.groupBy("contract_id").agg(
        F.greatest(F.lit(1), F.floor(F.max("page_end") * F.lit(0.20))).alias("__fifth")
    )
    joined = parts.join(by_page, ["contract_id", "page_start"], "left").join(span, "contract_id")
    seen = ordered_scan(
        joined, CONTRACT, ["part_index"], {"__prev": previous(F.col("part_type"))}, int_chunk("part_index")
    )
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    cover = F.col("part_type") == "cover_page"
    base = (
        flag((F.col("page_start") > 1) & F.col("__one"))
        + flag(cover)
        + flag(F.col("title").rlike(RESTART))
    )
    total = (
        base
        + F.when(base < 2, flag(F.col("__re"))).otherwise(0)
        + flag((F.col("part_type") == "toc") & (F.col("page_start") > F.col("__fifth")))
        + flag(cover & ~F.coalesce("__prev", F.lit("")).isin("cover_page", "toc"))
    )
    return seen.withColumn("signals", F.when(F.col("__prev").isNull(), 0).otherwise(total)).drop(
        "__one", "__re", "__fifth", "__prev"
    )


def sub_documents(sections: DataFrame, parts: DataFrame) -> DataFrame:
    """Groups of parts that form a document of their own.

    The scored parts and the groups are narrow and stored once: each is read by several steps.
    """
    scored = cut(with_boundary_score(sections, parts), "scored-parts")
    scanned = ordered_scan(
        scored.withColumn("__new", (F.col("signals") >= 2).cast("int")),
        CONTRACT,
        ["part_index"],
        {"subdoc_index": running_sum(F.col("__new"))},
        int_chunk("part_index"),
    )
    groups = scanned.groupBy("contract_id", "subdoc_index").agg(
        F.min_by("title", "part_index").alias("__t"),
        F.min_by("page_start", "part_index").alias("page_start"),
        F.max("page_end").alias("__max_end"),
        F.max_by("page_end", "part_index").alias("__last_end"),
        F.count(F.lit(1)).alias("n_parts"),
    )
    groups = cut(groups, "subdoc-groups")
    counts = groups.groupBy("contract_id").agg(F.count(F.lit(1)).alias("__groups"))
    titles = _first_headings(sections, groups)
    named = groups.join(counts, "contract_id").join(titles, ["contract_id", "subdoc_index"], "left")
    single = F.col("__groups") == 1
    fallback = F.when(single, "Document").otherwise(
        F.concat(F.lit("Document "), (F.col("subdoc_index") + 1).cast("string"))
    )
    from_parts = named.select(
        "contract_id",
        "subdoc_index",
        F.coalesce(F.when(F.col("__t") != "", F.col("__t")), "__heading", fallback).alias("title"),
        "page_start",
        F.when(single, F.col("__last_end")).otherwise(F.col("__max_end")).alias("page_end"),
        "n_parts",
    )
    bare = (
        sections.join(parts.select("contract_id").distinct(), "contract_id", "left_anti")
        .groupBy("contract_id")
        .agg(
            F.lit(0).cast("long").alias("subdoc_index"),
            F.coalesce(
                F.min_by("heading", F.when(F.coalesce("heading", F.lit("")) != "", F.col("section_index"))), F.lit("")
            ).alias("title"),
            F.lit(1).alias("page_start"),
            F.max("page_end").alias("page_end"),
            F.lit(0).cast("long").alias("n_parts"),
        )
    )
    return from_parts.unionByName(bare)


def _first_headings(sections: DataFrame, groups: DataFrame) -> DataFrame:
    """First heading at or after the page before each untitled group.

    Headings and groups are merged from the last page to the first; the
    running minimum of the section order then holds the answer for a group.
    """
    untitled = groups.where(F.coalesce("__t", F.lit("")) == "").select(
        "contract_id", (1 - F.col("page_start")).alias("np"), F.lit(1).alias("kind"), F.col("subdoc_index").cast("long").alias("tie")
    )
    heads = (
        sections.where(F.coalesce("heading", F.lit("")) != "")
        .join(untitled.select("contract_id").distinct(), "contract_id", "left_semi")
        .select(
            "contract_id",
            (-F.col("page_start")).alias("np"),
            F.lit(0).alias("kind"),
            F.col("section_index").cast("long").alias("tie"),
            F.struct("section_index", "heading").alias("head"),
        )
    )
    merged = heads.unionByName(untitled, allowMissingColumns=True)
    scanned = ordered_scan(
        merged, CONTRACT, ["np", "kind", "tie"], {"best": first_value(F.col("head"))}, page_chunk("np")
    )
    return scanned.where(F.col("kind") == 1).select(
        "contract_id", F.col("tie").alias("subdoc_index"), F.col("best.heading").alias("__heading")
    )
