"""Sections: assembly from lines, zones, parts, merges and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.headings import is_numbered_heading
from ..functions.lines import NUMBERED_LINE, is_cross_reference, shifted
from ..functions.numbering import heading_number, is_sibling_or_child
from ..functions.text import strip
from ..functions.rules import Rules
from ..functions.zoning import analysis_target, with_part, zone_confidence
from ..plans.scan import (
    first_value,
    int_chunk,
    island,
    last_before,
    last_value,
    ordered_scan,
    previous,
    running_max,
    running_sum,
)
from ..plans.scratch import cut
from .joins import section_text

CONTRACT = ["contract_id"]

# Parts whose key is not handed down to the sections below.
NON_PROPAGATING = ["definitions", "toc", "cover_page", "preamble"]

# Line tails that make the next heading candidate a continuation.
HYPHEN_TAIL = "[-­‐‑–]$"
KEYWORD_START = r"(?i)^\s*(?:CLAUSE|ARTICLE|SECTION|PART|CHAPTER)\s"
DANGLING_REF = r"(?i)(?:^|\s)(?:Sub-?Clause|Clause|Article|Section|Part|Chapter)\s*$"


def suppress_reference_headings(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Turn heading candidates that continue a reference back into text.

    A candidate is a continuation when the line before it is text with a
    suppressing tail; such a line then is text itself.  Inside a run of
    candidates with that property the outcome is the same for all, and is
    decided by the line in front of the run: text suppresses, a heading does
    not.
    """
    chunk = int_chunk(order)
    t = strip(F.coalesce("text", F.lit("")))
    # only the flags travel through the scans, not the text
    flags = lines.select(
        "contract_id",
        order,
        "is_candidate",
        "is_trigger",
        (t.rlike(HYPHEN_TAIL) & ~t.endswith("--")).alias("__hyphen"),
        t.rlike(DANGLING_REF).alias("__dangling"),
        F.col("text").rlike(KEYWORD_START).alias("__keyword"),
    )
    tail = F.struct("__hyphen", "__dangling")
    seen = ordered_scan(flags, CONTRACT, [order], {"__p": previous(tail)}, chunk)
    tailed = F.coalesce((F.col("__p.__hyphen") & F.col("__keyword")) | F.col("__p.__dangling"), F.lit(False))
    marked = seen.withColumn("__run", F.col("is_candidate") & ~F.col("is_trigger") & tailed)
    scanned = ordered_scan(
        marked, CONTRACT, [order], {"__front": last_before(F.when(~F.col("__run"), F.col("is_candidate")))}, chunk
    )
    suppressed = F.col("__run") & F.coalesce(~F.col("__front"), F.lit(False))
    verdict = scanned.select("contract_id", order, (F.col("is_candidate") & ~suppressed).alias("is_heading"))
    return lines.join(verdict, ["contract_id", order])


def build_sections(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Sections from classified lines; text before the first heading opens one."""
    scanned = ordered_scan(
        lines, CONTRACT, [order], {"section_no": running_sum(F.col("is_heading").cast("int"))}, int_chunk(order)
    )
    body = F.when(~F.col("is_heading"), F.struct(order, F.concat("text", F.lit("\n")).alias("t")))
    grouped = scanned.groupBy("contract_id", "section_no").agg(
        F.coalesce(F.max(F.when(F.col("is_heading"), F.col("text"))), F.lit("")).alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["t"]), "").alias("content"),
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
    )
    return grouped.where((F.col("heading") != "") | (strip(F.col("content")) != ""))


def mark_preamble(sections: DataFrame) -> DataFrame:
    """Body sections before the first numbered heading become preamble."""
    scanned = ordered_scan(
        sections,
        CONTRACT,
        ["section_index"],
        {"__seen": running_max(is_numbered_heading(F.coalesce("heading", F.lit(""))).cast("int"))},
        int_chunk("section_index"),
    )
    early = (F.col("__seen") == 0) & (F.coalesce("zone_hint", F.lit("")) == "contract_body")
    return scanned.withColumn("zone_hint", F.when(early, "preamble").otherwise(F.col("zone_hint"))).drop("__seen")


# ---------------------------------------------------------------- document parts


def with_part_no(sections: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Running number of the part boundaries; 0 before the first one."""
    toc = F.coalesce(F.col("is_toc"), F.lit(False))
    heading = F.coalesce("heading", F.lit(""))
    eligible = (heading != "") & (F.col("level") == 1) & ~toc
    marked = with_part(sections, "heading", "sections", "__part", rules=rules).withColumn("__part", F.when(eligible, F.col("__part")))
    return ordered_scan(
        marked,
        CONTRACT,
        ["section_index"],
        {"part_no": running_sum(F.col("__part").isNotNull().cast("int"))},
        int_chunk("section_index"),
    ).withColumnRenamed("__part", "boundary_type")


def document_parts(sections: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Parts of every contract; boundaries without any content are skipped."""
    s = with_part_no(sections, rules)
    toc = F.coalesce(F.col("is_toc"), F.lit(False))
    idx = F.col("section_index")
    content = strip(F.coalesce("content", F.lit(""))) != ""
    boundary = F.col("boundary_type").isNotNull()
    filled = content | (~boundary & (F.coalesce("heading", F.lit("")) != ""))
    hint = F.coalesce("zone_hint", F.lit(""))
    pre = (hint == "preamble") & ~toc
    grouped = s.groupBy("contract_id", "part_no").agg(
        F.max("boundary_type").alias("type"),
        F.max(F.when(boundary, F.col("heading"))).alias("title"),
        F.max(filled).alias("filled"),
        F.count(F.lit(1)).alias("n"),
        F.min_by("page_start", idx).alias("p0"),
        F.max("page_end").alias("pmax"),
        F.max(F.when(~toc, F.col("page_end"))).alias("pmax_body"),
        F.max_by("page_end", F.when(~toc, idx)).alias("plast_body"),
        F.count_if(pre).alias("n_pre"),
        F.min_by("page_start", F.when(pre, idx)).alias("pre0"),
        F.max_by("page_end", F.when(pre, idx)).alias("pre1"),
        F.min_by("page_start", F.when(~hint.isin("preamble", "toc"), idx)).alias("body0"),
    )
    first = grouped.where(F.col("part_no") == 1).select("contract_id", F.col("p0").alias("b0"))
    g = grouped.join(first, "contract_id", "left")

    def part(cond: Column, kind: Column, title: Column, lo: Column, hi: Column, n: Column) -> DataFrame:
        return g.where(cond).select(
            "contract_id",
            "part_no",
            kind.alias("part_type"),
            title.alias("title"),
            lo.alias("page_start"),
            hi.alias("page_end"),
            n.alias("section_count"),
        )

    c = F.col
    front, alone = c("part_no") == 0, (c("part_no") == 0) & c("b0").isNull()
    split = alone & (c("n_pre") > 0)
    lit = F.lit
    # the front of a contract with boundaries, the two halves or the whole of one without, the real parts
    frames = [
        part(front & c("b0").isNotNull(), lit("preamble"), lit("전문"), c("p0"), F.coalesce("plast_body", c("b0") - 1), c("n")),
        part(split, lit("preamble"), lit("전문"), c("pre0"), c("pre1"), c("n_pre")),
        part(
            split,
            lit("contract_body"),
            lit("계약서 본문"),
            F.coalesce("body0", c("pre1") + 1),
            c("pmax"),
            c("n") - c("n_pre"),
        ).withColumn("part_no", lit(1).cast("long")),
        part(alone & (c("n_pre") == 0), lit("contract_body"), lit("계약서 본문"), lit(1), c("pmax"), c("n")),
        part((c("part_no") > 0) & c("filled"), c("type"), c("title"), c("p0"), F.coalesce("pmax_body", "pmax"), c("n")),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def propagate_zones(sections: DataFrame, parts: DataFrame) -> DataFrame:
    """Sections inherit the key of the part they belong to."""
    s = with_part_no(sections)
    kept = parts.where(F.col("part_no") > 0).select("contract_id", "part_no", "part_type")
    joined = s.join(kept, ["contract_id", "part_no"], "left")
    child = F.col("boundary_type").isNull() & (F.col("part_no") > 0) & F.col("part_type").isNotNull()
    hint = F.col("zone_hint")
    unset = hint.isNull() | hint.isin("contract_body", "unknown")
    value = (
        F.when(child & F.col("part_type").isin(NON_PROPAGATING), F.when(unset, "contract_body").otherwise(hint))
        .when(child, F.col("part_type"))
        .otherwise(hint)
    )
    return joined.withColumn("zone_hint", value).drop("part_type", "boundary_type", "part_no")


def merge_adjacent_zones(sections: DataFrame) -> DataFrame:
    """Zones from top-level sections; neighbours of equal type become one."""
    top = sections.where(F.col("level") <= 1).withColumns(
        {
            "__zone": F.when(F.coalesce("zone_hint", F.lit("")) == "", "contract_body").otherwise(F.col("zone_hint")),
            "__text": section_text(),
        }
    )
    runs = ordered_scan(top, CONTRACT, ["section_index"], {"__run": island(F.col("__zone"))}, int_chunk("section_index"))
    first = F.min(F.struct("section_index", "heading", "level", "zone_hint", "page_start"))
    zones = runs.groupBy("contract_id", "__run", F.col("__zone").alias("zone_type")).agg(
        first.alias("__f"),
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
    return zones.select(
        "contract_id",
        (F.col("__run") - 1).alias("zone_index"),
        "zone_type",
        F.col("__f.page_start").alias("page_from"),
        "page_to",
        F.when(F.col("__f.heading") != "", F.col("__f.heading")).alias("title"),
        analysis_target(F.when(F.col("__f.zone_hint") != "", F.col("__f.zone_hint"))).alias("is_analysis_target"),
        zone_confidence(F.col("__f.zone_hint"), F.col("__f.level")).alias("confidence"),
        "text",
    )


# ---------------------------------------------------------------- merges

# Headings of list items and of deep numbers.
ALPHA_HEADING = r"(?i)^\s*\([a-z]{1,3}\)\s+\S"
DEEP_HEADING = r"^\s*\d+(?:\.\d+){2,}\s"
NOT_USED_HEADING = r"(?i)^\s*\d+(?:\.\d+)+\s+\[?Not\s+Used\]?\s*$"


def merge_short_sections(sections: DataFrame, threshold: int = 50) -> DataFrame:
    """Merge fragments and list items into the section kept last.

    A short deep fragment always merges.  A list item merges unless the
    section kept last is a definition or deeply numbered; then it is kept,
    becomes the section kept last, and lets the following items merge.  So an
    item is kept exactly when it is the first one after such a section, which
    two running values tell without a sequential pass.
    """
    heading = F.coalesce("heading", F.lit(""))
    zone = F.coalesce("zone_hint", F.lit("contract_body"))
    content = strip(F.coalesce("content", F.lit("")))
    boundary = F.col("__part").isNotNull()
    deep = heading.rlike(DEEP_HEADING)
    # a narrow table of flags goes through the scans; the texts are joined back once
    flags = cut(
        with_part(sections, "heading", "sections", "__part").select(
            "contract_id",
            "section_index",
            ((F.col("level") >= 3) & (F.length(content) < threshold) & ~boundary & ~deep).alias("frag"),
            (heading.rlike(ALPHA_HEADING) & ~boundary & (zone != "definitions")).alias("item"),
            (deep | (zone == "definitions")).alias("guard"),
        )
    )
    chunk = int_chunk("section_index")
    here = F.struct("section_index", "guard")
    loose = F.col("frag") | F.col("item")
    scanned = ordered_scan(
        flags,
        CONTRACT,
        ["section_index"],
        {
            "start": first_value(here),
            "base": last_value(F.when(~loose, here)),
            "item_at": last_before(F.when(F.col("item") & ~F.col("frag"), F.col("section_index"))),
        },
        chunk,
    ).withColumn("base", F.coalesce("base", "start"))
    is_start = F.col("section_index") == F.col("start.section_index")
    no_item_yet = F.coalesce(F.col("item_at") <= F.col("base.section_index"), F.lit(True))
    kept = is_start | ~loose | (F.col("item") & ~F.col("frag") & F.col("base.guard") & no_item_yet)
    owners = ordered_scan(
        scanned.select("contract_id", "section_index", kept.alias("__kept")),
        CONTRACT,
        ["section_index"],
        {"__owner": last_value(F.when(F.col("__kept"), F.col("section_index")))},
        chunk,
    )
    owner = sections.withColumn("__body", content).join(owners, ["contract_id", "section_index"])
    added = F.concat(
        F.when(F.coalesce("heading", F.lit("")) != "", F.concat("heading", F.lit("\n"))).otherwise(""),
        F.when(F.col("__body") != "", F.concat("__body", F.lit("\n"))).otherwise(""),
    )
    piece = F.when(F.col("__kept"), F.coalesce("content", F.lit(""))).otherwise(added)
    head = F.min_by(F.struct("heading", "level", "zone_hint", "page_start"), "section_index")
    return (
        owner.groupBy("contract_id", F.col("__owner").alias("section_index"))
        .agg(
            head.alias("__h"),
            F.max("page_end").alias("page_end"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct(F.col("section_index").alias("i"), piece.alias("t")))),
                    lambda x: x["t"],
                ),
                "",
            ).alias("content"),
        )
        .select("contract_id", "section_index", "__h.*", "content", "page_end")
    )


# Fixed value: a clause number inside a heading, with text behind it.
EMBEDDED = r"\s+(\d+\.\d+(?:\.\d+)*)\s+\S"


def _opens_below(number: Column, heading: Column) -> Column:
    """``heading`` starts with, or holds, a number below ``number``."""
    stem = F.concat(number, F.lit("."))
    inner = F.regexp_extract(heading, EMBEDDED, 1)
    return F.coalesce(heading_number(heading).startswith(stem) | inner.startswith(stem), F.lit(False))


def merge_heading_fragments(sections: DataFrame) -> DataFrame:
    """Put headings that were split over several sections together again.

    Only runs of empty headings plus the section behind them interact; all other
    sections pass by untouched.  Inside a run a numbered heading either holds its
    number for what follows or is taken in by the group before it.  It holds where
    it repeats the number before it or opens a level below; where it conflicts
    instead, it holds only if the one before didn't.  So a number's state is the
    parity of conflicts since the last agreement, and groups, their titles and
    their targets are running values over the run.
    """
    heading, content = strip(F.coalesce("heading", F.lit(""))), strip(F.coalesce("content", F.lit("")))
    whole = heading.rlike(DEEP_HEADING) | heading.rlike(NOT_USED_HEADING)
    fields = ["section_index", "heading", "level", "zone_hint", "page_start", "page_end", "content"]
    base = sections.select("contract_id", *fields).withColumn("__loose", (content == "") & (heading != "") & ~whole)
    # a run ends with the first section that is not loose: count those strictly before
    solid = F.when(F.col("__loose"), 0).otherwise(1)
    steps = {"__p": previous(F.col("__loose")), "__s": running_sum(solid)}
    runs = ordered_scan(base, CONTRACT, ["section_index"], steps, int_chunk("section_index")).withColumn("__run", F.col("__s") - solid)
    busy = F.col("__loose") | F.coalesce("__p", F.lit(False))
    untouched = runs.where(~busy).select("contract_id", *fields)

    run = W.partitionBy("contract_id", "__run").orderBy("section_index")
    before, upto = run.rowsBetween(W.unboundedPreceding, -1), run.rowsBetween(W.unboundedPreceding, W.currentRow)
    loose, title = F.col("__loose"), F.col("__title")
    named = runs.where(busy).withColumn("__title", heading).withColumn("__num", F.when(loose, heading_number(title)))
    seen = named.withColumn("__held", F.last("__num", ignorenulls=True).over(before))
    same, below = F.col("__num") == F.col("__held"), _opens_below(F.col("__held"), title)
    linked = seen.withColumns({"__below": below, "__agrees": same | F.when(F.col("__num").isNotNull(), below)})
    spell = linked.withColumn("__spell", F.sum(F.when(F.col("__agrees"), 1).otherwise(0)).over(upto))
    inside = W.partitionBy("contract_id", "__run", "__spell").orderBy("section_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    conflicts = F.sum(F.when(~F.col("__agrees"), 1).otherwise(0)).over(inside)
    state = spell.withColumn("__holds", F.when(F.col("__num").isNotNull(), conflicts % 2 == 0))
    state = state.withColumn("__open", F.coalesce(F.last("__holds", ignorenulls=True).over(before), F.lit(False)))
    taken = state.withColumn("__taken", loose & F.coalesce(~F.col("__holds"), F.lit(False)))
    after_taken = F.coalesce(F.lag("__taken").over(run), F.lit(False))
    starts = F.lag("__title").over(run).isNull() | after_taken | (F.col("__below") & F.col("__open") & (F.col("__num").isNotNull() | ~loose))
    grouped = taken.withColumn("__group", F.sum(F.when(starts, 1).otherwise(0)).over(upto))

    # the last group of a run that nothing follows stays as it is
    whole_run = W.partitionBy("contract_id", "__run")
    group = W.partitionBy("contract_id", "__run", "__group")
    unclosed = (F.max("__group").over(whole_run) == F.col("__group")) & ~F.max(~loose | F.col("__taken")).over(group) & ~F.max(~loose).over(whole_run)
    marked = grouped.withColumn("__alone", unclosed)
    alone = marked.where("__alone").select("contract_id", *fields)
    row = F.struct("section_index", "level", "zone_hint", "page_start", "page_end", "content", "heading", "__loose", "__taken", "__title")
    packed = marked.where("not __alone").groupBy("contract_id", "__run", "__group").agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    first, last, n = F.col("__rows")[0], F.element_at("__rows", -1), F.size("__rows")
    merges = (~last["__loose"] | last["__taken"]) & (n > 1)
    zone = F.when(F.coalesce(first["zone_hint"], F.lit("contract_body")) != "contract_body", first["zone_hint"]).otherwise(last["zone_hint"])
    titles = F.array_join(F.filter(F.transform("__rows", lambda x: x["__title"]), lambda t: t != ""), " ")
    merged = packed.select(
        "contract_id",
        first["section_index"].alias("section_index"),
        F.when(n > 1, titles).when(first["__loose"], first["__title"]).otherwise(first["heading"]).alias("heading"),
        first["level"].alias("level"),
        F.when(merges, zone).otherwise(first["zone_hint"]).alias("zone_hint"),
        first["page_start"].alias("page_start"),
        last["page_end"].alias("page_end"),
        F.when(merges, last["content"]).otherwise(first["content"]).alias("content"),
    )
    return untouched.unionByName(alone).unionByName(merged.select("contract_id", *fields))


# ---------------------------------------------------------------- splits

# Fixed value: prefixes that belong to the number behind them.
STRUCT_PREFIX = r"(?i)^\s*(?:Sub-?\s*)?(?:Clause|Article|Section|Part|Chapter|Schedule|Annex)\s*$"


def split_compound_headings(sections: DataFrame) -> DataFrame:
    """A heading that holds a parent and a child number becomes two sections."""
    h = F.col("__h")
    staged = sections.withColumn("__h", strip(F.coalesce("heading", F.lit("")))).withColumns(
        {
            "__child": F.regexp_extract(h, EMBEDDED, 1),
            "__lead": strip(F.regexp_extract(h, r"^(.*?\s)\d+\.\d+(?:\.\d+)*\s+\S", 1)),
            "__num": heading_number(h),
        }
    )
    child, lead, num = F.col("__child"), F.col("__lead"), F.col("__num")
    free = (F.length(lead) <= 60) & ~lead.rlike(r"[.;!?,]") & ~lead.rlike(STRUCT_PREFIX)
    splits = (child != "") & (lead != "") & F.when(num.isNotNull(), child.startswith(F.concat(num, F.lit(".")))).otherwise(free)
    rest = strip(F.substring(h, F.length(F.regexp_extract(h, r"^(.*?\s+)\d+\.\d+(?:\.\d+)*\s+\S", 1)) + 1, F.length(h)))
    parent = F.struct(F.lit(0).alias("sub"), lead.alias("heading"), F.lit("").alias("content"), F.col("level"))
    below = F.struct(
        F.lit(1).alias("sub"), rest.alias("heading"), F.col("content"), F.size(F.split(child, r"\.")).alias("level")
    )
    same = F.struct(F.lit(0).alias("sub"), F.col("heading"), F.col("content"), F.col("level"))
    pieces = F.when(splits, F.array(parent, below)).otherwise(F.array(same))
    keep = [c for c in sections.columns if c not in ("heading", "content", "level")]
    return staged.select(*keep, F.explode(pieces).alias("p")).select(*keep, "p.*")


def cut_at_lines(text: Column, boundary) -> Column:
    """Cut a text in front of the lines for which ``boundary(line, previous)`` holds.

    Element 0 is what stands before the first such line.
    """
    lines = F.split(text, "\n")
    hits = F.zip_with(lines, shifted(lines), lambda x, p: F.coalesce(boundary(x, p), F.lit(False)))
    starts = F.filter(F.transform(hits, lambda h, i: F.when(h, i + 1)), lambda i: i.isNotNull())
    bounds = F.concat(F.array(F.lit(1)), starts, F.array(F.size(lines) + 1))

    def pieces(s: Column) -> Column:
        upto = F.slice(s["bounds"], 2, F.size(s["bounds"]) - 1)
        return F.transform(upto, lambda b, i: F.array_join(F.slice(s["lines"], F.get(s["bounds"], i), b - F.get(s["bounds"], i)), "\n"))

    # lines and bounds are computed once for all pieces
    held = F.array(F.struct(lines.alias("lines"), bounds.alias("bounds")))
    return F.when(text.isNotNull(), F.transform(held, pieces)[0])


def split_multi_clause(sections: DataFrame) -> DataFrame:
    """Split content at lines that carry a number of the same branch.

    Everything happens inside the row: no line leaves its section, so no
    shuffle is needed.
    """
    own = F.col("__own")
    staged = sections.withColumn("__own", F.regexp_extract(F.coalesce("heading", F.lit("")), r"^\s*(\d+(?:\.\d+)*)", 1))

    def boundary(x: Column, p: Column) -> Column:
        num = F.regexp_extract(x, NUMBERED_LINE, 1)
        return (num != "") & is_sibling_or_child(own, num) & ~is_cross_reference(x, p)

    usable = (
        ~F.coalesce(F.col("zone_hint").isin("toc", "cover_page", "annexes"), F.lit(False))
        & (F.length("content") >= 50)
        & (own != "")
    )
    staged = staged.withColumn("__cuts", F.when(usable, cut_at_lines(F.col("content"), boundary)))
    split = F.coalesce(F.size("__cuts") > 1, F.lit(False))

    def chunk(x: Column) -> Column:
        text = strip(x)
        line = strip(F.split(text, "\n")[0])
        num = F.regexp_extract(line, r"^\s*(\d+(?:\.\d+)*)", 1)
        return F.struct(
            F.substring(line, 1, 120).alias("heading"),
            F.size(F.split(num, r"\.")).alias("level"),
            text.alias("content"),
            F.lit(True).alias("is_auto_split"),
        )

    head = F.struct(
        F.col("heading"),
        F.col("level"),
        F.when(split, strip(F.col("__cuts")[0])).otherwise(F.col("content")).alias("content"),
        F.lit(False).alias("is_auto_split"),
    )
    rest = F.when(split, F.transform(F.slice("__cuts", 2, F.greatest(F.size("__cuts") - 1, F.lit(0))), chunk))
    empty = F.slice(F.array(head), 1, 0)
    pieces = F.concat(F.array(head), F.coalesce(rest, empty))
    keep = [c for c in sections.columns if c not in ("heading", "level", "content", "is_auto_split")]
    return staged.select(*keep, F.posexplode(pieces).alias("sub", "p")).select(*keep, "sub", "p.*")


def resplit_pieces(body: Column) -> Column:
    """Numbered pieces of a clause body, or null when it is left whole.

    Gates: more than 200 characters, two numbered lines, the first of them
    within 50 characters, two left without cross references.  Text before the
    first piece is dropped.
    """
    numbered = lambda x, p: x.rlike(NUMBERED_LINE)
    real = lambda x, p: x.rlike(NUMBERED_LINE) & ~is_cross_reference(x, p)
    every, kept = cut_at_lines(body, numbered), cut_at_lines(body, real)
    gates = (F.length(body) > 200) & (F.size(every) > 2) & (F.length(every[0]) <= 50) & (F.size(kept) > 2)

    def item(x: Column) -> Column:
        text = strip(x)
        return F.struct(F.regexp_extract(text, NUMBERED_LINE, 1).alias("number"), text.alias("text"))

    return F.when(gates, F.transform(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), item))


def resplit_clauses(sections: DataFrame) -> DataFrame:
    """Second-pass split: one row per numbered piece of a section body."""
    body = strip(F.coalesce("content", F.lit("")))
    pieces = sections.withColumn("__b", body).withColumn("__p", resplit_pieces(F.col("__b")))
    keep = [c for c in sections.columns if c != "content"]
    return (
        pieces.where(F.col("__p").isNotNull())
        .select(*keep, F.posexplode("__p").alias("sub", "i"))
        .select(*keep, "sub", F.col("i.number").alias("number"), F.col("i.text").alias("content"))
    )
