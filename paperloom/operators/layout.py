"""Page lines: repeated headers and footers, blocks, fonts, hyphens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbering import annotate_numbering
from ..functions.text import is_page_number, letter_count, normalize_pattern, rstrip, safe_join, strip, upper_count, upper_ratio
from ..plans.scan import following, int_chunk, ordered_fold, ordered_scan, previous, running_sum


def with_edge_flags(lines: DataFrame, n: int = 2) -> DataFrame:
    """First and last ``n`` lines of every page."""
    down = W.partitionBy("contract_id", "page").orderBy("y0", "ord")
    up = W.partitionBy("contract_id", "page").orderBy(F.desc("y0"), F.desc("ord"))
    return (
        lines.withColumns({"__a": F.row_number().over(down), "__b": F.row_number().over(up)})
        .withColumn("is_edge", (F.col("__a") <= n) | (F.col("__b") <= n))
        .drop("__a", "__b")
    )


def _page_totals(lines: DataFrame) -> DataFrame:
    """Pages per contract: distinct pages first, so no key is counted in one place."""
    return lines.select("contract_id", "page").distinct().groupBy("contract_id").agg(F.count(F.lit(1)).alias("pages"))


def header_footer_candidates(lines: DataFrame, band: float, edge: int) -> DataFrame:
    flagged = with_edge_flags(lines, edge)
    in_band = (F.col("y1") <= F.col("page_height") * band) | (F.col("y0") >= F.col("page_height") * (1 - band))
    return flagged.withColumns(
        {
            "is_candidate": (F.col("page_height") > 0) & (in_band | F.col("is_edge")),
            "norm": normalize_pattern(F.col("text"), "layout"),
        }
    ).drop("is_edge")


def repeated_lines_layout(lines: DataFrame, band: float = 0.12, ratio: float = 0.60, edge: int = 2) -> DataFrame:
    """Masked line texts found near the page edges of most pages."""
    cand = header_footer_candidates(lines, band, edge).where(F.col("is_candidate") & (F.length("norm") >= 3))
    counts = cand.groupBy("contract_id", "norm").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.join(_page_totals(lines), "contract_id")
        .where(F.col("n") / F.col("pages") >= ratio)
        .select("contract_id", "norm")
    )


def drop_repeated_lines(
    lines: DataFrame, patterns: DataFrame, band: float = 0.12, edge: int = 2
) -> DataFrame:
    """Candidate lines that repeat or hold only a page number are removed.

    Contracts without any repeated pattern stay untouched.
    """
    cand = header_footer_candidates(lines, band, edge)
    pats = patterns.select("contract_id", "norm").distinct().withColumn("__rep", F.lit(True))
    active = patterns.select("contract_id").distinct().withColumn("__act", F.lit(True))
    joined = cand.join(pats, ["contract_id", "norm"], "left").join(active, "contract_id", "left")
    gone = F.col("is_candidate") & F.col("__act").isNotNull() & (
        F.col("__rep").isNotNull() | is_page_number(F.col("text"), "layout")
    )
    return joined.where(~F.coalesce(gone, F.lit(False))).drop("is_candidate", "norm", "__rep", "__act")


def repeated_lines_sections(lines: DataFrame, zone: float = 0.15) -> DataFrame:
    """Header and footer patterns by page zone; page numbers are counted apart."""
    height = F.when(F.col("page_height") > 0, F.col("page_height")).otherwise(792.0)
    mid = (F.col("y0") + F.col("y1")) / 2.0
    norm = normalize_pattern(F.col("text"), "sections")
    position = F.when(mid <= height * zone, "header").when(mid >= height * (1.0 - zone), "footer")
    placed = (
        lines.select("contract_id", position.alias("position"), norm.alias("norm"), is_page_number(F.col("text")).alias("num"))
        .where(F.col("position").isNotNull() & (F.col("norm") != ""))
        .withColumn("norm", F.when(F.col("num"), "page_number").otherwise(F.col("norm")))
    )
    counts = placed.groupBy("contract_id", "position", "norm", "num").agg(F.count(F.lit(1)).alias("n"))
    need = F.greatest(F.lit(3), F.floor(F.col("pages") * F.lit(0.15)))
    return (
        counts.join(_page_totals(lines), "contract_id")
        .where((F.col("pages") >= 3) & (F.col("n") >= need))
        .select(
            "contract_id",
            "position",
            "norm",
            F.when(F.col("num"), "page_number").otherwise("repeated_text").alias("type"),
        )
    )


def page_number_style(patterns: DataFrame) -> DataFrame:
    """Where the page numbers stand; the footer wins."""
    return (
        patterns.where(F.col("type") == "page_number")
        .groupBy("contract_id")
        .agg(F.min("position").alias("style"))
    )


def with_removal_reason(lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """Why a section line is removed: footer (page number), header, footer or null."""
    norm = normalize_pattern(F.col("text"), "sections")
    flags = patterns.where(F.col("type") == "page_number").select("contract_id").distinct()
    text = patterns.where(F.col("type") == "repeated_text")
    # an ordered pair of facts per pattern, header before footer
    sides = text.groupBy("contract_id", "norm").agg(F.max(F.col("position") == "header").alias("__head"))
    joined = (
        lines.withColumn("norm", norm)
        .join(flags.withColumn("__num", F.lit(True)), "contract_id", "left")
        .join(sides, ["contract_id", "norm"], "left")
    )
    reason = (
        F.when(F.col("norm") == "", None)
        .when(F.col("__num").isNotNull() & is_page_number(F.col("text")), "footer")
        .when(F.col("__head"), "header")
        .when(F.col("__head").isNotNull(), "footer")
    )
    return joined.withColumn("removed", reason).drop("norm", "__num", "__head")


def removal_counts(lines: DataFrame, patterns: DataFrame) -> DataFrame:
    r = F.col("removed")
    return with_removal_reason(lines, patterns).groupBy("contract_id").agg(
        F.count_if(r == "header").alias("removed_header"), F.count_if(r == "footer").alias("removed_footer")
    )


def font_medians(lines: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Median font size per page and per document (page -1).

    The document median takes all pages, or on request up to ``max_pages``
    evenly spaced ones.  The medians merge counts
    per distinct size, so they are partially aggregated before the shuffle.
    """
    sized = lines.where(F.col("font_size") > 0)
    per_page = sized.groupBy("contract_id", "page").agg(F.median("font_size").alias("median"))
    if max_pages is not None:
        span = lines.groupBy("contract_id").agg((F.max("page") + 1).alias("__pages"))
        step = F.greatest(F.lit(1), F.floor(F.col("__pages") / F.least(F.lit(max_pages), F.col("__pages"))))
        sized = sized.join(span, "contract_id").where(
            (F.col("page") % step == 0) & (F.col("page") / step < F.lit(max_pages))
        )
    whole = sized.groupBy("contract_id").agg(F.median("font_size").alias("median"))
    return per_page.unionByName(whole.select("contract_id", F.lit(-1).cast("int").alias("page"), "median"))


def assign_blocks(lines: DataFrame) -> DataFrame:
    """Number the paragraph-like blocks of every page.

    A line opens a block when it leaves a vertical gap or moves sideways from
    the left edge of the running block, so the decision needs the block built
    so far: an ordered fold over the lines of one page.
    """
    filled = lines.where(strip(F.col("text")) != "")
    height = F.col("y1") - F.col("y0")
    medians = lines.where(height > 0).groupBy("contract_id").agg(F.median(height).alias("__h"))
    h = F.when(F.coalesce("__h", F.lit(0.0)) == 0, 10.0).otherwise(F.col("__h"))
    known = filled.where("contract_id is not null and page is not null and ord is not null")
    gaps = known.join(medians, "contract_id", "left").withColumn("__gap", F.greatest(F.lit(3.5), h * 0.9))

    def step(state: tuple | None, y0: float | None, x0: float | None, y1: float | None, gap: float) -> tuple:
        left, bottom, block = state or (None, None, -1)
        away = y0 is not None and bottom is not None and y0 - bottom > gap
        aside = x0 is not None and left is not None and abs(x0 - left) > 80
        if bottom is None or away or aside:
            return x0, y1, block + 1
        return x0 if left is None else left if x0 is None else min(left, x0), y1, block

    inputs = {n: F.col(n).cast("double") for n in ("y0", "x0", "y1")} | {"gap": F.col("__gap")}
    order = [F.col(c) for c in ("y0", "x0", "ord")]
    return ordered_fold(gaps.select(*lines.columns, "__gap"), ["contract_id", "page"], order, inputs, step, "block_id").drop("__gap")


def block_stats(lines: DataFrame) -> DataFrame:
    """One row per block: box, indent, fonts, bold and upper-case ratios, joined text."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "ord", "text"))), lambda x: x["text"])
    stats = lines.groupBy("contract_id", "page", "block_id").agg(
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
        F.min("x0").alias("indent_x"),
        F.coalesce(F.avg(F.when(F.col("font_size") > 0, F.col("font_size"))), F.lit(0.0)).alias("avg_font_size"),
        F.avg(F.col("is_bold").cast("int")).alias("bold_ratio"),
        texts.alias("__texts"),
    )
    joined = stats.withColumn("text", safe_join(F.col("__texts"))).drop("__texts")
    return joined.withColumn("upper_ratio", upper_ratio(F.col("text")))


def mark_headings(blocks: DataFrame) -> DataFrame:
    """Add ``block_type`` (heading or paragraph) and the numbering hint."""
    sized = blocks.where(F.col("avg_font_size") > 0)
    page = sized.groupBy("contract_id", "page").agg(F.median("avg_font_size").alias("__pm"))
    whole = sized.groupBy("contract_id").agg(F.median("avg_font_size").alias("__gm"))
    joined = blocks.join(page, ["contract_id", "page"], "left").join(whole, "contract_id", "left")
    hinted = annotate_numbering(joined, "text")
    t = strip(F.col("text"))
    base = F.coalesce("__pm", "__gm", F.lit(0.0))
    size = (F.col("avg_font_size") > 0) & (base > 0) & (F.col("avg_font_size") >= base * 1.12)
    bold = (F.col("bold_ratio") >= 0.55) & (F.length(t) <= 140)
    typo = (size | bold) & (F.col("upper_ratio") >= 0.35) & (F.length(t) <= 180)
    letters = letter_count(t)
    caps = letters.between(1, 80) & (upper_count(t) / letters > 0.8)
    named = t.rlike(r"(?i)^(ARTICLE|SECTION|SCHEDULE|EXHIBIT|APPENDIX)\s|^제\s*\d+\s*조")
    heading = named | F.coalesce(F.col("hint.is_heading"), F.lit(False)) | typo | F.when(letters > 0, caps).otherwise(False)
    return hinted.withColumn(
        "block_type", F.when((t != "") & heading, "heading").otherwise("paragraph")
    ).drop("__pm", "__gm")


# Characters that count as a line-end hyphen.
HYPHENS = "[-­‐‑–]$"


def repair_hyphens(lines: DataFrame) -> DataFrame:
    """Join lines of a page that end with a hyphen with the next line.

    The hyphen goes when the next line starts in lower case.  Whether a line
    joins depends only on the tail of the line before, so islands suffice.
    """
    text = rstrip(F.col("text"))
    src = lines.withColumn("__t", text).where(strip(F.col("__t")) != "")
    keys, order = ["contract_id", "page"], ["ord"]
    near = ordered_scan(
        src, keys, order, {"__p": previous(F.col("__t")), "__n": following(F.col("__t"))}
    )
    tail = lambda c: c.rlike(HYPHENS) & ~c.endswith("--")
    joins = F.coalesce(tail(F.col("__p")), F.lit(False))
    taken = tail(F.col("__t")) & F.col("__n").isNotNull()
    upper_next = strip(F.col("__n")).rlike(r"^\p{Lu}")
    body = F.when(joins, F.ltrim(F.col("__t"))).otherwise(F.col("__t"))
    piece = F.when(taken & ~upper_next, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    marked = near.withColumns({"__piece": piece, "__open": F.when(joins, 0).otherwise(1)})
    islands = ordered_scan(marked, keys, order, {"__isl": running_sum(F.col("__open"))})
    return islands.groupBy("contract_id", "page", "__isl").agg(
        F.min("ord").alias("ord"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ord", "__piece"))), lambda x: x["__piece"]), ""
        ).alias("text"),
    ).drop("__isl")


def build_clauses(blocks: DataFrame) -> DataFrame:
    """Clauses of the target zones from marked blocks.

    ``blocks`` carries ``zone_index``, ``zone_key``, ``block_no``, ``text``,
    ``hint`` and ``block_type``.  A heading opens a clause, text before the
    first heading of a zone is a clause of its own, and numbering runs on
    across zones.
    """
    t = strip(F.col("text"))
    opens = (F.col("block_type") == "heading") | (F.coalesce(F.col("hint.kind"), F.lit("")) == "schedule")
    src = blocks.withColumn("__t", t).where(F.col("__t") != "").withColumn("__open", opens)
    keys, order = ["contract_id"], ["zone_index", "block_no"]
    chunk = F.col("zone_index") * 1_000_000 + int_chunk("block_no")
    # headings so far in the contract; text ahead of the first heading of a zone differs by its zone
    groups = ordered_scan(
        src,
        keys,
        order,
        {"__grp": running_sum(F.col("__open").cast("int"))},
        chunk,
    )
    head = F.when(F.col("__open"), F.struct(F.col("__t").alias("t"), F.col("hint.normalized").alias("n")))
    rows = groups.groupBy("contract_id", "zone_index", "__grp").agg(
        F.first("zone_key").alias("zone_key"),
        F.min("block_no").alias("block_no"),
        F.max(head).alias("__h"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(~F.col("__open"), F.struct("block_no", "__t")))),
                lambda x: x["__t"],
            ),
            "\n",
        ).alias("__body"),
    )
    numbered = ordered_scan(rows, keys, order, {"__k": running_sum(F.lit(1))}, chunk)
    k = F.col("__k").cast("string")
    fallback = F.when(F.col("__h").isNull(), F.concat("zone_key", F.lit("-auto-"), k)).otherwise(
        F.concat("zone_key", F.lit("-"), k)
    )
    content = (
        F.when(F.col("__h").isNull(), F.col("__body"))
        .when(F.col("__body") == "", F.col("__h.t"))
        .otherwise(F.concat(F.col("__h.t"), F.lit("\n"), F.col("__body")))
    )
    return numbered.select(
        "contract_id",
        (F.col("__k") - 1).alias("order_index"),
        F.coalesce(F.col("__h.n"), fallback).alias("clause_number"),
        F.col("__h.t").alias("title"),
        content.alias("content"),
        F.col("__h").isNull().alias("is_auto_split"),
        "zone_key",
    )
