"""Table-of-contents lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import rstrip, strip

# Headings that open a table of contents.
TOC_HEADINGS = [
    r"^\s*table\s+of\s+contents?\s*$",
    r"^\s*contents?\s*$",
    r"^\s*목\s*차\s*$",
    r"^\s*\[?\s*목\s*차\s*\]?\s*$",
    r"^\s*차\s*례\s*$",
    r"^\s*index\s*$",
    r"^\s*[-–—]?\s*table\s+of\s+contents?\s*[-–—]?\s*$",
]
# Leaders, page numbers and numbering of a line of contents.
LEADER = r"\.{3,}|-\s*-\s*-"
TRAILING_NUMBER = r"^(.*?)[.\-\s]*(\d+)\s*$"
LEADER_WITH_NUMBER = r"(?:\.{2,}|\.\s+\.|\-\s*\-|\t)\s*\d+\s*$"
NUMBERING_PREFIX = r"(?i)^(\d+(?:\.\d+)*\s+|ARTICLE\s+[IVX]+\s*)"

# Where a page number may stand, tried in this order.
PAGE_FORMS = [
    r"\.{3,}\s*(\d+)\s*$",
    r"-{3,}\s*(\d+)\s*$",
    r"\t(\d+)\s*$",
    r"\s{3,}(\d+)\s*$",
    r"(\d+)\s*[-–]\s*\d+\s*$",
    r"\s+(\d{1,4})\s*$",
]


def is_toc_heading(c: Column) -> Column:
    return F.coalesce(strip(c).rlike("(?i)" + "|".join(TOC_HEADINGS)), F.lit(False))


def _page(digits: Column, total_pages: Column) -> Column:
    """Page number when plausible: within the document and not a year."""
    value = F.when(F.length(F.ltrim(digits, F.lit("0"))).between(1, 9), digits.cast("long").cast("int"))
    return F.when(value.between(1, total_pages) & ~value.between(1900, 2100), value)


def parse_toc_line(df: DataFrame, col: str, total_pages: Column, out: str = "toc") -> DataFrame:
    """Add a struct (title, page_number, level, numbering); null for empty lines."""
    line = F.col("__line")
    staged = df.withColumn("__line", strip(F.coalesce(F.col(col), F.lit("")))).withColumn(
        "__clean", strip(F.regexp_replace(line, LEADER, " "))
    )
    clean = F.col("__clean")
    # (title, digits) per form: the leader-free line first, then the forms on the raw line
    tried = [F.struct(strip(F.regexp_extract(clean, TRAILING_NUMBER, 1)).alias("t"), F.regexp_extract(clean, TRAILING_NUMBER, 2).alias("d"))]
    for form in PAGE_FORMS:
        rx = f"^(.*?){form}"
        lead = strip(F.regexp_replace(strip(F.regexp_extract(line, rx, 1)), LEADER, ""))
        tried.append(F.struct(lead.alias("t"), F.regexp_extract(line, rx, 2).alias("d")))
    checked = F.transform(
        F.filter(F.array(*tried), lambda c: (c["t"] != "") & (c["d"] != "")),
        lambda c: F.struct(c["t"].alias("t"), _page(c["d"], total_pages).alias("p")),
    )
    found = F.try_element_at(F.filter(checked, lambda c: c["p"].isNotNull()), F.lit(1))
    staged = staged.withColumn("__found", F.when(line.rlike(r"\d\s*$"), found))
    staged = staged.withColumn("__title", F.coalesce(F.col("__found.t"), clean))
    title = F.col("__title")
    number = rstrip(F.regexp_extract(title, NUMBERING_PREFIX, 1))
    rest = strip(F.regexp_replace(title, NUMBERING_PREFIX, ""))
    staged = staged.withColumn("__number", F.when(title.rlike(NUMBERING_PREFIX), number))
    basis = F.coalesce(F.col("__number"), line)
    level = F.when(basis.rlike(r"^\d+\.\d+\.\d+"), 3).when(basis.rlike(r"^\d+\.\d+"), 2).otherwise(1)
    entry = F.struct(
        F.when(F.col("__number").isNotNull() & (rest != ""), rest).otherwise(title).alias("title"),
        F.col("__found.p").alias("page_number"),
        level.cast("int").alias("level"),
        F.col("__number").alias("numbering"),
    )
    return staged.withColumn(out, F.when(title != "", entry)).drop(
        "__line", "__clean", "__found", "__title", "__number"
    )
