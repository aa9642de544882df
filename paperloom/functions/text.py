"""Row-local text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters removed at both ends by a Unicode-aware trim.
BLANKS = " \t\n\r\f\u000b\u00a0\u3000"

# Input limits in characters per purpose.
CLIP_LIMITS = {"embed": 8000, "prompt": 12000, "recheck": 4000, "summary": 2000, "small_model": 300}


def strip(c: Column) -> Column:
    """Trim white space including line feeds and no-break spaces."""
    return F.trim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def normalize_ws(c: Column) -> Column:
    """Collapse white space runs to one blank and trim."""
    return F.trim(F.regexp_replace(c, r"[\s\u00a0\u3000]+", " "))


def content_hash(c: Column) -> Column:
    """SHA-256 of the white-space-normalised text."""
    return F.sha2(normalize_ws(c), 256)


def safe_join(lines: Column) -> Column:
    """Join lines with blanks; undo a line-end hyphen between letters."""
    cleaned = F.filter(F.transform(lines, lambda x: normalize_ws(F.coalesce(x, F.lit("")))), lambda x: x != "")
    joined = F.array_join(cleaned, "\n")  # no line holds a line feed any more
    merged = F.regexp_replace(joined, "(?<=[A-Za-z])-\n(?=[a-z_])", "")
    return normalize_ws(merged)


def letter_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^a-zA-Z]", ""))


def upper_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^A-Z]", ""))


def upper_ratio(c: Column) -> Column:
    """Share of upper-case letters among ASCII letters, 0 without letters."""
    n = letter_count(c)
    return F.when(n > 0, upper_count(c) / n).otherwise(F.lit(0.0))


def normalize_pattern(c: Column, ruleset: str) -> Column:
    """Line text with numbers masked, for counting repeats across pages."""
    if ruleset == "layout":
        return F.lower(F.regexp_replace(normalize_ws(c), r"\d+", "0"))
    return F.regexp_replace(F.lower(strip(c)), r"\d+", "#")


# Page-number line patterns of the two rule sets.
PAGE_NUMBER_PATTERNS = {
    "layout": [
        r"^\s*\d+\s*$",
        r"^\s*-\s*\d+\s*-\s*$",
        r"^\s*page\s+\d+(\s+of\s+\d+)?\s*$",
        r"^\s*p\.?\s*\d+\s*$",
        r"^\s*\d+\s*\/\s*\d+\s*$",
    ],
    "sections": [
        r"^\s*page\s+\d+\s+of\s+\d+\s*$",
        r"^\s*\d+\s*/\s*\d+\s*$",
        r"^\s*[-–]\s*\d+\s*[-–]\s*$",
        r"^\s*p\.?\s*\d+\s*$",
        r"^\s*\d+\s*$",
    ],
}


def is_page_number(c: Column, ruleset: str = "sections") -> Column:
    """True for lines that hold nothing but a page number."""
    return strip(c).rlike("(?i)" + "|".join(PAGE_NUMBER_PATTERNS[ruleset]))


def clip_text(c: Column, purpose: str) -> Column:
    return F.substring(c, 1, CLIP_LIMITS[purpose])


def preview(c: Column, n: int) -> Column:
    """First ``n`` characters, with an ellipsis when something was cut."""
    return F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, F.lit("…")).otherwise(F.lit("")))


def list_marker(c: Column) -> Column:
    """Leading list marker of a paragraph: struct(level, marker, body) or null."""
    # Roman, alphabetic and numeric marker patterns, tried in this order.
    roman = r"(?i)^\((i{1,3}|iv|vi{0,3}|ix|xi{0,3}|xiv|xv|x{1,3})\)\s+"
    alpha = r"(?i)^\(([a-z])\)\s+"
    digit = r"^\((\d+)\)\s+"
    t = strip(c)

    def hit(rx: str, level: str) -> Column:
        lead = F.regexp_extract(t, f"{rx}", 0)
        return F.when(
            t.rlike(rx),
            F.struct(
                F.lit(level).alias("level"),
                rstrip(lead).alias("marker"),
                F.substring(t, F.length(lead) + 1, F.length(t)).alias("body"),
            ),
        )

    return F.coalesce(hit(roman, "roman"), hit(alpha, "alpha"), hit(digit, "alpha"))


def split_recommendations(c: Column) -> Column:
    """Recommendation items split at line feeds and semicolons, bullets removed."""
    parts = F.split(F.coalesce(c, F.lit("")), "[\n;；]")
    cleaned = F.transform(parts, lambda x: strip(F.regexp_replace(x, r"^[-•*]\s*", "")))
    return F.filter(cleaned, lambda x: x != "")
