"""Heading tests on raw lines and on section headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import ALPHA_ITEM, ARTICLE, DECIMAL, ROMAN_ITEM, SCHEDULE, SECTION
from .text import strip
from .zoning import MAJOR_PARTS, with_part

# Structural heading patterns.
DOTTED = r"^\s*(\d+\.){1,}\d*\s+\S"
KEYWORD = r"(?i)^\s*(ARTICLE|CLAUSE|PART|SECTION|CHAPTER)\s+[\dIVXivx]+"
KO_UNIT = r"^\s*제\s*\d+\s*[조장절]"
ROMAN_TITLE = r"^\s*[IVX]{1,5}\.\s+[A-Z]"
LETTER_TITLE = r"^\s*[A-Z]\.\s+[A-Z][A-Z]"
BARE_NUMBER = r"^\s*\d{1,2}\s+[A-Z][a-z]"

# Patterns that mark running text rather than a heading.
COUNTED_UNIT = (
    r"(?i)^\s*\d+\s+(?:days?\b|months?\b|years?\b|weeks?\b|hours?\b|calendar\b|business\b|working\b|percent\b|%"
    r"|of\b|in\b|to\b|for\b|from\b|by\b|with\b|at\b|or\b|and\b|under\b|per\b|no\.\b|km\b|m\b|kg\b)"
)
REF_PUNCT = r"^\s*\d+\.\d+\s+\[.*?\][,;:]"
REF_CONTINUES = (
    r"(?i)^\s*\d+\.\d+\s+\[.*?\]\s*,?\s+(?:the|a|an|this|that|may|shall|and|or|to|in|of|for|with|by)\b"
)
REF_TRAILING = r"^\s*\d+\.\d+\s+\[.*?\]\s*,?\s*(.*)"
KEYWORD_PUNCT = r"(?i)^\s*(?:Sub-?\s*)?(?:ARTICLE|CLAUSE|PART|SECTION|CHAPTER)\s+\d+(?:\.\d+)*\s*[,:;]"
KEYWORD_ONLY = r"(?i)^\s*(?:Sub-?\s*)?(?:ARTICLE|CLAUSE|PART|SECTION|CHAPTER)\s+\d+(?:\.\d+)+\s*$"
KEYWORD_PREPOSITION = r"(?i)\d\s+(of|in|under|to|for|from|by|with|at)\s"
KEYWORD_BRACKET = r"(?i)(?:ARTICLE|CLAUSE|SECTION|CHAPTER|PART)\s+\d[\d.]*\s*\["
SENTENCE_LIKE = r"(?i)[.!?;,]\s*\S|^\s*(?:the|a|an|this|that|these|those|in|of|for|with|by|to)\s"
ALL_CAPS = r"^[A-Z][A-Z\s]{3,58}$"
ALL_CAPS_KEYWORD = r"(?i)^\s*(ARTICLE|CLAUSE|PART|SECTION|CHAPTER|SCHEDULE|ANNEX|APPENDIX|EXHIBIT)\b"
STOP_WORDS = ["THE", "A", "AN", "IN", "OF", "FOR", "WITH", "BY", "TO", "AND", "OR", "AT"]
NUMBERED_HEADING = (
    r"(?i)^\s*(?:(?:ARTICLE|CLAUSE|SECTION|PART|CHAPTER)\s+[\dIVXLCDM]|제\s*\d+\s*조"
    r"|\d+(?:\.\d+)*\s*[.)]\s|\d+(?:\.\d+)+\s)"
)


def heading_line(text: Column, size_ratio: Column | None = None, bold_ratio: Column | None = None) -> Column:
    """Is this raw line a heading?  The order of the tests matters."""
    return let(strip(F.coalesce(text, F.lit(""))), lambda t: _heading_test(t, size_ratio, bold_ratio))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _heading_test(t: Column, size_ratio: Column | None, bold_ratio: Column | None) -> Column:
    dotted_number = t.rlike(r"^\s*\d+(?:\.\d+)+\s")
    deep_number = t.rlike(r"^\s*\d+(?:\.\d+){2,}\s")
    words = F.split(t, r"\s+")
    commas = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
    keyword_ok = (
        (F.length(t) <= 60)
        & ~t.endswith(":")
        & ~t.rlike(r"\d\s*\(")
        & ~t.rlike(KEYWORD_PREPOSITION)
        & ~t.rlike(KEYWORD_BRACKET)
    )
    size_up = F.lit(False)
    size_big = F.lit(False)
    if size_ratio is not None:
        size_up = F.coalesce(size_ratio >= 1.05, F.lit(False))
        size_big = F.coalesce(size_ratio > 1.15, F.lit(False))
    any_bold = F.lit(False)
    mostly_bold = F.lit(False)
    if bold_ratio is not None:
        any_bold = F.coalesce(bold_ratio > 0, F.lit(False))
        mostly_bold = F.coalesce(bold_ratio >= 0.5, F.lit(False))
    meaningful = F.size(F.filter(words, lambda w: ~w.isin(STOP_WORDS)))
    caps = (
        t.rlike(ALL_CAPS)
        & F.size(words).between(2, 8)
        & (t.rlike(ALL_CAPS_KEYWORD) | ((meaningful >= 2) & (size_up | any_bold)))
    )
    plain = ~t.rlike(SENTENCE_LIKE)
    dashes = t.contains("–") | t.contains("—") | t.contains(" - ")
    return (
        F.when(t == "", False)
        .when(~dotted_number & t.rlike(COUNTED_UNIT), False)
        .when(~dotted_number & ((F.length(t) > 120) | (commas >= 2)), False)
        .when(deep_number, True)
        .when(t.rlike(r"[.;!?]$"), False)
        .when(t.rlike(REF_PUNCT), False)
        .when(t.rlike(REF_CONTINUES), False)
        .when(F.length(strip(F.regexp_extract(t, REF_TRAILING, 1))) > 30, False)
        .when(t.startswith("["), False)
        .when(t.rlike(r"^\p{Ll}"), False)
        .when(t.rlike(r"^[\"“']"), False)
        .when(t.rlike(KEYWORD_PUNCT) | t.rlike(KEYWORD_ONLY), False)
        .when(t.rlike(DOTTED), True)
        .when(t.rlike(KEYWORD) & keyword_ok, True)
        .when(~t.rlike(KEYWORD) & (t.rlike(KO_UNIT) | t.rlike(ROMAN_TITLE) | t.rlike(LETTER_TITLE)), True)
        .when(~t.rlike(KEYWORD) & t.rlike(BARE_NUMBER) & (F.length(t) <= 80) & (F.size(words) <= 10), True)
        .when(t.endswith("]") & ~t.rlike(r"^\s*\d"), False)
        .when(t.endswith(")"), False)
        .when(caps, True)
        .when(size_big & (F.length(t) <= 100) & plain, True)
        .when(mostly_bold & (F.length(t) <= 60) & plain & ~dashes, True)
        .otherwise(False)
    )


def is_heading_line(
    df: DataFrame, text: str = "text", size_ratio: str | None = None, bold_ratio: str | None = None
) -> DataFrame:
    test = _heading_test(
        F.col("__t"), F.col(size_ratio) if size_ratio else None, F.col(bold_ratio) if bold_ratio else None
    )
    return df.withColumn("__t", strip(F.coalesce(F.col(text), F.lit("")))).withColumn("is_heading", test).drop("__t")


def is_numbered_heading(c: Column) -> Column:
    """Heading that ends the preamble."""
    return F.coalesce(strip(c).rlike(NUMBERED_HEADING), F.lit(False))


def text_heading(line: Column) -> Column:
    """Heading test of the plain-text splitter: numbering hint or keyword."""
    return let(strip(line), _text_heading_test)


def _text_heading_test(t: Column) -> Column:
    rest = strip(F.regexp_extract(t, DECIMAL, 2))
    number = F.regexp_extract(t, DECIMAL, 1)
    listed = t.rlike(ROMAN_ITEM) | t.rlike(ALPHA_ITEM)
    return (t != "") & (
        t.rlike(r"^제\s*\d+\s*조|^[가-힣]\.\s")
        | t.rlike(SCHEDULE)
        | t.rlike(ARTICLE)
        | t.rlike(SECTION)
        | (~listed & t.rlike(DECIMAL) & (F.length(rest) <= 80) & (F.length(number) <= 8))
        | t.rlike(r"(?i)^(Article|Section|Clause|Part)\s+\d+|^Part\s+[IVX]+")
    )


def section_level(heading: Column) -> Column:
    """Level of a section heading from its own number."""
    t = strip(heading)
    number = F.regexp_extract(t, r"^\s*(\d+(?:\.\d+)*)", 1)
    return (
        F.when(number != "", F.size(F.split(number, r"\.")))
        .when(t.rlike(r"(?i)^\s*(ARTICLE|CHAPTER|PART)\s+"), 1)
        .when(t.rlike(r"(?i)^\s*(SECTION|CLAUSE)\s+"), 2)
        .when(t.rlike(r"^\s*제\s*\d+\s*[장편]"), 1)
        .when(t.rlike(r"^\s*제\s*\d+\s*[절조]"), 2)
        .otherwise(1)
    )


def with_section_level(lines: DataFrame, heading: str = "heading") -> DataFrame:
    """Add ``level``; headings that name a major part are level 1."""
    forced = F.coalesce(F.col("__part").isin(MAJOR_PARTS), F.lit(False))
    level = F.when(forced, 1).otherwise(section_level(F.col(heading))).cast("int")
    return with_part(lines, heading, "sections", "__part").withColumn("level", level).drop("__part")


def heading_remainder_kind(remainder: Column) -> Column:
    """Does the text after the number read as a title or as body text?"""
    r = strip(F.coalesce(remainder, F.lit("")))
    commas = F.length(r) - F.length(F.replace(r, F.lit(","), F.lit("")))
    bracket_title = r.rlike(r"^\[[A-Z]") & (commas < 2)
    return (
        F.when(r == "", "title")
        .when(r.rlike(r"(?i)\bmeans\b|\bhas\s+the\s+meaning\b|\bshall\s+mean\b"), "body")
        .when(r.rlike(r"^[\"'“”]"), "body")
        .when(r.startswith("[") & ~bracket_title & (F.length(r) > 20), "body")
        .when(F.length(r) > 80, "body")
        .when(r.rlike(r"[.;!?]\s+\S"), "body")
        .otherwise("title")
    )
