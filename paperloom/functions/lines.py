"""Rules over the lines of one text cell.

The lines stay in an array, so none of these needs a shuffle: every rule that
looks at the previous line zips the array with itself shifted by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# Line patterns of the unwrap rules.
UNWRAP_MARKER = (
    r"(?i)^\s*(?:\([a-z]{1,3}\)|\([ivxlcdm]+\)|\(\d\)|[a-z]\.|\d+\.|\d+\.\d+|[•\-–—]\s)"
)
SENTENCE_END = r"[.;:!?]\s*$|[.;:!?][\"”’]\s*$"
PAREN_NUMBER = r"^\(\d+\)\s*"

# Line patterns of the reflow rules.
REFLOW_MARKER = (
    r"^\s*(?:\([a-zA-Z]{1,3}\)(?:\s|$)|\([ivxIVX]{1,8}\)(?:\s|$)|\([0-9]\)(?:\s|$)|[0-9]+[.)]\s|\-\s)"
)
BOLD_LINE = r"^\s*\*\*[^*]+\*\*\s*$"


def shifted(arr: Column) -> Column:
    """The array moved one place to the right, null first."""
    return F.slice(F.concat(F.array(F.lit(None).cast("string")), arr), 1, F.size(arr))


def unwrap_lines(df: DataFrame, col: str = "content") -> DataFrame:
    """Undo physical line breaks inside sentences (section rules)."""
    staged = df.withColumn("__ln", F.transform(F.split(F.coalesce(F.col(col), F.lit("")), "\n"), strip))

    def piece(x: Column, p: Column) -> Column:
        ended = p.rlike(SENTENCE_END)
        listed = x.rlike(UNWRAP_MARKER)
        breaks = (
            (x == "")
            | (p == "")
            | F.when(listed, ended | ~x.rlike(PAREN_NUMBER)).otherwise(
                x.rlike(r"^\s*\|") | x.rlike(r"^\*\*") | ended
            )
        )
        return F.when(p.isNull(), x).when(breaks, F.concat(F.lit("\n"), x)).otherwise(F.concat(F.lit(" "), x))

    joined = F.array_join(F.zip_with("__ln", shifted(F.col("__ln")), piece), "")
    return staged.withColumn(col, joined).drop("__ln")


def reflow_paragraphs(df: DataFrame, col: str = "content") -> DataFrame:
    """Undo physical line breaks inside paragraphs (clause rules)."""
    staged = df.withColumn("__ln", F.split(F.coalesce(F.col(col), F.lit("")), "\n"))

    def piece(x: Column, p: Column) -> Column:
        t = strip(x)
        block = x.rlike(REFLOW_MARKER) | t.startswith("|") | x.rlike(BOLD_LINE)
        paragraph = p.rlike(r"[.;:]\s*$") & x.rlike(r"^\s*\([^)]{5,}")
        return (
            F.when(p.isNull(), F.when(t == "", F.lit("")).otherwise(x))
            .when(t == "", F.lit("\n"))
            .when((strip(p) == "") | block | paragraph, F.concat(F.lit("\n"), x))
            .otherwise(F.concat(F.lit(" "), t))
        )

    joined = F.array_join(F.zip_with("__ln", shifted(F.col("__ln")), piece), "")
    return staged.withColumn(col, joined).drop("__ln")


# Table leftovers in running text, handled in this order.
HEADER_AND_RULE = r"(?m)^(\|[^\n]+\|)\s*\n(\|\s*[-:]+\s*(?:\|\s*[-:]+\s*)*\|)\s*$"
RULE_ONLY = r"(?m)^\|\s*[-:]+\s*(?:\|\s*[-:]+\s*)*\|\s*$"
LONE_ROW = r"(?m)^\|([^|]+(?:\|[^|]+)?)\|\s*$"


def _cells(row: Column) -> Column:
    return F.transform(F.split(row, r"\|"), strip)


# The two characters that mark a stretch, the one that stands for them in a text, and what they become there.
MARKS = [("\u0004", "\u0004d"), ("\u0002", "\u0004b"), ("\u0003", "\u0004c")]


def _guarded(text: Column) -> Column:
    """The text with its own marker characters replaced; ``_plain`` restores them."""
    for mark, shown in MARKS:
        text = F.replace(text, F.lit(mark), F.lit(shown))
    return text


def _plain(text: Column) -> Column:
    for mark, shown in reversed(MARKS):
        text = F.replace(text, F.lit(shown), F.lit(mark))
    return text


def _rewrite_marked(text: Column, rewrite) -> Column:
    """Apply ``rewrite`` to the stretches between the two marker characters, restoring the text's own."""
    parts = F.split(text, "[\u0002\u0003]")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, rewrite(_plain(x))).otherwise(_plain(x))), "")


def clean_ghost_tables(c: Column) -> Column:
    """Turn rows of wrongly detected tables back into text."""
    headers = _rewrite_marked(
        F.regexp_replace(_guarded(c), HEADER_AND_RULE, "\u0002$1\u0003"),
        lambda x: F.array_join(F.filter(_cells(x), lambda v: v != ""), " "),
    )
    no_rules = F.regexp_replace(headers, RULE_ONLY, "")

    def lone(x: Column) -> Column:
        inner = F.regexp_extract(x, r"(?s)^\|([^|]+(?:\|[^|]+)?)\|", 1)
        return F.when(F.length(strip(inner)) >= 20, F.array_join(_cells(inner), " ")).otherwise(x)

    rows = _rewrite_marked(F.regexp_replace(_guarded(no_rules), LONE_ROW, "\u0002$0\u0003"), lone)
    blank = lambda v: F.regexp_replace(v, r"\n{3,}", "\n\n")
    return F.when(c.contains("|"), blank(rows)).otherwise(blank(c))


# Bracketed references and the keyword that may precede one.
REF_ONLY = r"^\s*\d+(?:\.\d+)+\s+\[.*?\]\.?\s*$"
REF_PUNCT = r"^\s*\d+(?:\.\d+)+\s+\[.*?\]\s*[,;:.]"
REF_CONTINUES = (
    r"(?i)^\s*\d+(?:\.\d+)+\s+\[.*?\]\s*,?\s+(?:the|a|an|this|that|may|shall|and|or|to|in|of|for|with|by)\s"
)
REF_TRAILING = r"^\s*\d+(?:\.\d+)+\s+\[.*?\]\s*,?\s*(.*)"
REF_KEYWORD = r"(?i)(?:Sub-?\s*Clause|Clause|Article|Section|Part|Chapter)\s*$"

# Fixed value: a line that starts with a number of at least two parts and some text.
NUMBERED_LINE = r"^[ \t]*(\d+(?:\.\d+){1,})[ \t]+\S"


def is_cross_reference(line: Column, prev_line: Column) -> Column:
    """A numbered line that continues a reference instead of opening a clause."""
    t = strip(line)
    return (
        t.rlike(REF_ONLY)
        | t.rlike(REF_PUNCT)
        | t.rlike(REF_CONTINUES)
        | (F.length(strip(F.regexp_extract(t, REF_TRAILING, 1))) > 30)
        | F.coalesce(strip(prev_line).rlike(REF_KEYWORD), F.lit(False))
    )
