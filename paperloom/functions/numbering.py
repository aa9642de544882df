"""Clause numbering: detection, roman numerals, stripping, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# Numbering patterns; the kind is decided in this order.
KO_ARTICLE = r"^\s*제\s*(\d+)\s*조"
SCHEDULE = r"(?i)^\s*(SCHEDULE|EXHIBIT|APPENDIX)\s+([A-Z0-9]*)\b[.\-:\s]*(.*)"
ARTICLE = r"(?i)^\s*ARTICLE\s+([IVXLCDM]+|\d+)\b[.\-:\s]*(.*)"
SECTION = r"(?i)^\s*SECTION\s+(\d+(?:\.\d+)*)\b[.\-:]?\s*(.*)"
ROMAN_ITEM = r"^\s*\(([ivxIVX]{1,8})\)\s+(.*)"
ALPHA_ITEM = r"^\s*\(([a-zA-Z])\)\s+(.*)"
DECIMAL = r"^\s*(\d+(?:\.\d+){0,6})\s*[.)]?\s+(.*)"

# Fixed value: shape of a valid roman numeral (emptiness is tested apart).
ROMAN_SHAPE = r"^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"



def roman_to_int(c: Column) -> Column:
    """Value of a roman numeral, null when it is not one."""
    s = F.upper(strip(c))

    def count(token: str) -> Column:
        return (F.length(s) - F.length(F.replace(s, F.lit(token), F.lit("")))) / F.lit(len(token))

    letters = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    # a smaller letter in front of a larger one was added once and must be subtracted: twice its value
    pairs = {"IV": 2, "IX": 2, "XL": 20, "XC": 20, "CD": 200, "CM": 200}
    total = sum((count(k) * v for k, v in letters.items()), F.lit(0)) - sum(
        (count(k) * v for k, v in pairs.items()), F.lit(0)
    )
    return F.when((s != "") & s.rlike(ROMAN_SHAPE), total.cast("int"))


def drop_leading_zeros(c: Column) -> Column:
    """Canonical form of a digit string or of a dotted number."""
    return F.regexp_replace(c, r"(?<![0-9])0+(?=[0-9])", "")


def numbering_kind(t: Column) -> Column:
    """Which pattern a trimmed text matches first."""
    return (
        F.when(t == "", None)
        .when(t.rlike(KO_ARTICLE), "ko_article")
        .when(t.rlike(SCHEDULE), "schedule")
        .when(t.rlike(ARTICLE), "named_article")
        .when(t.rlike(SECTION), "section")
        .when(t.rlike(ROMAN_ITEM), "roman_paren")
        .when(t.rlike(ALPHA_ITEM), "alpha_paren")
        .when(t.rlike(DECIMAL), "number")
    )


def numbering_remainder(t: Column, kind: Column) -> Column:
    """Text after the number; the whole text when nothing is stripped."""
    return strip(
        F.when(kind == "schedule", F.regexp_extract(t, SCHEDULE, 3))
        .when(kind == "named_article", F.regexp_extract(t, ARTICLE, 2))
        .when(kind == "section", F.regexp_extract(t, SECTION, 2))
        .when(kind == "roman_paren", F.regexp_extract(t, ROMAN_ITEM, 2))
        .when(kind == "alpha_paren", F.regexp_extract(t, ALPHA_ITEM, 2))
        .when(kind == "number", F.regexp_extract(t, DECIMAL, 2))
        .otherwise(t)
    )


def strip_numbering(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    return numbering_remainder(t, numbering_kind(t))


def annotate_numbering(df: DataFrame, col: str, out: str = "hint") -> DataFrame:
    """Add a struct (raw, kind, normalized, level, components, is_heading, remainder), null without a number."""
    t, kind, raw = F.col("__t"), F.col("__kind"), F.col("__raw")
    staged = (
        df.withColumn("__t", strip(F.coalesce(F.col(col), F.lit(""))))
        .withColumn("__kind", numbering_kind(t))
        .withColumn(
            "__raw",
            F.when(kind == "ko_article", F.regexp_extract(t, KO_ARTICLE, 1))
            .when(
                kind == "schedule",
                F.when(F.regexp_extract(t, SCHEDULE, 2) == "", F.lit("1")).otherwise(F.regexp_extract(t, SCHEDULE, 2)),
            )
            .when(kind == "named_article", F.regexp_extract(t, ARTICLE, 1))
            .when(kind == "section", F.regexp_extract(t, SECTION, 1))
            .when(kind == "roman_paren", F.regexp_extract(t, ROMAN_ITEM, 1))
            .when(kind == "alpha_paren", F.regexp_extract(t, ALPHA_ITEM, 1))
            .when(kind == "number", F.regexp_extract(t, DECIMAL, 1)),
        )
        .withColumn("__rest", numbering_remainder(t, kind))
        .withColumn("__num", drop_leading_zeros(raw))
        .withColumns(
            {
                "__short": (F.length("__rest") <= 80) & (F.length(raw) <= 8),
                "__roman": F.when(kind.isin("named_article", "roman_paren"), roman_to_int(raw).cast("string")),
            }
        )
    )
    num, short = F.col("__num"), F.col("__short")
    in_range = F.when(raw.rlike(r"^\d{1,8}$"), raw.cast("int").between(1, 300)).otherwise(False)
    promoted = (kind == "number") & short & in_range
    roman = F.col("__roman")
    named = F.when(raw.rlike(r"^\d+$"), num).otherwise(F.coalesce(roman, F.upper(raw)))
    depth = F.size(F.split(num, r"\."))
    struct = F.struct(
        raw.alias("raw"),
        F.when(kind.isin("ko_article", "named_article") | promoted, "article")
        .when(kind == "number", "decimal")
        .otherwise(kind)
        .alias("kind"),
        F.when(kind == "ko_article", F.concat(F.lit("ARTICLE "), num))
        .when(kind == "schedule", F.concat(F.upper(F.regexp_extract(t, SCHEDULE, 1)), F.lit(" "), raw))
        .when(kind == "named_article", F.concat(F.lit("ARTICLE "), named))
        .when(kind == "section", F.concat(F.lit("SECTION "), num))
        .when(kind.isin("roman_paren", "alpha_paren"), F.concat(F.lit("("), F.lower(raw), F.lit(")")))
        .when(promoted, F.concat(F.lit("ARTICLE "), num))
        .otherwise(num)
        .alias("normalized"),
        F.when(kind == "schedule", 0)
        .when(kind.isin("ko_article", "named_article") | promoted, 1)
        .when(kind == "section", 1 + depth)
        .when(kind == "roman_paren", 6)
        .when(kind == "alpha_paren", 5)
        .otherwise(2 + depth)
        .cast("int")
        .alias("level"),
        F.when(kind == "schedule", F.array(raw))
        .when(kind == "named_article", F.array(named))
        .when(kind == "roman_paren", F.array(F.coalesce(roman, F.lower(raw))))
        .when(kind == "alpha_paren", F.array(F.lower(raw)))
        .otherwise(F.split(num, r"\."))
        .alias("components"),
        F.when(kind == "number", short).otherwise(~kind.isin("roman_paren", "alpha_paren")).alias("is_heading"),
        F.col("__rest").alias("remainder"),
    )
    return staged.withColumn(out, F.when(kind.isNotNull(), struct)).drop(
        "__t", "__kind", "__raw", "__rest", "__num", "__short", "__roman"
    )


# Forms in which a heading carries its clause number.
HEADING_NUMBER_FORMS = [
    r"^\s*(\d+(?:\.\d+)*)\s",
    r"^\s*(\d+(?:\.\d+)*)[.)]\s",
    r"^\s*(\d+(?:\.\d+)*)[.)]\s*$",
    r"(?i)^\s*(?:ARTICLE|CLAUSE|SECTION|CHAPTER|PART)\s+(\d+(?:\.\d+)*)\b",
]


def heading_number(c: Column) -> Column:
    """Clause number a heading starts with, or null."""
    found = [F.when(c.rlike(rx), F.regexp_extract(c, rx, 1)) for rx in HEADING_NUMBER_FORMS]
    return F.coalesce(*found)


def is_child(parent: Column, child: Column) -> Column:
    """Heading ``child`` carries a number below that of heading ``parent``."""
    a, b = heading_number(parent), heading_number(child)
    return F.coalesce(b.startswith(F.concat(a, F.lit("."))), F.lit(False))


def is_sibling_or_child(own: Column, candidate: Column) -> Column:
    """Clause number ``candidate`` belongs to the same branch as ``own``."""
    h, c = F.split(own, r"\."), F.split(candidate, r"\.")
    nh, nc = F.size(h), F.size(c)
    below = candidate.startswith(F.concat(own, F.lit(".")))
    parent_of = lambda arr, n: F.array_join(F.slice(arr, 1, F.greatest(n - 1, F.lit(0))), ".")
    sibling = (nh == nc) & (nh >= 2) & (parent_of(h, nh) == parent_of(c, nc))
    same_top = (nh == 1) & (nc >= 2) & (h[0] == c[0])
    same_two = (nh >= 3) & (nc >= 3) & (h[0] == c[0]) & (F.try_element_at(h, F.lit(2)) == F.try_element_at(c, F.lit(2)))
    return F.coalesce(below | sibling | same_top | same_two, F.lit(False))


def clause_depth(number: Column) -> Column:
    """Display depth 0-4 of a clause number."""
    roman = r"(?i)^\((?:i{1,3}|iv|vi{0,3}|ix|xi{0,3}|xiv|x{1,3})\)$"
    return F.coalesce(
        F.when(number.rlike(roman), 3)
        .when(number.rlike(r"(?i)^\([a-z]\)$"), 2)
        .when(number.rlike(r"^\d+(?:\.\d+)+$"), F.least(F.size(F.split(number, r"\.")) - 1, F.lit(4)))
        .when(number.rlike(r"(?i)^SECTION\s+\d+\.\d"), 1)
        .otherwise(0),
        F.lit(0),
    ).cast("int")
