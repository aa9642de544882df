"""Document-part detection on headings and the zone rules built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import Rules
from .text import normalize_ws, strip, upper_ratio

# Zones that are never analysed.
NON_ANALYSIS_ZONES = [
    "toc",
    "cover_page",
    "preamble",
    "drawing_list",
    "form_of_tender",
    "bill_of_quantities",
    "appendices",
    "technical_specifications",
]

# White lists of analysed zones.
TARGET_WHITELISTS = {
    "display": [
        "contract_agreement",
        "general_conditions",
        "particular_conditions",
        "conditions_of_contract",
        "commercial_terms",
        "definitions",
        "letter_of_acceptance",
    ],
    "confidence": [
        "contract_agreement",
        "general_conditions",
        "particular_conditions",
        "conditions_of_contract",
        "commercial_terms",
        "definitions",
    ],
}

# Canonical display order of zones.
ZONE_ORDER = [
    "preamble",
    "contract_agreement",
    "general_conditions",
    "particular_conditions",
    "conditions_of_contract",
    "commercial_terms",
    "definitions",
    "letter_of_acceptance",
    "technical_specifications",
    "appendices",
    "toc",
    "cover_page",
    "drawing_list",
    "form_of_tender",
    "bill_of_quantities",
]

# Parts that force heading level 1.
MAJOR_PARTS = [
    "contract_agreement",
    "general_conditions",
    "particular_conditions",
    "conditions_of_contract",
    "commercial_terms",
    "technical_specifications",
    "appendices",
    "annexure",
    "amendment",
    "letter_of_acceptance",
    "form_of_tender",
    "bill_of_quantities",
]

# Zone types a plain-text paragraph may keep.
PARAGRAPH_ZONES = [
    "contract_body",
    "general_conditions",
    "particular_conditions",
    "technical_specification",
    "drawing_list",
    "schedule",
    "cover_page",
    "definitions",
    "commercial_terms",
    "appendices",
    "toc",
    "other",
]

# Fixed values: (part, analysed, heading patterns), first match wins.
_GENERAL = [
    r"^\s*(?:part\s+[ivx\d]+\s*[-:]\s*)?general\s+conditions(?:\s+of\s+contract)?\b",
    r"^\s*gc\b.*\bgeneral\s+conditions\b",
    r"^\s*book\s*(?:ii|2)\b.*\bgeneral\s+conditions\b",
    r"^\s*section\s*[a-z]\b.*\bgeneral\s+conditions\b",
    r"^\s*general\s+provisions\s*$",
    r"^\s*\d+\s+general\s+provisions\b",
    r"^\s*일\s*반\s*(?:사항|조건|조항)\s*$",
    r"^\s*공\s*통\s*(?:사항|조건|조항)\s*$",
]
_PARTICULAR = [
    r"^\s*(?:part\s+[ivx\d]+\s*[-:]\s*)?particular\s+conditions(?:\s+of\s+contract)?\b",
    r"^\s*special\s+conditions(?:\s+of\s+contract)?\b",
    r"^\s*pc\b.*\bparticular\s+conditions\b",
    r"^\s*book\s*(?:iii|3)\b.*\bparticular\s+conditions\b",
    r"^\s*section\s*[b-z]\b.*\bparticular\s+conditions\b",
    r"^\s*특\s*수\s*(?:사항|조건|조항)\s*$",
    r"^\s*특\s*별\s*(?:사항|조건|조항)\s*$",
]
_TECHNICAL = [
    r"^\s*(?:part\s+[ivx\d]+\s*[-:]\s*)?(?:technical\s+)?specifications?\b",
    r"^\s*\d+\s+(?:technical\s+)?specifications?\b",
    r"^\s*employer'?s\s+requirements\b",
    r"^\s*owner'?s\s+requirements\b",
]
_COMMERCIAL = [r"^\s*commercial\s+terms\b", r"^\s*price\s+and\s+payment\b"]
_APPENDICES = [
    r"^\s*schedules?\b",
    r"^\s*schedule\s+[a-z0-9]+\b",
    r"^\s*appendi(?:x|ces)\b",
    r"^\s*exhibits?\b",
    r"^\s*annex(?:es)?\b",
]
_DEFINITIONS = [
    r"^\s*(?:\d+(?:\.\d+)*)\s*definitions\b",
    r"^\s*\d+\s+definitions\b",
    r"^\s*definitions\b",
]
_TOC = [r"^\s*table\s+of\s+contents\b", r"^\s*contents\b", r"^\s*index\b"]
_COVER = [r"^\s*cover\s+(?:page|sheet)\b", r"^\s*title\s+page\b"]
_DRAWINGS = [r"^\s*(?:list\s+of\s+)?drawings?\b", r"^\s*drawing\s+(?:register|schedule|list)\b"]
_TENDER = [r"^\s*form\s+of\s+tender\b", r"^\s*tender\s+form\b"]
_LETTER = [r"^\s*letter\s+of\s+(?:acceptance|award|intent)\b"]
_QUANTITIES = [r"^\s*bill\s+of\s+quantities\b", r"^\s*(?:schedule\s+of\s+)?rates?\s+and\s+prices?\b"]

PART_PATTERNS: dict[str, list[tuple[str, bool, list[str]]]] = {
    "layout": [
        (
            "contract_agreement",
            True,
            [
                r"^\s*(?:part\s+[ivx\d]+\s*[-:]\s*)?contract\s+agreement\b",
                r"^\s*this\s+contract\s+agreement\b",
                r"^\s*epc\s+contract\s+agreement\b",
                r"^\s*agreement\s*$",
                r"^\s*계\s*약\s*서\s*$",
                r"^\s*(?:공사|용역|물품|도급|하도급)?\s*계약서\s*$",
            ],
        ),
        ("general_conditions", True, _GENERAL),
        ("particular_conditions", True, _PARTICULAR),
        (
            "conditions_of_contract",
            True,
            [
                r"^\s*(?:part\s+[ivx\d]+\s*[-:]\s*)?conditions\s+of\s+(?:contract|subcontract)\b",
                r"^\s*\d+\s+conditions\s+of\s+(?:contract|subcontract)\b",
                r"^\s*fidic\s+conditions\s+of\s+(?:contract|subcontract)\b",
                r"^\s*conditions\s*$",
                r"^\s*계약\s*(?:일반)?\s*조건\s*$",
            ],
        ),
        ("technical_specifications", False, _TECHNICAL),
        ("commercial_terms", True, _COMMERCIAL),
        ("appendices", False, _APPENDICES),
        ("definitions", True, _DEFINITIONS),
        ("toc", False, _TOC),
        ("cover_page", False, _COVER),
        ("drawing_list", False, _DRAWINGS),
        ("form_of_tender", False, _TENDER),
        ("letter_of_acceptance", True, _LETTER),
        ("bill_of_quantities", False, _QUANTITIES),
    ],
    "sections": [
        (
            "contract_agreement",
            True,
            [
                r"^\s*(?:part\s+[ivx\d]+\s*[-:]\s*)?contract\s+agreement\b",
                r"^\s*this\s+contract\s+agreement\b",
                r"^\s*계\s*약\s*서\s*$",
                r"^\s*(?:공사|용역|물품|도급|하도급)?\s*계약서\s*$",
                r"^\s*계약\s*체결\s*",
            ],
        ),
        ("general_conditions", True, _GENERAL),
        ("particular_conditions", True, _PARTICULAR),
        (
            "conditions_of_contract",
            True,
            [
                r"^\s*(?:part\s+[ivx\d]+\s*[-:]\s*)?conditions\s+of\s+(?:contract|subcontract)\b",
                r"^\s*\d+\s+conditions\s+of\s+(?:contract|subcontract)\b",
                r"^\s*fidic\s+conditions\s+of\s+(?:contract|subcontract)\b",
                r"^\s*계약\s*(?:일반)?\s*조건\s*$",
            ],
        ),
        ("technical_specifications", False, _TECHNICAL),
        ("commercial_terms", True, _COMMERCIAL),
        ("appendices", False, _APPENDICES),
        ("annexure", False, [r"^\s*별표\s*\d+\b", r"^\s*\[별표\s*\d+\]", r"^\s*별첨\s*\d+\b"]),
        ("amendment", True, [r"^\s*amendment(?:\s+no\.?\s*\d+)?\b", r"^\s*변경\s*계약서", r"^\s*계약\s*변경"]),
        ("definitions", True, _DEFINITIONS),
        ("toc", False, _TOC),
        ("cover_page", False, _COVER),
        ("drawing_list", False, _DRAWINGS),
        ("form_of_tender", False, _TENDER),
        ("letter_of_acceptance", True, _LETTER),
        ("bill_of_quantities", False, _QUANTITIES),
    ],
}

# Texts that name a part whatever they look like.
TRIGGER_AGREEMENT = r"(?i)^\s*this\s+contract\s+agreement\b"
TRIGGER_AGREEMENT_NOT = (
    r"(?i)^\s*this\s+contract\s+agreement\s+(?:together|and\s|dated|made|entered|shall|may|or\s|is\s)"
)
TRIGGER_GENERAL = r"(?i)^\s*general\s+provisions\s*$"

# Keyword fallback of the section rule set, first match wins.
ZONE_KEYWORDS = [
    (
        ["general condition", "general provision", "conditions of contract", "일반사항", "일반조건", "공통사항", "공통조건"],
        "general_conditions",
    ),
    (
        ["particular condition", "special condition", "특수사항", "특수조건", "특별사항", "특별조건"],
        "particular_conditions",
    ),
    (["definition", "glossary", "interpretation", "정의", "용어정의", "용어 정의"], "definitions"),
    (
        ["technical specification", "scope of work", "scope of supply", "기술사양", "기술 사양", "공사 범위", "업무범위"],
        "technical_specifications",
    ),
    (["commercial term", "price and payment", "상업조건", "대금조건", "지급조건"], "commercial_terms"),
    (["appendix", "appendices", "annex", "attachment", "schedule", "exhibit"], "appendices"),
    (["별표", "별첨", "첨부"], "annexure"),
    (["amendment", "변경계약서", "계약변경", "변경계약"], "amendment"),
    (["table of content", "목차", "차례"], "toc"),
    (["agreement", "this contract", "witnesseth", "recital", "계약서", "계약체결"], "contract_agreement"),
]


def analysis_target(zone: Column) -> Column:
    """Everything is analysed except the listed zones; unknown counts as analysed."""
    return F.coalesce(~zone.isin(NON_ANALYSIS_ZONES), F.lit(True))


def part_is_target(key: Column, ruleset: str) -> Column:
    wanted = [k for k, target, _ in PART_PATTERNS[ruleset] if target]
    return key.isin(wanted)


def _first_pattern(t: Column, ruleset: str) -> Column:
    chain = None
    for key, _, patterns in PART_PATTERNS[ruleset]:
        hit = t.rlike("(?i)" + "|".join(patterns))
        chain = F.when(hit, key) if chain is None else chain.when(hit, key)
    return chain


def with_part(
    df: DataFrame,
    heading: str,
    ruleset: str = "sections",
    out: str = "part",
    heading_like: Column | None = None,
    bold_ratio: Column | None = None,
    size_ratio: Column | None = None,
    upper_hint: Column | None = None,
    rules: Rules | None = None,
) -> DataFrame:
    """Add the part key a heading names, null when it names none.

    The cleaned heading is a column of its own, so the many tests share it.  Registered
    ``rules`` take the place of the rule set's patterns; its guards stay.
    """
    raw = F.coalesce(F.col(heading), F.lit(""))
    clean = normalize_ws(raw) if ruleset == "layout" else strip(F.replace(raw, F.lit("\n"), F.lit(" ")))
    t = F.col("__t")
    like = F.lit(True) if heading_like is None else heading_like
    typo = F.lit(False)
    for ratio, least in ((bold_ratio, 0.55), (size_ratio, 1.10), (upper_hint, 0.55)):
        if ratio is not None:
            typo = typo | F.coalesce(ratio >= least, F.lit(False))
    words = F.size(F.split(t, r"\s+"))
    if ruleset == "layout":
        upper = upper_ratio(t)
        if upper_hint is not None:
            upper = F.greatest(upper, F.coalesce(upper_hint, F.lit(0.0)))
        shaped = (words <= 6) | typo | (upper >= 0.35)
        agreement = t.rlike(TRIGGER_AGREEMENT)
    else:
        shaped = F.lit(True)
        agreement = t.rlike(TRIGGER_AGREEMENT) & ~t.rlike(TRIGGER_AGREEMENT_NOT)
    guard = (
        (like | typo)
        & (F.length(t) <= 100)
        & ~t.rlike(r"[.;?!]$")
        & ~t.rlike(r'["\[\]]')
        & (words <= 12)
        & shaped
    )
    named = F.when(t == "", None).when(agreement, "contract_agreement").when(t.rlike(TRIGGER_GENERAL), "general_conditions")
    if rules is not None:
        # only headings that the guards let through reach the rules
        asked = df.withColumn("__t", clean).withColumn("__ask", F.when(guard & (t != ""), t)).withColumn("__rule", rules.key(F.col("__ask")))
        return asked.withColumn(out, named.otherwise(F.col("__rule"))).drop("__t", "__ask", "__rule")
    key = named.when(guard & t.rlike(_any_pattern(ruleset)), _first_pattern(t, ruleset))
    return df.withColumn("__t", clean).withColumn(out, key).drop("__t")


def _any_pattern(ruleset: str) -> str:
    """One alternation of all part patterns: most headings fail it and skip the chain."""
    return "(?i)" + "|".join(p for _, _, patterns in PART_PATTERNS[ruleset] for p in patterns)


def with_zone_hint(df: DataFrame, heading: str, part: str, out: str) -> DataFrame:
    """Add the part key, else a keyword match, else ``contract_body``."""
    low = F.col("__low")
    chain = F.when(F.col(part).isNotNull(), F.col(part))
    for words, zone in ZONE_KEYWORDS:
        chain = chain.when(low.rlike("|".join(words)), zone)
    every = "|".join(w for words, _ in ZONE_KEYWORDS for w in words)
    named = F.col(part).isNotNull() | low.rlike(every)
    return (
        df.withColumn("__low", F.lower(F.coalesce(F.col(heading), F.lit(""))))
        .withColumn(out, F.when(named, chain).otherwise("contract_body"))
        .drop("__low")
    )


def part_rules(ruleset: str) -> list[tuple[int, str, bool, str]]:
    """A rule set as rows (priority, key, is_target, pattern)."""
    return [(i, key, target, "|".join(patterns)) for i, (key, target, patterns) in enumerate(PART_PATTERNS[ruleset])]


def classify_zones(df: DataFrame, heading: str, ruleset: str = "sections", rules: Rules | None = None) -> DataFrame:
    """Add ``zone_key`` and ``is_target`` for a heading column."""
    staged = with_part(df, heading, ruleset, "__part", rules=rules)
    if ruleset == "layout":
        out = staged.withColumnRenamed("__part", "zone_key")
        target = part_is_target(F.col("zone_key"), ruleset) if rules is None else rules.is_target(F.col("zone_key"))
    else:
        out = with_zone_hint(staged, heading, "__part", "zone_key").drop("__part")
        target = analysis_target(F.col("zone_key"))
    return out.withColumn("is_target", F.coalesce(target, F.lit(False)))


def override_zone_hint(sections: DataFrame) -> DataFrame:
    """TOC sections become ``toc``; a heading that names a part takes its key."""
    staged = with_part(sections, "heading", "layout", "__part")
    return staged.withColumn(
        "zone_hint",
        F.when(F.coalesce(F.col("is_toc"), F.lit(False)), "toc").otherwise(F.coalesce("__part", "zone_hint")),
    ).drop("__part")


def zone_confidence(zone: Column, level: Column) -> Column:
    """Confidence of a zone that was made from one section."""
    by_level = F.when(level <= 1, 0.8).otherwise(0.75)
    return (
        F.when(zone.isNull() | (zone == ""), by_level)
        .when(analysis_target(zone), 0.92)
        .when(zone.isin("toc", "cover_page"), 0.85)
        .otherwise(by_level)
    )


def block_zone_confidence(zone: Column, numbered_blocks: Column) -> Column:
    """Confidence of a zone made from layout blocks."""
    return (
        F.when(zone.isin(TARGET_WHITELISTS["confidence"]), F.lit(0.90))
        .when(zone == "contract_body", F.least(F.lit(0.95), F.lit(0.6) + numbered_blocks * F.lit(0.02)))
        .otherwise(F.lit(0.75))
    )


# Fixed value: clause-like line starts counted for the body confidence.
CLAUSE_STARTS = r"(?im)(^|\n)\s*(Article\s+\d+|Section\s+\d+|Clause\s+\d+|\d+\.\d+[\.\d]*|제\s*\d+\s*조)"


def zone_paragraphs(paragraphs: DataFrame, text: str = "text", valid_only: bool = False, starts: Column | None = None) -> DataFrame:
    """Zone type and confidence of plain-text paragraphs.

    With ``starts``, the number of clause-like line starts of a paragraph, its first line will do for ``text``.
    """
    from .numbering import annotate_numbering

    first = strip(F.split(F.col(text), "\n")[0])
    base = annotate_numbering(paragraphs.withColumn("__first", first), "__first", "__hint")
    f = F.col("__first")
    all_upper = (f == F.upper(f)) & (F.length(f) > 3)
    like = (
        all_upper
        | F.coalesce(F.col("__hint.is_heading"), F.lit(False))
        | f.rlike(r"(?i)^(ARTICLE|SECTION|SCHEDULE|EXHIBIT|APPENDIX)\b|^제\s*\d+\s*조")
    )
    starts = F.regexp_count(F.col(text), F.lit(CLAUSE_STARTS)) if starts is None else starts
    base = with_part(base, "__first", "layout", "__part", like, upper_hint=F.when(all_upper, 0.9))
    body = F.lit(0.6) + F.least(starts * F.lit(0.05), F.lit(0.3))
    kind = F.coalesce(F.col("__part"), F.lit("contract_body"))
    if valid_only:
        kind = F.when(kind.isin(PARAGRAPH_ZONES), kind).otherwise("contract_body")
    conf = (
        F.when(F.col("__part").isNull(), F.least(F.lit(1.0), body))
        .when(part_is_target(F.col("__part"), "layout"), 0.88)
        .otherwise(0.82)
    )
    return base.withColumns({"type": kind, "confidence": conf}).drop("__first", "__hint", "__part")
