"""SQL fragments shared by the oracles."""

from __future__ import annotations


def strip(x: str) -> str:
    return f"trim({x}, E' \\t\\n\\r\\f')"


def ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def ex(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"


def rep(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"


def upper_ratio(x: str) -> str:
    n = f"length({rep(x, '[^a-zA-Z]')})"
    return f"(case when {n} > 0 then length({rep(x, '[^A-Z]')})::double / {n} else 0 end)"


def roman(x: str) -> str:
    """Roman value by walking the letters, largest first rule per position."""
    s = f"upper({strip(x)})"
    val = "case c when 'I' then 1 when 'V' then 5 when 'X' then 10 when 'L' then 50 when 'C' then 100 when 'D' then 500 when 'M' then 1000 end"
    vals = f"list_transform(string_split({s}, ''), lambda c: {val})"
    body = (
        f"list_sum(list_transform(range(1, length({s}) + 1), lambda k: case when k < length({s}) "
        f"and ({vals})[k] < ({vals})[k + 1] then -({vals})[k] else ({vals})[k] end))"
    )
    ok = rx(s, "^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$")
    return f"(case when {s} <> '' and {ok} then cast({body} as int) end)"


# Clause number patterns.
SCHED = r"(?i)^\s*(SCHEDULE|EXHIBIT|APPENDIX)\s+([A-Z0-9]*)\b[.\-:\s]*(.*)"
ART = r"(?i)^\s*ARTICLE\s+([IVXLCDM]+|\d+)\b[.\-:\s]*(.*)"
SECT = r"(?i)^\s*SECTION\s+(\d+(?:\.\d+)*)\b[.\-:]?\s*(.*)"
ROM = r"^\s*\(([ivxIVX]{1,8})\)\s+(.*)"
ALP = r"^\s*\(([a-zA-Z])\)\s+(.*)"
DEC = r"^\s*(\d+(?:\.\d+){0,6})\s*[.)]?\s+(.*)"
KO = r"^\s*제\s*(\d+)\s*조"


def kind_case(t: str) -> str:
    return (
        f"case when {t} = '' then null when {rx(t, KO)} then 'ko' when {rx(t, SCHED)} then 'sched' when {rx(t, ART)} then 'art' "
        f"when {rx(t, SECT)} then 'sect' when {rx(t, ROM)} then 'rom' when {rx(t, ALP)} then 'alp' when {rx(t, DEC)} then 'dec' end"
    )


def rest_case(t: str, k: str) -> str:
    return strip(
        f"case {k} when 'sched' then {ex(t, SCHED, 3)} when 'art' then {ex(t, ART, 2)} when 'sect' then {ex(t, SECT, 2)} "
        f"when 'rom' then {ex(t, ROM, 2)} when 'alp' then {ex(t, ALP, 2)} when 'dec' then {ex(t, DEC, 2)} else {t} end"
    )


def hint(src: str, col: str) -> str:
    """SELECT that adds hk, raw, rest, num, promoted, h_kind, h_norm, h_level, h_head to ``src``."""
    t = strip(f"coalesce({col}, '')")
    nums = "array_to_string(list_transform(string_split(raw, '.'), lambda s: case when ltrim(s, '0') = '' then '0' else ltrim(s, '0') end), '.')"
    return f"""select *,
      case when hk in ('ko', 'art') or promoted then 'article' when hk = 'dec' then 'decimal' when hk = 'sched' then 'schedule'
        when hk = 'sect' then 'section' when hk = 'rom' then 'roman_paren' when hk = 'alp' then 'alpha_paren' end as h_kind,
      case when hk = 'ko' or promoted then 'ARTICLE ' || num when hk = 'sched' then upper({ex('ht', SCHED, 1)}) || ' ' || raw
        when hk = 'art' then 'ARTICLE ' || case when {rx('raw', '^[0-9]+$')} then num else coalesce(cast({roman('raw')} as varchar), upper(raw)) end
        when hk = 'sect' then 'SECTION ' || num when hk in ('rom', 'alp') then '(' || lower(raw) || ')' else num end as h_norm,
      case when hk is null then null when hk = 'sched' then 0 when hk in ('ko', 'art') or promoted then 1
        when hk = 'sect' then 1 + len(string_split(num, '.')) when hk = 'rom' then 6 when hk = 'alp' then 5
        else 2 + len(string_split(num, '.')) end as h_level,
      case when hk is null then null when hk = 'dec' then short else hk not in ('rom', 'alp') end as h_head
    from (select *, {nums} as num, length(rest) <= 80 and length(raw) <= 8 as short,
        coalesce(hk = 'dec' and length(rest) <= 80 and length(raw) <= 8 and {rx('raw', '^[0-9]{1,8}$')}
          and try_cast(raw as int) between 1 and 300, false) as promoted
      from (select *, {rest_case('ht', 'hk')} as rest,
          case hk when 'ko' then {ex('ht', KO, 1)} when 'sched' then case when {ex('ht', SCHED, 2)} = '' then '1' else {ex('ht', SCHED, 2)} end
            when 'art' then {ex('ht', ART, 1)} when 'sect' then {ex('ht', SECT, 1)} when 'rom' then {ex('ht', ROM, 1)}
            when 'alp' then {ex('ht', ALP, 1)} when 'dec' then {ex('ht', DEC, 1)} end as raw
        from (select *, {kind_case('ht')} as hk from (select *, {t} as ht from {src}) a) b) c) d"""


# Fixed value: zones that are not analysed.
NON_TARGET = "('toc', 'cover_page', 'preamble', 'drawing_list', 'form_of_tender', 'bill_of_quantities', 'appendices', 'technical_specifications')"


def part_case(t: str, ruleset: str) -> str:
    from paperloom.functions.zoning import PART_PATTERNS

    whens = " ".join(f"when {rx(t, '(?i)' + p)} then '{key}'" for key, _, ps in PART_PATTERNS[ruleset] for p in ps)
    return f"case {whens} end"


def detect_part(heading: str, ruleset: str, like: str = "true") -> str:
    """Expression for the part a heading names (no typography)."""
    if ruleset == "layout":
        t = ws(f"coalesce({heading}, '')")
        words = f"len(string_split({t}, ' '))"
        extra = f"and not ({upper_ratio(t)} < 0.35 and {words} > 6)"
        trigger = rx(t, r"(?i)^\s*this\s+contract\s+agreement\b")
    else:
        t = strip(f"replace(coalesce({heading}, ''), chr(10), ' ')")
        words = f"len(regexp_split_to_array({t}, '\\s+'))"
        extra = ""
        trigger = (
            rx(t, r"(?i)^\s*this\s+contract\s+agreement\b")
            + " and not "
            + rx(t, r"(?i)^\s*this\s+contract\s+agreement\s+(?:together|and\s|dated|made|entered|shall|may|or\s|is\s)")
        )
    return f"""(case when {t} = '' then null when {trigger} then 'contract_agreement'
      when {rx(t, r'(?i)^\s*general\s+provisions\s*$')} then 'general_conditions'
      when {like} and length({t}) <= 100 and not {rx(t, '[.;?!]$')} and not {rx(t, '["\\[\\]]')} and {words} <= 12 {extra}
      then {part_case(t, ruleset)} end)"""


def zone_hint(heading: str, part: str) -> str:
    from paperloom.functions.zoning import ZONE_KEYWORDS

    whens = " ".join(
        "when " + " or ".join(f"contains(lower({heading}), '{w}')" for w in words) + f" then '{zone}'"
        for words, zone in ZONE_KEYWORDS
    )
    return f"coalesce({part}, case {whens} else 'contract_body' end)"


# Numbers that a heading may start with.
HEADING_FORMS = [
    r"^\s*(\d+(?:\.\d+)*)\s",
    r"^\s*(\d+(?:\.\d+)*)[.)]\s",
    r"^\s*(\d+(?:\.\d+)*)[.)]\s*$",
    r"(?i)^\s*(?:ARTICLE|CLAUSE|SECTION|CHAPTER|PART)\s+(\d+(?:\.\d+)*)\b",
]


def heading_number(x: str) -> str:
    return "(case " + " ".join(f"when {rx(x, f)} then {ex(x, f, 1)}" for f in HEADING_FORMS) + " end)"


# Lines that continue a reference.
REF_ONLY = r"^\s*\d+(?:\.\d+)+\s+\[.*?\]\.?\s*$"
REF_PUNCT = r"^\s*\d+(?:\.\d+)+\s+\[.*?\]\s*[,;:.]"
REF_CONT = r"(?i)^\s*\d+(?:\.\d+)+\s+\[.*?\]\s*,?\s+(?:the|a|an|this|that|may|shall|and|or|to|in|of|for|with|by)\s"
REF_TRAIL = r"^\s*\d+(?:\.\d+)+\s+\[.*?\]\s*,?\s*(.*)"
REF_KEY = r"(?i)(?:Sub-?\s*Clause|Clause|Article|Section|Part|Chapter)\s*$"
NUMBERED = r"^[ \t]*(\d+(?:\.\d+){1,})[ \t]+\S"


def cross_ref(line: str, prev: str) -> str:
    t = strip(line)
    return (
        f"({rx(t, REF_ONLY)} or {rx(t, REF_PUNCT)} or {rx(t, REF_CONT)} or length({strip(ex(t, REF_TRAIL, 1))}) > 30 "
        f"or coalesce({rx(strip(prev), REF_KEY)}, false))"
    )


def remainder_kind(x: str) -> str:
    r = strip(f"coalesce({x}, '')")
    commas = f"(length({r}) - length(replace({r}, ',', '')))"
    return (
        f"(case when {r} = '' then 'title' when {rx(r, r'(?i)\bmeans\b|\bhas\s+the\s+meaning\b|\bshall\s+mean\b')} then 'body' "
        f"when {rx(r, chr(94) + '[' + chr(34) + chr(39) + '“”]')} then 'body' "
        f"when starts_with({r}, '[') and not ({rx(r, r'^\[[A-Z]')} and {commas} < 2) and length({r}) > 20 then 'body' "
        f"when length({r}) > 80 then 'body' when {rx(r, r'[.;!?]\s+\S')} then 'body' else 'title' end)"
    )
