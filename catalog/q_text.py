"""Row-local text queries: numbering, zones, headings, lines, vectors, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import calendar as cal
from paperloom.functions import headings as hd
from paperloom.functions import lines as ln
from paperloom.functions import numbering as nb
from paperloom.functions import text as tx
from paperloom.functions import zoning as zn
from paperloom.functions.rules import register_rules
from paperloom.functions.toc import parse_toc_line
from paperloom.functions.vectors import cosine

from .registry import query
from .sqltext import (
    NON_TARGET, cross_ref, detect_part, ex, heading_number, hint, remainder_kind, rep, rest_case, kind_case, roman, rx, strip,
    upper_ratio, ws, zone_hint,
)

query(
    "sc1_normalize_ws",
    lambda t: t.base("documents").select("doc_id", F.md5(tx.normalize_ws(F.col("text"))).alias("h")),
    f"select doc_id, md5({ws('text')}) as h from documents",
)
query(
    "sc2_content_hash",
    lambda t: t.base("documents").select("doc_id", tx.content_hash(F.col("text")).alias("h")),
    f"select doc_id, sha256({ws('text')}) as h from documents",
)
query(
    "sc3_safe_join",
    lambda t: t.numbered_sections.select("doc_id", F.md5(tx.safe_join(F.split("content", "\n"))).alias("h")),
    f"""select doc_id, md5({ws("replace(" + rep("array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: " + ws('x') + "), lambda x: x <> ''), '@#')", "([A-Za-z])-@#([a-z_])", chr(92) + "1" + chr(92) + "2") + ", '@#', ' ')")}) as h from numbered_sections""",
)
query(
    "sc4_upper_ratio",
    lambda t: t.num_lines.select("doc_id", "pos", F.round(tx.upper_ratio(F.col("text")), 4).alias("ratio")),
    f"select doc_id, pos, round({upper_ratio('text')}, 4) as ratio from num_lines",
)
query(
    "sc5_normalize_pattern",
    lambda t: t.num_lines.select(
        "doc_id", "pos", tx.normalize_pattern(F.col("text"), "layout").alias("a"), tx.normalize_pattern(F.col("text"), "sections").alias("b")
    ),
    f"select doc_id, pos, lower({rep(ws('text'), '[0-9]+', '0')}) as a, {rep('lower(' + strip('text') + ')', '[0-9]+', '#')} as b from num_lines",
)

# headings of the sections and every line of the numbered sections
SQL_LABELS = """select doc_id, -1 as pos, heading as text from sections union all select doc_id, pos, text from num_lines"""


def _labels(t):
    return t.sections.select("doc_id", F.lit(-1).alias("pos"), F.col("heading").alias("text")).unionByName(
        t.num_lines.select("doc_id", "pos", "text")
    )


query(
    "sc6_annotate_numbering",
    lambda t: nb.annotate_numbering(_labels(t), "text")
    .where("hint is not null")
    .select("doc_id", "pos", "hint.raw", "hint.kind", "hint.normalized", "hint.level", "hint.is_heading", F.array_join("hint.components", "/").alias("components")),
    f"""select doc_id, pos, raw, h_kind as kind, h_norm as normalized, h_level as level, h_head as is_heading,
          case hk when 'sched' then raw when 'art' then substr(h_norm, 9) when 'rom' then coalesce(cast({roman('raw')} as varchar), lower(raw))
            when 'alp' then lower(raw) else replace(num, '.', '/') end as components
        from hinted where hk is not null""",
    labels=SQL_LABELS,
    hinted=hint("labels", "text"),
)
query(
    "sc7_roman_to_int",
    lambda t: t.base("documents").select(
        "doc_id", F.coalesce(nb.roman_to_int(F.translate(F.col("doc_id").cast("string"), "0123456789", "IVXLCDMixv")), F.lit(-1)).alias("value")
    ),
    f"select doc_id, coalesce({roman('r')}, -1) as value from (select doc_id, translate(cast(doc_id as varchar), '0123456789', 'IVXLCDMixv') as r from documents) x",
)
query(
    "sc8_strip_numbering",
    lambda t: _labels(t).select("doc_id", "pos", nb.strip_numbering(F.col("text")).alias("remainder")),
    f"""select doc_id, pos, {rest_case('ht', 'hk')} as remainder from (select *, {kind_case('ht')} as hk from
        (select *, {strip('text')} as ht from labels) a) b""",
    labels=SQL_LABELS,
)
query(
    "sc9_classify_zones_sections",
    lambda t: zn.classify_zones(_labels(t), "text", "sections").select("doc_id", "pos", "zone_key", "is_target"),
    f"""select doc_id, pos, z as zone_key, z not in {NON_TARGET} as is_target from
        (select doc_id, pos, {zone_hint('text', detect_part('text', 'sections'))} as z from labels) x""",
    labels=SQL_LABELS,
)


def pattern_table(t, ruleset):
    """The rule set as a table among rules that match nothing here: 1,000 rules, priorities kept."""
    rows = [(10 * p, key, target, pattern) for p, key, target, pattern in zn.part_rules(ruleset)]
    rows += [(i % 160, f"other_{i}", i % 2 == 0, rf"^\s*unheard-of\s+rule\s+{i}\b|^\s*rule\s+{i}\s+unheard\s+of\b") for i in range(1000 - len(rows))]
    return t.spark.createDataFrame(rows, "priority int, key string, is_target boolean, pattern string")


query(
    "register_rules_sections",
    lambda t: zn.classify_zones(_labels(t), "text", "sections", register_rules(pattern_table(t, "sections"))).select("doc_id", "pos", "zone_key", "is_target"),
    f"""select doc_id, pos, z as zone_key, z not in {NON_TARGET} as is_target from
        (select doc_id, pos, {zone_hint('text', detect_part('text', 'sections'))} as z from labels) x""",
    labels=SQL_LABELS,
)
query(
    "register_rules_layout",
    lambda t: zn.classify_zones(_labels(t), "text", "layout", register_rules(pattern_table(t, "layout"))).where("zone_key is not null").select("doc_id", "pos", "zone_key", "is_target"),
    f"""select doc_id, pos, z as zone_key, z in ('contract_agreement', 'general_conditions', 'particular_conditions', 'conditions_of_contract',
          'commercial_terms', 'definitions', 'letter_of_acceptance') as is_target from
        (select doc_id, pos, {detect_part('text', 'layout')} as z from labels) x where z is not null""",
    labels=SQL_LABELS,
)
query(
    "sc9_classify_zones_layout",
    lambda t: zn.classify_zones(_labels(t), "text", "layout").where("zone_key is not null").select("doc_id", "pos", "zone_key", "is_target"),
    f"""select doc_id, pos, z as zone_key, z in ('contract_agreement', 'general_conditions', 'particular_conditions', 'conditions_of_contract',
          'commercial_terms', 'definitions', 'letter_of_acceptance') as is_target from
        (select doc_id, pos, {detect_part('text', 'layout')} as z from labels) x where z is not null""",
    labels=SQL_LABELS,
)


def _paragraphs(t):
    """Section texts as paragraphs whose first line is the heading."""
    return t.numbered_sections.unionByName(t.sections.select(*t.numbered_sections.columns)).select(
        "doc_id", "heading", F.concat("heading", F.lit("\n"), "content").alias("text")
    )


SQL_PARAGRAPHS = """select doc_id, heading, heading || chr(10) || content as text from
   (select doc_id, heading, content from numbered_sections union all select doc_id, heading, content from sections) q"""
_UP = "(ht = upper(ht) and length(ht) > 3)"
_LIKE = f"({_UP} or coalesce(h_head, false) or {rx('ht', '(?i)^(ARTICLE|SECTION|SCHEDULE|EXHIBIT|APPENDIX)' + chr(92) + 'b')} or {rx('ht', '^제[ ]*[0-9]+[ ]*조')})"


def _sql_paragraph_part():
    t = ws("ht")
    words = f"len(string_split({t}, ' '))"
    base = detect_part("ht", "layout", _LIKE)
    # the upper-case hint of 0.9 switches the upper-ratio guard off
    return base.replace(f"and not ({upper_ratio(t)} < 0.35 and {words} > 6)", f"and (not ({upper_ratio(t)} < 0.35 and {words} > 6) or {_UP})")


query(
    "sc10_zone_paragraphs",
    lambda t: zn.zone_paragraphs(_paragraphs(t)).select("doc_id", "heading", "type", F.round("confidence", 4).alias("confidence")),
    f"""select doc_id, heading, coalesce(part, 'contract_body') as type, round(case when part is null then
          least(1.0, 0.6 + least(len(regexp_extract_all(text, '(?im)(^|\\n)\\s*(Article\\s+[0-9]+|Section\\s+[0-9]+|Clause\\s+[0-9]+|[0-9]+\\.[0-9]+[\\.0-9]*|제\\s*[0-9]+\\s*조)')) * 0.05, 0.3))
          when part in ('contract_agreement', 'general_conditions', 'particular_conditions', 'conditions_of_contract', 'commercial_terms', 'definitions', 'letter_of_acceptance')
          then 0.88 else 0.82 end, 4)::double as confidence
        from (select *, {_sql_paragraph_part()} as part from hinted) x""",
    paras="select *, " + strip("split_part(text, chr(10), 1)") + f" as first_line from ({SQL_PARAGRAPHS}) p",
    hinted=hint("paras", "first_line"),
)
query(
    "sc10_zone_paragraphs_valid",
    lambda t: zn.zone_paragraphs(_paragraphs(t), valid_only=True).groupBy("type").agg(F.count("*").alias("n")),
    f"""select case when part in ('contract_body', 'general_conditions', 'particular_conditions', 'technical_specification', 'drawing_list', 'schedule',
          'cover_page', 'definitions', 'commercial_terms', 'appendices', 'toc', 'other') then part else 'contract_body' end as type, count(*) as n
        from (select *, {_sql_paragraph_part()} as part from hinted) x group by 1""",
    paras="select *, " + strip("split_part(text, chr(10), 1)") + f" as first_line from ({SQL_PARAGRAPHS}) p",
    hinted=hint("paras", "first_line"),
)
query(
    "sc11_zone_confidence",
    lambda t: t.sections.select(
        "doc_id",
        zn.zone_confidence(F.col("zone_hint"), F.col("level")).alias("a"),
        F.round(zn.block_zone_confidence(F.coalesce("zone_hint", F.lit("contract_body")), F.col("section_index")), 4).alias("b"),
    ),
    f"""select doc_id, cast(case when zone_hint is null then case when level <= 1 then 0.8 else 0.75 end when zone_hint not in {NON_TARGET} then 0.92
          when zone_hint in ('toc', 'cover_page') then 0.85 when level <= 1 then 0.8 else 0.75 end as double) as a,
          round(cast(case when coalesce(zone_hint, 'contract_body') in ('contract_agreement', 'general_conditions', 'particular_conditions', 'conditions_of_contract',
            'commercial_terms', 'definitions') then 0.9 when coalesce(zone_hint, 'contract_body') = 'contract_body' then least(0.95, 0.6 + section_index * 0.02)
            else 0.75 end as double), 4) as b from sections""",
)
query(
    "sc12_override_zone_hint",
    lambda t: zn.override_zone_hint(t.sections).select("doc_id", F.coalesce("zone_hint", F.lit("")).alias("zone_hint")),
    f"select doc_id, coalesce(case when is_toc then 'toc' else coalesce({detect_part('heading', 'layout')}, zone_hint) end, '') as zone_hint from sections",
)
query(
    "sc13_heading_remainder_kind",
    lambda t: _labels(t).select("doc_id", "pos", hd.heading_remainder_kind(nb.strip_numbering(F.col("text"))).alias("kind")),
    f"""select doc_id, pos, {remainder_kind('r')} as kind from (select doc_id, pos, {rest_case('ht', 'hk')} as r from
        (select *, {kind_case('ht')} as hk from (select *, {strip('text')} as ht from labels) a) b) c""",
    labels=SQL_LABELS,
)
query(
    "sc15_is_cross_reference",
    lambda t: t.numbered_sections.select(
        "doc_id",
        F.posexplode(
            F.zip_with(F.split("content", "\n"), ln.shifted(F.split("content", "\n")), lambda x, p: ln.is_cross_reference(x, p))
        ).alias("pos", "is_ref"),
    ),
    f"select doc_id, pos, {cross_ref('text', 'pv')} as is_ref from (select doc_id, pos, text, lag(text) over (partition by doc_id order by pos) as pv from num_lines) x",
)


def heading_line_sql(size: str = "1.0", bold: str = "0.0") -> str:
    t = "t"
    words = "regexp_split_to_array(t, '\\s+')"
    dotted, deep = rx(t, r"^\s*\d+(?:\.\d+)+\s"), rx(t, r"^\s*\d+(?:\.\d+){2,}\s")
    key_ok = (
        f"length(t) <= 60 and not ends_with(t, ':') and not {rx(t, r'\d\s*\(')} and not {rx(t, hd.KEYWORD_PREPOSITION)} and not {rx(t, hd.KEYWORD_BRACKET)}"
    )
    stops = "('THE', 'A', 'AN', 'IN', 'OF', 'FOR', 'WITH', 'BY', 'TO', 'AND', 'OR', 'AT')"
    return f"""case when t = '' then false
      when not {dotted} and {rx(t, hd.COUNTED_UNIT)} then false
      when not {dotted} and (length(t) > 120 or length(t) - length(replace(t, ',', '')) >= 2) then false
      when {deep} then true when {rx(t, '[.;!?]$')} then false
      when {rx(t, hd.REF_PUNCT)} then false when {rx(t, hd.REF_CONTINUES)} then false
      when length({strip(ex(t, hd.REF_TRAILING, 1))}) > 30 then false
      when starts_with(t, '[') or {rx(t, chr(94) + chr(92) + 'p{Ll}')} or substr(t, 1, 1) in ('"', '“', '''') then false
      when {rx(t, hd.KEYWORD_PUNCT)} or {rx(t, hd.KEYWORD_ONLY)} then false
      when {rx(t, hd.DOTTED)} then true
      when {rx(t, hd.KEYWORD)} and {key_ok} then true
      when not {rx(t, hd.KEYWORD)} and ({rx(t, hd.KO_UNIT)} or {rx(t, hd.ROMAN_TITLE)} or {rx(t, hd.LETTER_TITLE)}
        or ({rx(t, hd.BARE_NUMBER)} and length(t) <= 80 and len({words}) <= 10)) then true
      when ends_with(t, ']') and not {rx(t, chr(94) + '[0-9]')} then false when ends_with(t, ')') then false
      when {rx(t, hd.ALL_CAPS)} and len({words}) between 2 and 8 and ({rx(t, hd.ALL_CAPS_KEYWORD)}
        or (len(list_filter({words}, lambda w: w not in {stops})) >= 2 and ({size} >= 1.05 or {bold} > 0))) then true
      when {size} > 1.15 and length(t) <= 100 and not {rx(t, hd.SENTENCE_LIKE)} then true
      when {bold} >= 0.5 and length(t) <= 60 and not {rx(t, hd.SENTENCE_LIKE)} and not (contains(t, '–') or contains(t, '—') or contains(t, ' - ')) then true
      else false end"""


query(
    "sc16_is_heading_line",
    lambda t: hd.is_heading_line(_labels(t)).select("doc_id", "pos", "is_heading"),
    f"select doc_id, pos, {heading_line_sql()} as is_heading from (select doc_id, pos, {strip('text')} as t from labels) x",
    labels=SQL_LABELS,
)
query(
    "sc16_is_heading_line_fonts",
    lambda t: hd.is_heading_line(
        t.page_lines.withColumns({"size": F.col("font_size") / 10.0, "bold": F.col("is_bold").cast("double")}), "text", "size", "bold"
    ).select("contract_id", "page", "ord", "is_heading"),
    f"""select contract_id, page, ord, {heading_line_sql('sz', 'bd')} as is_heading from
        (select contract_id, page, ord, {strip('text')} as t, font_size / 10.0 as sz, case when is_bold then 1.0 else 0.0 end as bd from page_lines) x""",
)
query(
    "sc17_is_text_heading",
    lambda t: _labels(t).select("doc_id", "pos", hd.text_heading(F.col("text")).alias("is_heading")),
    f"""select doc_id, pos, ht <> '' and (coalesce(h_head, false) or {rx('ht', '(?i)^(Article|Section|Clause|Part)' + chr(92) + 's+[0-9]+')}
          or {rx('ht', '(?i)^Part' + chr(92) + 's+[IVX]+')} or {rx('ht', '^제[ ]*[0-9]+[ ]*조')} or {rx('ht', '^[가-힣][.]' + chr(92) + 's')}) as is_heading from hinted""",
    labels=SQL_LABELS,
    hinted=hint("labels", "text"),
)


def _heading_pairs(t):
    h = t.sections.select("doc_id", "contract_id", "section_index", "heading")
    nxt = h.select("contract_id", (F.col("section_index") - 1).alias("section_index"), F.col("heading").alias("next_heading"))
    return h.join(nxt, ["contract_id", "section_index"])


query(
    "sc18_heading_relations",
    lambda t: _heading_pairs(t).select(
        "doc_id",
        F.coalesce(nb.heading_number(F.col("heading")), F.lit("")).alias("number"),
        nb.is_child(F.col("heading"), F.col("next_heading")).alias("child_next"),
    ),
    f"""select doc_id, coalesce(a, '') as number, coalesce(starts_with(b, a || '.'), false) as child_next from (
          select s.doc_id, {heading_number('s.heading')} as a, {heading_number('n.heading')} as b
          from sections s join sections n on n.contract_id = s.contract_id and n.section_index = s.section_index + 1) x""",
)
query(
    "sc18_is_sibling_or_child",
    lambda t: t.num_lines.withColumns(
        {"own": F.expr("cast(section_index + 1 as string) || case when pos % 2 = 0 then '.1' else '' end || case when pos % 4 = 0 then '.2' else '' end"),
         "cand": F.regexp_extract("text", ln.NUMBERED_LINE, 1)}
    ).where("cand != ''").select("doc_id", "pos", nb.is_sibling_or_child(F.col("own"), F.col("cand")).alias("related")),
    f"""select doc_id, pos, starts_with(cand, own || '.') or (len(o) = len(c) and len(o) >= 2 and o[1:len(o) - 1] = c[1:len(c) - 1])
          or (len(o) = 1 and len(c) >= 2 and o[1] = c[1]) or (len(o) >= 3 and len(c) >= 3 and o[1:2] = c[1:2]) as related
        from (select *, string_split(own, '.') as o, string_split(cand, '.') as c from (select doc_id, pos,
          cast(section_index + 1 as varchar) || case when pos % 2 = 0 then '.1' else '' end || case when pos % 4 = 0 then '.2' else '' end as own,
          {ex('text', ln.NUMBERED_LINE, 1)} as cand from num_lines) a where cand <> '') b""",
)


def _tabled(t):
    """Numbered sections with leftover tables of all three shapes mixed in."""
    n = t.numbered_sections
    return n.withColumn(
        "content",
        F.concat(
            F.lit("| head one |  two |\n| --- | :-: |\n\n"), F.replace("content", F.lit("| b |\n"), F.lit("|\n| --- |\n")),
            F.lit("\n| short |\n\n\n\n| "), F.col("heading"), F.lit(" and some more words | x |\n|---|"),
        ),
    )


SQL_TABLED = """select doc_id, '| head one |  two |' || chr(10) || '| --- | :-: |' || chr(10) || chr(10) || replace(content, '| b |' || chr(10), '|' || chr(10) || '| --- |' || chr(10))
   || chr(10) || '| short |' || chr(10) || chr(10) || chr(10) || chr(10) || '| ' || heading || ' and some more words | x |' || chr(10) || '|---|' as content from numbered_sections"""
_A = f"regexp_replace(content, '{ln.HEADER_AND_RULE}', chr(2) || '\\1' || chr(2), 'g')"
_B = f"""array_to_string(list_transform(range(1, len(p1) + 1), lambda k: case when k % 2 = 0
     then array_to_string(list_filter(list_transform(string_split(p1[k], '|'), lambda v: {strip('v')}), lambda v: v <> ''), ' ') else p1[k] end), '')"""
_INNER = ex("p2[k]", r"(?s)^\|([^|]+(?:\|[^|]+)?)\|", 1)
_D = f"""array_to_string(list_transform(range(1, len(p2) + 1), lambda k: case when k % 2 = 0 and length({strip(_INNER)}) >= 20
     then array_to_string(list_transform(string_split({_INNER}, '|'), lambda v: {strip('v')}), ' ') else p2[k] end), '')"""
query(
    "sc19_clean_ghost_tables",
    lambda t: _tabled(t).select("doc_id", F.md5(ln.clean_ghost_tables(F.col("content"))).alias("h")),
    f"""select doc_id, md5(regexp_replace({_D}, '\\n{{3,}}', chr(10) || chr(10), 'g')) as h from (
          select doc_id, string_split(regexp_replace(regexp_replace({_B}, '{ln.RULE_ONLY}', '', 'g'), '{ln.LONE_ROW}', chr(2) || '\\0' || chr(2), 'g'), chr(2)) as p2
          from (select doc_id, string_split({_A}, chr(2)) as p1 from tabled) x) y""",
    tabled=SQL_TABLED,
)
query(
    "sc21_clause_depth",
    lambda t: t.clauses.select("clause_id", nb.clause_depth(F.col("number")).alias("depth")),
    """select clause_id, case when number is null then 0 when number in ('(ii)', '(v)', '(xiv)') then 3
         when length(number) = 3 and starts_with(number, '(') then 2 when regexp_full_match(number, '[0-9.]+') and contains(number, '.')
         then least(len(string_split(number, '.')) - 1, 4) when number = 'SECTION 3.1' then 1 else 0 end as depth from clauses""",
)
query(
    "sc22_list_marker",
    lambda t: _labels(t).withColumn("m", tx.list_marker(F.col("text"))).where("m is not null").select("doc_id", "pos", "m.level", "m.marker", "m.body"),
    f"""select doc_id, pos, level, rtrim(lead) as marker, substr(t, length(lead) + 1) as body from (select *, case
          when {rx('t', '(?i)^' + chr(92) + '((i{1,3}|iv|vi{0,3}|ix|xi{0,3}|xiv|xv|x{1,3})' + chr(92) + ')' + chr(92) + 's+')} then 'roman'
          when {rx('t', '(?i)^' + chr(92) + '(([a-z]|[0-9]+)' + chr(92) + ')' + chr(92) + 's+')} then 'alpha' end as level,
          {ex('t', '^' + chr(92) + '([^)]*' + chr(92) + ')' + chr(92) + 's+', 0)} as lead from (select doc_id, pos, {strip('text')} as t from labels) a) b where level is not null""",
    labels=SQL_LABELS,
)
query(
    "sc22_split_recommendations",
    lambda t: t.analyses.select("clause_id", F.posexplode(tx.split_recommendations(F.col("recommendations"))).alias("pos", "item")),
    f"""select clause_id, u.pos - 1 as pos, ls[u.pos] as item from (select clause_id, list_filter(list_transform(regexp_split_to_array(recommendations, '[\\n;；]'),
          lambda x: {strip(rep('x', '^[-•*]' + chr(92) + 's*'))}), lambda x: x <> '') as ls from analyses) q, unnest(range(1, len(ls) + 1)) as u(pos)""",
)


def _toc_lines(t):
    toc = t.sections.where("section_index = 1")
    return toc.select("contract_id", F.posexplode(F.split("content", "\n")).alias("line_no", "text")).unionByName(
        t.num_lines.select("contract_id", (F.col("section_index") * 100_000 + F.col("pos") + 100_000).alias("line_no"), "text")
    )


SQL_TOC_LINES = """select contract_id, u.pos - 1 as line_no, ls[u.pos] as text from (select contract_id, string_split(content, chr(10)) as ls from sections where section_index = 1) q,
   unnest(range(1, len(ls) + 1)) as u(pos) union all select contract_id, section_index * 100000 + pos + 100000, text from num_lines"""


def _page_ok(digits: str) -> str:
    v = f"try_cast({digits} as bigint)"
    return f"case when length(ltrim({digits}, '0')) between 1 and 9 and {v} between 1 and 38 and not {v} between 1900 and 2100 then {v} end"


def toc_line_sql() -> str:
    """SELECT of parsed TOC lines from ``tl`` (columns title, page_number, level, numbering)."""
    leader = r"\.{3,}|-\s*-\s*-"
    forms = [r"\.{3,}\s*(\d+)\s*$", r"-{3,}\s*(\d+)\s*$", r"\t(\d+)\s*$", r"\s{3,}(\d+)\s*$", r"(\d+)\s*[-–]\s*\d+\s*$", r"\s+(\d{1,4})\s*$"]
    first = r"^(.*?)[.\-\s]*(\d+)\s*$"
    cands = [(strip(ex("cl", first, 1)), _page_ok(ex("cl", first, 2)))] + [
        (strip(rep(strip(ex("li", f"^(.*?){f}", 1)), leader)), _page_ok(ex("li", f"^(.*?){f}", 2))) for f in forms
    ]
    title = "case " + " ".join(f"when {a} <> '' and {b} is not null then {a}" for a, b in cands) + " else cl end"
    page = "case " + " ".join(f"when {a} <> '' and {b} is not null then {b}" for a, b in cands) + " end"
    prefix = r"(?i)^(\d+(?:\.\d+)*\s+|ARTICLE\s+[IVX]+\s*)"
    return f"""select contract_id, line_no, case when numbering is not null and rest <> '' then rest else tt end as title, page_number,
        case when {rx('coalesce(numbering, li)', r'^\d+\.\d+\.\d+')} then 3 when {rx('coalesce(numbering, li)', r'^\d+\.\d+')} then 2 else 1 end as level, numbering
      from (select *, case when {rx('tt', prefix)} then {strip(ex('tt', prefix, 1))} end as numbering, {strip(f"regexp_replace(tt, '{prefix}', '')")} as rest
        from (select *, {title} as tt, {page} as page_number from
          (select *, {strip(rep('li', leader, ' '))} as cl from (select contract_id, line_no, {strip('text')} as li from tl) a) b) c) d where tt <> ''"""


query(
    "sc23_parse_toc_line",
    lambda t: parse_toc_line(_toc_lines(t), "text", F.lit(38)).where("toc is not null").select(
        "contract_id", "line_no", "toc.title", F.coalesce("toc.page_number", F.lit(-1)).alias("page_number"), "toc.level", F.coalesce("toc.numbering", F.lit("")).alias("numbering")
    ),
    f"select contract_id, line_no, title, coalesce(page_number, -1) as page_number, level, coalesce(numbering, '') as numbering from ({toc_line_sql()}) x",
    tl=SQL_TOC_LINES,
)
query(
    "sc24_cosine",
    lambda t: t.vectors.withColumn("other", F.reverse("embedding")).withColumn(
        "other", F.expr("case when vec_id % 7 = 0 then slice(other, 1, 10) when vec_id % 11 = 0 then transform(other, x -> cast(0 as float)) else other end")
    ).select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 4).alias("score")),
    """select vec_id, round(case when vec_id % 7 = 0 or vec_id % 11 = 0 then 0.0 else
         list_dot_product(embedding::double[], list_reverse(embedding)::double[]) / list_dot_product(embedding::double[], embedding::double[]) end, 4) as score from embeddings""",
)
query(
    "sc25_clip_text",
    lambda t: t.base("documents").select(
        "doc_id", *[F.length(tx.clip_text(F.col("text"), p)).alias(p) for p in tx.CLIP_LIMITS], F.md5(tx.clip_text(F.col("text"), "recheck")).alias("h")
    ),
    """select doc_id, least(length(text), 8000) as embed, least(length(text), 12000) as prompt, least(length(text), 4000) as recheck,
         least(length(text), 2000) as summary, least(length(text), 300) as small_model, md5(substr(text, 1, 4000)) as h from documents""",
)
query(
    "sc29_next_reset",
    lambda t: t.calls.select(
        "event_id", F.date_format(cal.next_reset(F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("reset"), cal.reset_label(F.col("ts").cast("timestamp")).alias("label"),
        cal.display_date(F.col("ts").cast("timestamp")).alias("shown"),
    ),
    """select event_id, strftime(date_trunc('day', ts - interval 8 hour) + interval 32 hour, '%Y-%m-%d %H:%M:%S') as reset,
         strftime(date_trunc('day', ts - interval 8 hour) + interval 41 hour, '%Y-%m-%d') || ' 17:00 KST' as label,
         strftime(ts + interval 9 hour, '%Y. %m. %d.') as shown from calls""",
)
query(
    "sc30_expected_duration_ms",
    lambda t: t.files.select("page_id", cal.expected_duration_ms(F.expr("case when page_id % 6 = 0 then null else length * 100 end")).alias("ms")),
    """select page_id, case when page_id % 6 = 0 or length = 0 then 180000
         else cast(round(greatest(30000.0, least(600000.0, 30000.0 + (length * 100) / 1048576.0 * 12000.0))) as bigint) end as ms from files""",
)
query(
    "sc31_usage_pct",
    lambda t: t.base("events").select("event_id", F.round(cal.usage_pct(F.col("user_id"), F.floor(F.col("value"))), 4).alias("pct")),
    "select event_id, round(case when floor(value) > 0 then least(100.0, user_id / floor(value) * 100.0) else 0.0 end, 4)::double as pct from events",
)
_PN = {k: "(?i)" + "|".join(v) for k, v in tx.PAGE_NUMBER_PATTERNS.items()}
query(
    "flt13_is_page_number",
    lambda t: t.page_lines.withColumn("text", F.expr("case ord % 6 when 0 then cast(page as string) when 1 then '- ' || page || ' -' when 2 then 'p.' || page when 3 then page || '/220' when 4 then text else 'Page ' || page end")).select(
        "contract_id", "page", "ord", tx.is_page_number(F.col("text"), "layout").alias("a"), tx.is_page_number(F.col("text"), "sections").alias("b")
    ),
    f"""select contract_id, page, ord, {rx('t', _PN['layout'])} as a, {rx('t', _PN['sections'])} as b from (select contract_id, page, ord,
          case ord % 6 when 0 then cast(page as varchar) when 1 then '- ' || page || ' -' when 2 then 'p.' || page when 3 then page || '/220' when 4 then {strip('text')} else 'Page ' || page end as t from page_lines) x""",
)


def _prev(k: str, rx_: str) -> str:
    return f"({k} > 1 and {rx('ls[k - 1]', rx_)})"


_U_LIST = rx("ls[k]", ln.UNWRAP_MARKER)
_U_END = rx("ls[k - 1]", ln.SENTENCE_END)
query(
    "wn24_unwrap_lines",
    lambda t: ln.unwrap_lines(t.numbered_sections).select("doc_id", F.md5("content").alias("h")),
    f"""select doc_id, md5(array_to_string(list_transform(range(1, len(ls) + 1), lambda k: case when k = 1 then ls[1]
          when ls[k] = '' or ls[k - 1] = '' then chr(10) || ls[k]
          when {_U_LIST} then case when {_U_END} or not {rx('ls[k]', ln.PAREN_NUMBER)} then chr(10) else ' ' end || ls[k]
          when starts_with(ls[k], '|') or starts_with(ls[k], '**') or {_U_END} then chr(10) || ls[k] else ' ' || ls[k] end), '')) as h
        from (select doc_id, list_transform(string_split(content, chr(10)), lambda x: {strip('x')}) as ls from numbered_sections) x""",
)
query(
    "wn23_reflow_paragraphs",
    lambda t: ln.reflow_paragraphs(t.numbered_sections).select("doc_id", F.md5("content").alias("h")),
    f"""select doc_id, md5(array_to_string(list_transform(range(1, len(ls) + 1), lambda k: case
          when k = 1 then case when {strip('ls[1]')} = '' then '' else ls[1] end when {strip('ls[k]')} = '' then chr(10)
          when {strip('ls[k - 1]')} = '' or {rx('ls[k]', ln.REFLOW_MARKER)} or starts_with({strip('ls[k]')}, '|') or {rx('ls[k]', ln.BOLD_LINE)}
            or ({rx('ls[k - 1]', '[.;:]' + chr(92) + 's*$')} and {rx('ls[k]', '^' + chr(92) + 's*' + chr(92) + '([^)]{5,}')}) then chr(10) || ls[k]
          else ' ' || {strip('ls[k]')} end), '')) as h
        from (select doc_id, string_split(content, chr(10)) as ls from numbered_sections) x""",
)
