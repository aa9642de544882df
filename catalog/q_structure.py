"""Layout, section, part, TOC and clause-assembly queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions import headings as hd
from paperloom.functions import lines as ln
from paperloom.functions import numbering as nb
from paperloom.functions import text as tx
from paperloom.functions import zoning as zn
from paperloom.functions.rules import register_rules
from paperloom.operators import clauses as cl
from paperloom.operators import dashboards as da
from paperloom.operators import layout as ly
from paperloom.operators import sections as se
from paperloom.operators import toc as tc

from paperloom.plans.scratch import no_shuffle_kept, scratch_path
from paperloom.streaming import jobs as st

from .q_text import _sql_paragraph_part, heading_line_sql, pattern_table, toc_line_sql, SQL_TOC_LINES, _toc_lines
from .registry import apart, query
from .sqltext import (
    NON_TARGET, cross_ref, detect_part, ex, heading_number, hint, remainder_kind, rep, rest_case, kind_case, rx, strip, upper_ratio, ws, zone_hint,
)

NL2 = "chr(10) || chr(10)"

# ------------------------------------------------------------------ layout

query(
    "wn3_with_edge_flags",
    lambda t: ly.with_edge_flags(t.page_lines).select("contract_id", "page", "ord", "is_edge"),
    """select contract_id, page, ord, row_number() over (partition by contract_id, page order by y0, ord) <= 2
         or row_number() over (partition by contract_id, page order by y0 desc, ord desc) <= 2 as is_edge from page_lines""",
)
_NORM_L = f"lower({rep(ws('text'), '[0-9]+', '0')})"
SQL_CAND = f"""select *, y1 <= page_height * 0.12 or y0 >= page_height * 0.88 or row_number() over (partition by contract_id, page order by y0, ord) <= 2
    or row_number() over (partition by contract_id, page order by y0 desc, ord desc) <= 2 as cand, {_NORM_L} as norm from page_lines"""
SQL_REP = """select contract_id, norm from cand_lines where cand and length(norm) >= 3 group by contract_id, norm
    having count(*)::double / (select count(distinct page) from page_lines p where p.contract_id = cand_lines.contract_id) >= 0.6"""
query(
    "ag7_repeated_lines_layout",
    lambda t: ly.repeated_lines_layout(t.page_lines),
    "select contract_id, norm from rep_lines",
    cand_lines=SQL_CAND,
    rep_lines=SQL_REP,
)
query(
    "jn13_drop_repeated_lines",
    lambda t: ly.drop_repeated_lines(t.page_lines, ly.repeated_lines_layout(t.page_lines)).select("contract_id", "page", "ord"),
    f"""select contract_id, page, ord from cand_lines c where not (cand and (exists (select 1 from rep_lines r where r.contract_id = c.contract_id and r.norm = c.norm)
          or {rx(strip('text'), '(?i)' + '|'.join(tx.PAGE_NUMBER_PATTERNS['layout']))}))""",
    cand_lines=SQL_CAND,
    rep_lines=SQL_REP,
)
SQL_PATTERNS = f"""select contract_id, position, norm, case when num then 'page_number' else 'repeated_text' end as type from (
    select contract_id, position, case when num then 'page_number' else norm end as norm, num, count(*) as n from (
      select contract_id, case when (y0 + y1) / 2 <= 842 * 0.15 then 'header' when (y0 + y1) / 2 >= 842 * 0.85 then 'footer' end as position,
        {rep('lower(' + strip('text') + ')', '[0-9]+', '#')} as norm, {rx(strip('text'), '(?i)' + '|'.join(tx.PAGE_NUMBER_PATTERNS['sections']))} as num from page_lines) a
    where position is not null and norm <> '' group by all) b
    where n >= greatest(3, floor((select count(distinct page) from page_lines p where p.contract_id = b.contract_id) * 0.15))"""
query(
    "ag8_repeated_lines_sections",
    lambda t: ly.repeated_lines_sections(t.page_lines),
    "select contract_id, position, norm, type from pats",
    pats=SQL_PATTERNS,
)
query(
    "ag8_page_number_style",
    lambda t: ly.page_number_style(ly.repeated_lines_sections(t.page_lines)),
    "select contract_id, min(position) as style from pats where type = 'page_number' group by 1",
    pats=SQL_PATTERNS,
)
query(
    "ag9_removal_counts",
    lambda t: ly.removal_counts(t.page_lines, ly.repeated_lines_sections(t.page_lines)),
    f"""select contract_id, count(*) filter (where r = 'header') as removed_header, count(*) filter (where r = 'footer') as removed_footer from (
          select l.contract_id, case when norm = '' then null when pn and exists (select 1 from pats p where p.contract_id = l.contract_id and type = 'page_number') then 'footer'
            when exists (select 1 from pats p where p.contract_id = l.contract_id and p.norm = l.norm and type <> 'page_number' and position = 'header') then 'header'
            when exists (select 1 from pats p where p.contract_id = l.contract_id and p.norm = l.norm and type <> 'page_number') then 'footer' end as r
          from (select contract_id, {rep('lower(' + strip('text') + ')', '[0-9]+', '#')} as norm,
            {rx(strip('text'), '(?i)' + '|'.join(tx.PAGE_NUMBER_PATTERNS['sections']))} as pn from page_lines) l) x group by 1""",
    pats=SQL_PATTERNS,
)
query(
    "ag10_font_medians",
    lambda t: ly.font_medians(t.page_lines).withColumn("median", F.round("median", 4)),
    """select contract_id, page, median(font_size) as median from page_lines where font_size > 0 group by 1, 2
       union all select contract_id, -1, median(font_size) from page_lines where font_size > 0 group by 1""",
)
SQL_BLOCKS = f"""with recursive ol as (select *, row_number() over (partition by contract_id, page order by y0, x0, ord) as rn from page_lines where {strip('text')} <> ''),
    mh as (select contract_id, greatest(3.5, 0.9 * coalesce(nullif(median(y1 - y0), 0), 10)) as gap from page_lines where y1 - y0 > 0 group by 1),
    rec as (select contract_id, page, rn, ord, x0 as lft, y1 as bottom, 0 as block_id from ol where rn = 1
      union all select o.contract_id, o.page, o.rn, o.ord, case when o.y0 - r.bottom > m.gap or abs(o.x0 - r.lft) > 80 then o.x0 else least(r.lft, o.x0) end, o.y1,
        case when o.y0 - r.bottom > m.gap or abs(o.x0 - r.lft) > 80 then r.block_id + 1 else r.block_id end
      from rec r join ol o on o.contract_id = r.contract_id and o.page = r.page and o.rn = r.rn + 1 join mh m on m.contract_id = r.contract_id)
    select l.*, r.block_id from rec r join page_lines l on l.contract_id = r.contract_id and l.page = r.page and l.ord = r.ord"""
query(
    "wn4_assign_blocks",
    lambda t: ly.assign_blocks(t.page_lines).select("contract_id", "page", "ord", "block_id"),
    "select contract_id, page, ord, block_id from blk",
    blk=SQL_BLOCKS,
)
_JOINED = ws(
    "replace("
    + rep(
        "string_agg(nullif(" + ws("text") + ", ''), '@#' order by y0, x0, ord)",
        "([A-Za-z])-@#([a-z_])",
        "\\1\\2",
    )
    + ", '@#', ' ')"
)
SQL_STATS = f"""select contract_id, page, block_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1,
    coalesce(avg(font_size) filter (where font_size > 0), 0) as avg_font_size, avg(is_bold::int) as bold_ratio, {_JOINED} as text from blk group by 1, 2, 3"""
query(
    "ag11_block_stats",
    lambda t: ly.block_stats(ly.assign_blocks(t.page_lines)).select(
        "contract_id", "page", "block_id", "x0", "y0", "x1", "y1", F.round("avg_font_size", 4).alias("avg_font_size"),
        F.round("bold_ratio", 4).alias("bold_ratio"), F.round("upper_ratio", 4).alias("upper_ratio"), F.md5("text").alias("h"),
    ),
    f"""select contract_id, page, block_id, x0, y0, x1, y1, round(avg_font_size, 4) as avg_font_size, round(bold_ratio, 4) as bold_ratio,
          round({upper_ratio('text')}, 4) as upper_ratio, md5(text) as h from st""",
    blk=SQL_BLOCKS,
    st=SQL_STATS,
)
query(
    "wn5_mark_headings",
    lambda t: ly.mark_headings(ly.block_stats(ly.assign_blocks(t.page_lines))).select("contract_id", "page", "block_id", "block_type"),
    f"""select contract_id, page, block_id, case when ht <> '' and ({rx('ht', '(?i)^(ARTICLE|SECTION|SCHEDULE|EXHIBIT|APPENDIX)' + chr(92) + 's|^제[ ]*[0-9]+[ ]*조')}
          or coalesce(h_head, false)
          or (((avg_font_size > 0 and pm > 0 and avg_font_size >= pm * 1.12) or (bold_ratio >= 0.55 and length(ht) <= 140)) and {upper_ratio('ht')} >= 0.35 and length(ht) <= 180)
          or (length({rep('ht', '[^a-zA-Z]')}) between 1 and 80 and {upper_ratio('ht')} > 0.8)) then 'heading' else 'paragraph' end as block_type
        from (select *, median(case when avg_font_size > 0 then avg_font_size end) over (partition by contract_id, page) as pm from hst) x""",
    blk=SQL_BLOCKS,
    st=SQL_STATS,
    hst=hint("st", "text"),
)


def _hyphen_lines(t):
    return t.page_lines.withColumn(
        "text", F.expr("case when ord % 3 = 1 then text || '-' when ord % 7 = 2 then text || '--' when ord % 11 = 3 then '  ' else text end")
    )


_H = rx("p.t", "[-­‐‑–]$")
query(
    "wn22_repair_hyphens",
    lambda t: ly.repair_hyphens(_hyphen_lines(t)).select("contract_id", "page", "ord", F.md5("text").alias("h")),
    f"""select contract_id, page, min(ord) as ord, md5(string_agg(case when nj and not {rx('ltrim(nt)', '^' + chr(92) + 'p{Lu}')} then b[1:length(b) - 1] else b end, '' order by ord)) as h from (
          select *, case when j then ltrim(t) else t end as b, sum(case when j then 0 else 1 end) over (partition by contract_id, page order by ord) as isl from (
            select *, coalesce(regexp_matches(pt, '[-­‐‑–]$') and not ends_with(pt, '--'), false) as j,
              nt is not null and regexp_matches(t, '[-­‐‑–]$') and not ends_with(t, '--') as nj from (
              select *, lag(t) over w as pt, lead(t) over w as nt from (select contract_id, page, ord, rtrim(
                case when ord % 3 = 1 then text || '-' when ord % 7 = 2 then text || '--' when ord % 11 = 3 then '  ' else text end, E' \\t\\n\\r') as t from page_lines) a
              where trim(t) <> '' window w as (partition by contract_id, page order by ord)) b) c) d group by contract_id, page, isl""",
)


def _zone_blocks(t):
    """Two blocks per section: its heading and its text, placed in the zones."""
    z = t.clause_zone.select("doc_id", "zone_index", F.col("zone_type").alias("zone_key"))
    both = F.array(
        F.struct(F.lit(0).alias("k"), F.col("heading").alias("text")), F.struct(F.lit(1).alias("k"), F.col("content").alias("text"))
    )
    blocks = t.sections.join(z, "doc_id").select("contract_id", "section_index", "zone_index", "zone_key", F.explode(both).alias("b")).select(
        "contract_id", "zone_index", "zone_key", (F.col("section_index") * 2 + F.col("b.k")).alias("block_no"), F.col("b.text").alias("text"),
        F.when((F.col("b.k") == 0) & (F.col("section_index") % 4 != 2), "heading").otherwise("paragraph").alias("block_type"),
    )
    return nb.annotate_numbering(blocks, "text")


query(
    "wn7_build_clauses",
    lambda t: ly.build_clauses(_zone_blocks(t)).select(
        "contract_id", "order_index", "clause_number", F.coalesce("title", F.lit("")).alias("title"), F.md5("content").alias("h"), "is_auto_split", "zone_key"
    ),
    f"""select contract_id, k - 1 as order_index, coalesce(hn, zone_key || case when head is null then '-auto-' else '-' end || cast(k as varchar)) as clause_number,
          coalesce(head, '') as title, md5(case when head is null then body when body is null then head else head || chr(10) || body end) as h,
          head is null as is_auto_split, zone_key
        from (select *, row_number() over (partition by contract_id order by zone_index, bn) as k from (
          select contract_id, zone_index, zone_key, g, min(block_no) as bn, max(ht) filter (where op) as head, max(h_norm) filter (where op) as hn,
            string_agg(ht, chr(10) order by block_no) filter (where not op) as body from (
            select *, sum(case when op then 1 else 0 end) over (partition by contract_id, zone_index order by block_no) as g from (
              select *, block_type = 'heading' or coalesce(h_kind, '') = 'schedule' as op from hb where ht <> '') a) b
          group by contract_id, zone_index, zone_key, g) c) d""",
    bl="""select s.contract_id, z.zone_index, z.zone_type as zone_key, s.section_index * 2 + k as block_no, case when k = 0 then heading else content end as text,
        case when k = 0 and section_index % 4 <> 2 then 'heading' else 'paragraph' end as block_type
        from sections s join clause_zone z on z.doc_id = s.doc_id, (select 0 as k union all select 1) kk""",
    hb=hint("bl", "text"),
)

# ------------------------------------------------------------------ sections


def _contract_lines(t):
    """All numbered lines of a contract in one order, with heading candidates."""
    lines = t.num_lines.select(
        "contract_id", (F.col("section_index") * 100_000 + F.col("pos")).alias("line_no"), F.col("section_index").alias("page"), "text"
    ).where(tx.strip(F.col("text")) != "")
    tested = hd.is_heading_line(lines).withColumnRenamed("is_heading", "is_candidate")
    return tested.withColumn("is_trigger", F.coalesce(F.col("text").rlike(zn.TRIGGER_GENERAL), F.lit(False)))


SQL_CL = f"""select contract_id, section_index * 100000 + pos as line_no, section_index as page, text, {heading_line_sql()} as is_candidate,
    {rx('text', '(?i)^' + chr(92) + 's*general' + chr(92) + 's+provisions' + chr(92) + 's*$')} as is_trigger
    from (select *, {strip('text')} as t from num_lines) x where t <> ''"""
query(
    "wn9_suppress_reference_headings",
    lambda t: se.suppress_reference_headings(_contract_lines(t)).select("contract_id", "line_no", "is_heading"),
    f"""select * from (with recursive o as (select *, row_number() over (partition by contract_id order by line_no) as rn,
            is_candidate and not is_trigger as mc, {rx('text', '(?i)^' + chr(92) + 's*(?:CLAUSE|ARTICLE|SECTION|PART|CHAPTER)' + chr(92) + 's')} as kw,
            regexp_matches(rtrim(text), '[-­‐‑–]$') and not ends_with(rtrim(text), '--') as hy,
            {rx('rtrim(text)', '(?i)(?:^|' + chr(92) + 's)(?:Sub-?Clause|Clause|Article|Section|Part|Chapter)' + chr(92) + 's*$')} as dg from cl),
          rec as (select contract_id, rn, line_no, is_candidate as is_heading, not is_candidate and hy as lhy, not is_candidate and dg as ldg from o where rn = 1
            union all select o.contract_id, o.rn, o.line_no, o.is_candidate and not (o.mc and ((r.lhy and o.kw) or r.ldg)),
              not (o.is_candidate and not (o.mc and ((r.lhy and o.kw) or r.ldg))) and o.hy,
              not (o.is_candidate and not (o.mc and ((r.lhy and o.kw) or r.ldg))) and o.dg
            from rec r join o on o.contract_id = r.contract_id and o.rn = r.rn + 1)
        select contract_id, line_no, is_heading from rec) rq""",
    cl=SQL_CL,
)
query(
    "wn8_build_sections",
    lambda t: se.build_sections(_contract_lines(t).withColumn("is_heading", F.col("is_candidate"))).select(
        "contract_id", "section_no", "heading", F.md5("content").alias("h"), "page_start", "page_end"
    ),
    f"""select contract_id, section_no, coalesce(max(text) filter (where is_candidate), '') as heading,
          md5(coalesce(string_agg(text || chr(10), '' order by line_no) filter (where not is_candidate), '')) as h, min(page) as page_start, max(page) as page_end
        from (select *, (sum(is_candidate::int) over (partition by contract_id order by line_no))::bigint as section_no from cl) x group by 1, 2
        having heading <> '' or count(*) filter (where not is_candidate) > 0""",
    cl=SQL_CL,
)
_NUMBERED_HEAD = rx(strip("heading"), hd.NUMBERED_HEADING)
query(
    "wn10_mark_preamble",
    lambda t: se.mark_preamble(t.sections.withColumn("zone_hint", F.expr("case when section_index < 7 then 'contract_body' else zone_hint end"))).select(
        "contract_id", "section_index", F.coalesce("zone_hint", F.lit("")).alias("zone_hint")
    ),
    f"""select contract_id, section_index, coalesce(case when zh = 'contract_body' and not bool_or({_NUMBERED_HEAD}) over (partition by contract_id order by section_index)
          then 'preamble' else zh end, '') as zone_hint from (select *, case when section_index < 7 then 'contract_body' else zone_hint end as zh from sections) x""",
)
query(
    "wn35_with_section_level",
    lambda t: hd.with_section_level(t.sections.select("doc_id", "heading")).select("doc_id", "level"),
    f"""select doc_id, case when coalesce({detect_part('heading', 'sections')}, '') in ('contract_agreement', 'general_conditions', 'particular_conditions',
          'conditions_of_contract', 'commercial_terms', 'technical_specifications', 'appendices', 'annexure', 'amendment', 'letter_of_acceptance', 'form_of_tender',
          'bill_of_quantities') then 1 when {rx('heading', '^[0-9]')} then len(string_split({ex('heading', '^([0-9]+(?:[.][0-9]+)*)', 1)}, '.'))
          when {rx('heading', '(?i)^(SECTION|CLAUSE)' + chr(92) + 's')} or starts_with(heading, '제3조') then 2 else 1 end as level from sections""",
)


def _part_sections(t):
    """Three kinds of contracts: with parts, with a preamble only, and with neither."""
    return t.sections.withColumns(
        {
            "heading": F.expr("case when contract_id % 4 = 1 and section_index in (0, 1, 2, 15, 19, 20, 21, 4) then '' when contract_id % 4 = 2 then 'x ' || heading else heading end"),
            "zone_hint": F.expr("case when contract_id % 4 = 1 and section_index < 3 then 'preamble' when contract_id % 4 = 2 and zone_hint = 'preamble' then 'contract_body' when section_index = 17 then 'contract_body' else zone_hint end"),
            "content": F.expr("case when section_index in (15, 16) and contract_id % 3 = 1 then '  ' else content end"),
        }
    )


SQL_PS = f"""select *, case when heading <> '' and level = 1 and not is_toc then {detect_part('heading', 'sections')} end as bt from (select contract_id, section_index, level, is_toc, page_start, page_end,
    case when contract_id % 4 = 1 and section_index in (0, 1, 2, 15, 19, 20, 21, 4) then '' when contract_id % 4 = 2 then 'x ' || heading else heading end as heading,
    case when contract_id % 4 = 1 and section_index < 3 then 'preamble' when contract_id % 4 = 2 and zone_hint = 'preamble' then 'contract_body' when section_index = 17 then 'contract_body' else zone_hint end as zone_hint,
    case when section_index in (15, 16) and contract_id % 3 = 1 then '  ' else content end as content from sections) q"""
SQL_PN = "select *, (sum(case when bt is not null then 1 else 0 end) over (partition by contract_id order by section_index))::bigint as part_no, max(bt is not null) over (partition by contract_id) as has_b from ps"
SQL_PARTS = f"""select contract_id, part_no, 'preamble' as part_type, '전문' as title, min(page_start) as page_start,
      coalesce(arg_max(page_end, section_index) filter (where not is_toc), (select min(page_start) - 1 from pn b where b.contract_id = pn.contract_id and b.part_no = 1)) as page_end, count(*) as section_count
    from pn where has_b and part_no = 0 group by 1, 2
    union all
    select contract_id, part_no, max(bt), max(heading) filter (where bt is not null), min(page_start),
      coalesce(max(page_end) filter (where not is_toc), max(page_end)), count(*) from pn where has_b and part_no > 0 group by 1, 2
      having bool_or({strip('content')} <> '' or (bt is null and heading <> ''))
    union all
    select contract_id, 0, 'preamble', '전문', arg_min(page_start, section_index) filter (where zone_hint = 'preamble' and not is_toc),
      arg_max(page_end, section_index) filter (where zone_hint = 'preamble' and not is_toc), count(*) filter (where zone_hint = 'preamble' and not is_toc)
    from pn where not has_b group by 1 having count(*) filter (where zone_hint = 'preamble' and not is_toc) > 0
    union all
    select contract_id, case when count(*) filter (where zone_hint = 'preamble' and not is_toc) > 0 then 1 else 0 end, 'contract_body', '계약서 본문',
      case when count(*) filter (where zone_hint = 'preamble' and not is_toc) > 0 then arg_min(page_start, section_index) filter (where coalesce(zone_hint, '') not in ('preamble', 'toc')) else 1 end,
      max(page_end), count(*) filter (where not (coalesce(zone_hint, '') = 'preamble' and not is_toc)) from pn where not has_b group by 1"""
query(
    "wn12_document_parts",
    lambda t: se.document_parts(_part_sections(t)),
    "select contract_id, part_no, part_type, title, page_start, page_end, section_count from dparts",
    ps=SQL_PS,
    pn=SQL_PN,
    dparts=SQL_PARTS,
)
query(
    "register_rules_parts",
    lambda t: se.document_parts(_part_sections(t), register_rules(pattern_table(t, "sections"))),
    "select contract_id, part_no, part_type, title, page_start, page_end, section_count from dparts",
    ps=SQL_PS,
    pn=SQL_PN,
    dparts=SQL_PARTS,
)


def _wn13(t):
    s = _part_sections(t)
    return se.propagate_zones(s, se.document_parts(s)).select("contract_id", "section_index", F.coalesce("zone_hint", F.lit("")).alias("zone_hint"))


query(
    "wn13_propagate_zones",
    _wn13,
    """select s.contract_id, s.section_index, coalesce(case when s.bt is not null or s.part_no = 0 or p.part_type is null then s.zone_hint
         when p.part_type in ('definitions', 'toc', 'cover_page', 'preamble') then case when s.zone_hint is null or s.zone_hint in ('contract_body', 'unknown') then 'contract_body' else s.zone_hint end
         else p.part_type end, '') as zone_hint
       from pn s left join dparts p on p.contract_id = s.contract_id and p.part_no = s.part_no and p.part_no > 0 and s.has_b""",
    ps=SQL_PS,
    pn=SQL_PN,
    dparts=SQL_PARTS,
)
query(
    "wn14_merge_adjacent_zones",
    lambda t: se.merge_adjacent_zones(t.sections).select(
        "contract_id", "zone_index", "zone_type", "page_from", "page_to", F.coalesce("title", F.lit("")).alias("title"), "is_analysis_target", "confidence", F.md5("text").alias("h")
    ),
    f"""select contract_id, (run - 1)::bigint as zone_index, z as zone_type, arg_min(page_start, section_index) as page_from, arg_max(page_end, section_index) as page_to,
          arg_min(heading, section_index) as title, coalesce(arg_min(coalesce(zone_hint, '-'), section_index), '-') not in {NON_TARGET} as is_analysis_target,
          cast(case when arg_min(coalesce(zone_hint, '-'), section_index) = '-' then 0.8 when arg_min(zone_hint, section_index) not in {NON_TARGET} then 0.92
            when arg_min(zone_hint, section_index) in ('toc', 'cover_page') then 0.85 else 0.8 end as double) as confidence,
          md5(coalesce(string_agg(nullif(tx, ''), {NL2} order by section_index), '')) as h
        from (select *, sum(nw) over (partition by contract_id order by section_index) as run from (
          select *, case when lag(z) over (partition by contract_id order by section_index) = z then 0 else 1 end as nw,
            {strip("case when heading <> '' then heading || chr(10) || content else content end")} as tx
          from (select *, coalesce(zone_hint, 'contract_body') as z from sections where level <= 1) a) b) c group by contract_id, run, z""",
)


def _toc_sections(t):
    """Sections whose neighbours of the TOC page look like continuations for some contracts."""
    n = t.sections.where("section_index = 1").select("contract_id", F.col("content").alias("toc_text"))
    return t.sections.join(n, "contract_id").withColumns(
        {
            "content": F.expr("case when section_index in (2, 3) and contract_id % 3 <> 0 then toc_text when section_index = 0 and contract_id % 5 = 1 then toc_text when section_index = 4 and contract_id % 3 = 1 then '' else content end"),
            "heading": F.expr("case when section_index = 4 and contract_id % 2 = 0 then '' else heading end"),
            "is_toc": F.expr("is_toc and contract_id % 2 = 0"),
        }
    ).drop("toc_text")


SQL_TS = """select s.contract_id, s.section_index, case when section_index = 4 and s.contract_id % 2 = 0 then '' else heading end as heading,
    is_toc and s.contract_id % 2 = 0 as is_toc, case when section_index in (2, 3) and s.contract_id % 3 <> 0 then toc_text when section_index = 0 and s.contract_id % 5 = 1 then toc_text
    when section_index = 4 and s.contract_id % 3 = 1 then '' else content end as content
    from sections s join (select contract_id, content as toc_text from sections where section_index = 1) n on n.contract_id = s.contract_id"""
_LEAD = "(regexp_matches(x, '\\.{3,}|-\\s*-\\s*-') and regexp_matches(x, '\\d+\\s*$'))"
SQL_TD = f"""select *, len(ls) as n_lines, len(list_filter(ls, lambda x: {_LEAD})) as leader, len(list_filter(ls, lambda x: regexp_matches(x, '\\d+\\s*$'))) as "trailing",
    len(list_filter(ls, lambda x: regexp_matches(x, '(?:\\.{{2,}}|\\.\\s+\\.|\\-\\s*\\-|\\t)\\s*\\d+\\s*$'))) as leader_num,
    (length(content) - length(replace(content, '.', '')))::double / greatest(length(content), 1) as dots
    from (select *, list_filter(string_split(content, chr(10)), lambda x: {strip('x')} <> '') as ls from ts) q"""
query(
    "ag21_toc_densities",
    lambda t: tc.toc_densities(_toc_sections(t)).select("contract_id", "section_index", "lines", "leader", "trailing", "leader_num", F.round("dot_density", 4).alias("dots")),
    'select contract_id, section_index, n_lines as lines, leader, "trailing", leader_num, round(dots, 4) as dots from td',
    ts=SQL_TS,
    td=SQL_TD,
)
query(
    "wn15_mark_toc",
    lambda t: tc.mark_toc(_toc_sections(t)).select("contract_id", "section_index", "is_toc"),
    f"""select * from (with recursive o as (select *, is_toc or {rx(strip('heading'), '(?i)^(table' + chr(92) + 's+of' + chr(92) + 's+contents?|contents?|index)$')} as op,
          case when n_lines > 0 then leader >= n_lines * 0.25 or ("trailing" >= n_lines * 0.35 and dots >= 0.02) else {strip('heading')} = '' end as goes,
          section_index < 3 and n_lines >= 3 and dots >= 0.03 and (leader >= n_lines * 0.5 or ("trailing" >= n_lines * 0.3 and leader_num >= "trailing" * 0.5)) as dens from td),
        rec as (select contract_id, section_index, op as mode, op or dens as toc from o where section_index = 0
          union all select o.contract_id, o.section_index, o.op or (r.mode and o.goes), o.op or (r.mode and o.goes) or o.dens
          from rec r join o on o.contract_id = r.contract_id and o.section_index = r.section_index + 1)
        select contract_id, section_index, toc as is_toc from rec) rq""",
    ts=SQL_TS,
    td=SQL_TD,
)
query(
    "wn15_mark_toc_pages",
    lambda t: tc.mark_toc(
        _toc_sections(t).select("contract_id", F.col("section_index").alias("page"), F.concat("heading", F.lit("\n"), "content").alias("text")), "page"
    ).select("contract_id", "page", "is_toc"),
    f"""select * from (with recursive o as (select *, len(list_filter(ls[1:5], lambda x: {rx(strip('x'), '(?i)^(table' + chr(92) + 's+of' + chr(92) + 's+contents?|contents?|index)$')})) > 0 as op,
          len(ls) > 0 and (len(list_filter(ls, lambda x: {_LEAD})) >= len(ls) * 0.25 or (len(list_filter(ls, lambda x: regexp_matches(x, '\\d+\\s*$'))) >= len(ls) * 0.35
            and (length(tx) - length(replace(tx, '.', '')))::double / greatest(length(tx), 1) >= 0.02)) as goes
          from (select contract_id, section_index as page, heading || chr(10) || content as tx, list_filter(string_split(heading || chr(10) || content, chr(10)), lambda x: {strip('x')} <> '') as ls from ts) q),
        rec as (select contract_id, page, op as toc from o where page = 0
          union all select o.contract_id, o.page, o.op or (r.toc and o.goes) from rec r join o on o.contract_id = r.contract_id and o.page = r.page + 1)
        select contract_id, page, toc as is_toc from rec) rq""",
    ts=SQL_TS,
)
query(
    "wn16_toc_entries",
    lambda t: tc.toc_entries(_toc_lines(t), F.lit(38)).select(
        "contract_id", "entry_index", "title", F.coalesce("page_number", F.lit(-1)).alias("page_number"), "level"
    ),
    f"""select contract_id, row_number() over (partition by contract_id order by line_no) - 1 as entry_index, title, coalesce(page_number, -1) as page_number, level
        from ({toc_line_sql()}) x""",
    tl=SQL_TOC_LINES,
)


def _entries(t):
    toc_only = t.sections.where("section_index = 1").select("contract_id", F.posexplode(F.split("content", "\n")).alias("line_no", "text"))
    return tc.toc_entries(toc_only, F.lit(60))


def _jn9_parts(t):
    return apart(t.parts, "contract_id", "part_index % 3 = 2")


def _jn9(t):
    inserts, warnings = tc.reconcile_toc(_jn9_parts(t), _entries(t), apart(t.sections, "contract_id", "page_end >= 33"))
    return inserts.select("contract_id", "entry_index", "part_type", "title", "page_start", "page_end").unionByName(
        warnings.select("contract_id", "entry_index", F.lit("warning").alias("part_type"), "title", F.col("page_number").alias("page_start"), F.lit(-1).alias("page_end"))
    )


SQL_TE = f"""select contract_id, row_number() over (partition by contract_id order by line_no) - 1 as entry_index, title, page_number, level from ({toc_line_sql().replace('between 1 and 38', 'between 1 and 60')}) x"""
SQL_OPEN = """select e.* from te e where level = 1 and page_number is not null
    and page_number > coalesce((select max(page_end) from jp p where p.contract_id = e.contract_id and p.part_type = 'toc'), 0)
    and not exists (select 1 from jp p where p.contract_id = e.contract_id and abs(p.page_start - e.page_number) <= 2)"""
SQL_NEAR = """select e.contract_id, e.entry_index, e.title, e.page_number, (select s.page_end from sections s, (select unnest([0, -1, 1, -2, 2]) as o, unnest([0, 1, 2, 3, 4]) as k) k
      where s.contract_id = e.contract_id and s.page_end < 33 and e.page_number + k.o between s.page_start and s.page_end order by k.k, s.section_index limit 1) as sec_end from op e"""
query(
    "jn9_reconcile_toc",
    _jn9,
    f"""select contract_id, entry_index, {zone_hint('title', detect_part('title', 'sections'))} as part_type, title, page_number as page_start, sec_end as page_end
        from nr n where sec_end is not null and not exists (select 1 from jp p where p.contract_id = n.contract_id and n.page_number <= p.page_end and p.page_start <= n.sec_end
          and n.page_number <= n.sec_end)
        union all select contract_id, entry_index, 'warning', title, page_number, -1 from nr where sec_end is null""",
    tl="select contract_id, u.pos - 1 as line_no, ls[u.pos] as text from (select contract_id, string_split(content, chr(10)) as ls from sections where section_index = 1) q, unnest(range(1, len(ls) + 1)) as u(pos)",
    te=SQL_TE,
    jp="select * from parts where part_index % 3 < 2",
    op=SQL_OPEN,
    nr=SQL_NEAR,
)
query(
    "jn10_drop_overlapping",
    lambda t: tc.drop_overlapping(
        t.sections.select("contract_id", F.col("section_index").alias("entry_index"), "page_start", "page_end"), t.parts
    ).select("contract_id", "entry_index"),
    """select contract_id, section_index as entry_index from sections s where not exists (select 1 from parts p where p.contract_id = s.contract_id
         and s.page_start <= p.page_end and p.page_start <= s.page_end)""",
)


def _score_parts(t):
    return t.parts.withColumns(
        {
            "title": F.expr("case when part_index = 2 and contract_id % 2 = 0 then '1. Scope' when part_index = 1 then '' else title end"),
            "part_type": F.expr("case when part_index = 4 and contract_id % 5 = 2 then 'toc' else part_type end"),
        }
    )


SQL_SP = """select contract_id, part_index, page_start, page_end, case when part_index = 2 and contract_id % 2 = 0 then '1. Scope' when part_index = 1 then '' else title end as title,
    case when part_index = 4 and contract_id % 5 = 2 then 'toc' else part_type end as part_type from parts"""
_RESTART = r"(?i)^\s*(?:article\s+(?:i|1)\b|(?:clause|section|part)\s+1\b|1\.\s+\S|제\s*1\s*(?:조|장|절))"
SQL_SCORE = f"""select *, case when part_index = 0 then 0 else b + case when b < 2 then re else 0 end + (part_type = 'toc' and page_start > fifth)::int
      + (part_type = 'cover_page' and coalesce(pv, '') not in ('cover_page', 'toc'))::int end as signals from (
    select p.*, lag(part_type) over (partition by contract_id order by part_index) as pv, greatest(1, floor(max(page_end) over (partition by contract_id) * 0.2)) as fifth,
      (page_start > 1 and exists (select 1 from sections s where s.contract_id = p.contract_id and p.page_start between s.page_start and s.page_end
         and regexp_matches(s.content || s.heading, '(?i)\\bpage\\s+1\\s+(?:of\\s+\\d+)?\\b')))::int + (part_type = 'cover_page')::int + {rx('title', _RESTART)}::int as b,
      (exists (select 1 from sections s where s.contract_id = p.contract_id and p.page_start between s.page_start and s.page_end and {rx('s.heading', _RESTART)}))::int as re
    from sp p) q"""
query(
    "wn17_boundary_score",
    lambda t: tc.with_boundary_score(t.sections, _score_parts(t)).select("contract_id", "part_index", "signals"),
    "select contract_id, part_index, signals from sc",
    sp=SQL_SP,
    sc=SQL_SCORE,
)
query(
    "wn17_sub_documents",
    # of one contract in six the parts belong to a contract without sections
    lambda t: tc.sub_documents(t.sections, apart(_score_parts(t), "contract_id", "contract_id % 6 = 5")).select(
        "contract_id", "subdoc_index", "title", "page_start", "page_end", "n_parts"
    ),
    """select contract_id, g::bigint as subdoc_index, coalesce(nullif(arg_min(title, part_index), ''), 'Document ' || (g + 1)) as title, arg_min(page_start, part_index) as page_start,
         case when mg = 0 then arg_max(page_end, part_index) else max(page_end) end as page_end, count(*) as n_parts from (
         select *, max(g) over (partition by contract_id) as mg from (select *, sum((signals >= 2)::int) over (partition by contract_id order by part_index) as g from sc) a) b
       group by contract_id, g, mg
       union all select contract_id, 0, coalesce(arg_min(heading, section_index) filter (where heading <> ''), ''), 1, max(page_end), 0 from sections where contract_id % 6 = 5 group by 1""",
    sp=f"select * replace (case when contract_id % 6 = 5 then -1 - contract_id else contract_id end as contract_id) from ({SQL_SP}) q",
    sc=SQL_SCORE,
)
query(
    "wn18_extend_inserted_parts",
    lambda t: tc.extend_inserted_parts(t.parts.withColumn("confidence", F.expr("case when part_index in (1, 2, 4) then 0.85D else null end"))).select(
        "contract_id", "part_index", "page_end"
    ),
    """select contract_id, part_index, case when part_index not in (1, 2, 4) then page_end when nx is null then tot else greatest(page_end, nx - 1) end as page_end from (
         select *, lead(page_start) over (partition by contract_id order by page_start, part_index) as nx, max(page_end) over (partition by contract_id) as tot from parts) x""",
)


def _short_sections(t):
    return t.sections.withColumns(
        {
            "heading": F.expr("case when section_index in (14, 17) then '(b) item ' || heading when section_index = 8 then '(aa) more' when section_index = 20 then '(c) end' else heading end"),
            "zone_hint": F.expr("case when section_index = 13 and contract_id % 2 = 1 then 'definitions' else zone_hint end"),
            "level": F.expr("cast(case when section_index in (13, 10) then 3 else level end as int)"),
        }
    )


SQL_SS = f"""select *, {rx('heading', '(?i)^' + chr(92) + 's*' + chr(92) + '([a-z]{1,3}' + chr(92) + ')' + chr(92) + 's+' + chr(92) + 'S')} as alpha,
    {rx('heading', '^' + chr(92) + 's*[0-9]+(?:[.][0-9]+){2,}' + chr(92) + 's')} as deep, {detect_part('heading', 'sections')} is not null as bnd, {strip('content')} as body from (
    select contract_id, section_index, page_end, content, case when section_index in (14, 17) then '(b) item ' || heading when section_index = 8 then '(aa) more' when section_index = 20 then '(c) end' else heading end as heading,
      case when section_index = 13 and contract_id % 2 = 1 then 'definitions' else coalesce(zone_hint, 'contract_body') end as zone, case when section_index in (13, 10) then 3 else level end as level from sections) q"""
query(
    "wn25_merge_short_sections",
    lambda t: se.merge_short_sections(_short_sections(t)).select("contract_id", "section_index", "heading", "page_end", F.md5("content").alias("h")),
    """select * from (with recursive rec as (select contract_id, section_index, section_index as own, zone = 'definitions' or deep as guard from ss where section_index = 0
         union all select s.contract_id, s.section_index,
           case when (s.level >= 3 and length(s.body) < 50 and not s.bnd and not s.deep) or (s.alpha and not s.bnd and not r.guard and s.zone <> 'definitions') then r.own else s.section_index end,
           case when (s.level >= 3 and length(s.body) < 50 and not s.bnd and not s.deep) or (s.alpha and not s.bnd and not r.guard and s.zone <> 'definitions') then r.guard else s.zone = 'definitions' or s.deep end
         from rec r join ss s on s.contract_id = r.contract_id and s.section_index = r.section_index + 1)
       select r.contract_id, r.own as section_index, arg_min(s.heading, s.section_index) as heading, max(s.page_end) as page_end,
         md5(string_agg(case when s.section_index = r.own then s.content else case when s.heading <> '' then s.heading || chr(10) else '' end || case when s.body <> '' then s.body || chr(10) else '' end end, '' order by s.section_index)) as h
       from rec r join ss s on s.contract_id = r.contract_id and s.section_index = r.section_index group by 1, 2) rq""",
    ss=SQL_SS,
)
_EMB = r"\s+(\d+\.\d+(?:\.\d+)*)\s+\S"
# fixed values: headings that are complete by themselves
_DEEP = r"^\s*\d+(?:\.\d+){2,}\s"
_UNUSED = r"(?i)^\s*\d+(?:\.\d+)+\s+\[?Not\s+Used\]?\s*$"
_EMPTIED = "case when section_index in (2, 3, 8, 13, 16, 17, 22, 23) then '' when section_index = 9 and contract_id % 2 = 0 then ' ' else content end"
query(
    "wn26_merge_heading_fragments",
    lambda t: se.merge_heading_fragments(t.sections.withColumn("content", F.expr(_EMPTIED))).select(
        "contract_id", "section_index", "heading", "level", F.md5("content").alias("h"), "page_start", "page_end"
    ),
    """select contract_id, section_index, heading, level, md5(content) as h, page_start, page_end from (
         select f.contract_id, section_index, heading, level, content, page_start, page_end from folded f join kinds k using (contract_id, g) where k.alone
         union all
         select f.contract_id, min(section_index), array_to_string(list_filter(list(hh order by rn), lambda x: x <> ''), ' '), arg_min(level, rn),
           case when any_value(k.merges) then arg_max(content, rn) else arg_min(content, rn) end, arg_min(page_start, rn), arg_max(page_end, rn)
         from folded f join kinds k using (contract_id, g) where not k.alone group by f.contract_id, g) x""",
    hs=f"""select *, {heading_number('hh')} as num, {ex('hh', _EMB, 1)} as emb, {strip("coalesce(content, '')")} = '' and hh <> '' and not {rx('hh', _DEEP)} and not {rx('hh', _UNUSED)} as loose,
             row_number() over (partition by contract_id order by section_index) as rn
           from (select * replace ({_EMPTIED} as content), {strip("coalesce(heading, '')")} as hh from sections) q""",
    folded="""select h.*, r.g, r.kind from hs h join (with recursive rec as (
             select contract_id, rn, 1 as g, case when loose then num end as held, loose as open, case when loose then 'title' else 'solid' end as kind from hs where rn = 1
             union all
             select contract_id, rn, case when action in ('start', 'solid') then g + 1 else g end, case action when 'start' then num when 'join' then coalesce(held, num) end,
               action in ('start', 'join'), case action when 'start' then 'title' when 'join' then 'title' else action end
             from (select s.contract_id, s.rn, r.g, r.held, s.num, case when s.loose then case when not r.open then 'start' when s.num is null or r.held is null or s.num = r.held then 'join'
                   when starts_with(s.num, r.held || '.') or starts_with(s.emb, r.held || '.') then 'start' else 'target' end
                 when r.open and not coalesce(starts_with(s.num, r.held || '.') or starts_with(s.emb, r.held || '.'), false) then 'target' else 'solid' end as action
               from rec r join hs s on s.contract_id = r.contract_id and s.rn = r.rn + 1) t)
           select * from rec) r on r.contract_id = h.contract_id and r.rn = h.rn""",
    kinds="""select contract_id, g, bool_or(kind = 'target') as merges, bool_or(kind = 'solid') or (bool_and(kind = 'title') and max(rn) = any_value(n)) as alone
           from (select *, max(rn) over (partition by contract_id) as n from folded) q group by 1, 2""",
)
query(
    "wn27_split_compound_headings",
    lambda t: se.split_compound_headings(
        t.sections.withColumn("heading", F.expr("case when section_index = 9 then 'COMMENCEMENT ' || heading when section_index = 4 then 'Sub-Clause 14.2 Advance' else heading end"))
    ).select("doc_id", "sub", "heading", "level", F.md5("content").alias("h")),
    f"""select doc_id, k as sub, case when not sp then heading when k = 0 then lead else {strip('substr(hh, length(pre) + 1)')} end as heading,
          case when sp and k = 1 then len(string_split(child, '.')) else level end as level, md5(case when sp and k = 0 then '' else content end) as h
        from (select *, child <> '' and lead <> '' and case when num is not null then starts_with(child, num || '.') else length(lead) <= 60 and not {rx('lead', '[.;!?,]')}
            and not {rx('lead', se.STRUCT_PREFIX)} end as sp from (
          select *, {ex('hh', _EMB, 1)} as child, {ex('hh', '^(.*?' + chr(92) + 's+)[0-9]+[.][0-9]+(?:[.][0-9]+)*' + chr(92) + 's+' + chr(92) + 'S', 1)} as pre,
            {strip(ex('hh', '^(.*?' + chr(92) + 's+)[0-9]+[.][0-9]+(?:[.][0-9]+)*' + chr(92) + 's+' + chr(92) + 'S', 1))} as lead, {heading_number('hh')} as num from (
            select doc_id, content, level, case when section_index = 9 then 'COMMENCEMENT ' || heading when section_index = 4 then 'Sub-Clause 14.2 Advance' else heading end as heading,
              {strip("case when section_index = 9 then 'COMMENCEMENT ' || heading when section_index = 4 then 'Sub-Clause 14.2 Advance' else heading end")} as hh from sections) a) b) c,
        (select 0 as k union all select 1) kk where k = 0 or sp""",
)
_NUM = ex("text", ln.NUMBERED_LINE, 1)
SQL_ML = f"""select *, {_NUM} as cand, lag(text) over (partition by doc_id order by pos) as pv from num_lines"""
query(
    "wn28_split_multi_clause",
    lambda t: se.split_multi_clause(t.numbered_sections).select("doc_id", "sub", "heading", "level", F.md5("content").alias("h"), "is_auto_split"),
    f"""select doc_id, g::bigint as sub, case when g = 0 then hd else substr({strip("split_part(body, chr(10), 1)")}, 1, 120) end as heading,
          case when g = 0 then lv else len(string_split({ex('body', '^[0-9.]*[0-9]', 0)}, '.')) end as level,
          md5(case when mg = 0 then raw else body end) as h, g > 0 as is_auto_split
        from (select doc_id, g, mg, any_value(heading) as hd, any_value(level) as lv, string_agg(text, chr(10) order by pos) as raw, {strip('string_agg(text, chr(10) order by pos)')} as body from (
            select *, max(g) over (partition by doc_id) as mg from (
              select *, sum(bd::int) over (partition by doc_id order by pos) as g from (
                select m.*, s.heading, s.level, coalesce(s.zone_hint <> 'toc' and length(s.content) >= 50 and cand <> '' and not {cross_ref('text', 'pv')}
                  and (starts_with(cand, own || '.')), false) as bd
                from ml m join (select *, {ex('heading', '^[ ]*([0-9]+(?:[.][0-9]+)*)', 1)} as own from numbered_sections) s on s.doc_id = m.doc_id) a) b) c
          group by doc_id, g, mg
          union all select doc_id, 0, max(bd0), any_value(heading), any_value(level), '', '' from (
            select s.doc_id, s.heading, s.level, m.pos, first_value(coalesce(s.zone_hint <> 'toc' and length(s.content) >= 50 and cand <> '' and not {cross_ref('text', 'pv')} and starts_with(cand, own || '.'), false))
              over (partition by s.doc_id order by m.pos)::int as bd0 from ml m join (select *, {ex('heading', '^[ ]*([0-9]+(?:[.][0-9]+)*)', 1)} as own from numbered_sections) s on s.doc_id = m.doc_id) z
          group by doc_id having max(bd0) = 1) y""",
    ml=SQL_ML,
)
SQL_RESPLIT = f"""select doc_id, (g - 1)::bigint as sub, {ex('body', ln.NUMBERED_LINE, 1)} as number, body from (
    select doc_id, g, {strip('string_agg(text, chr(10) order by pos)')} as body from (
      select *, sum(ok::int) over (partition by doc_id order by pos) as g, sum(ok::int) over (partition by doc_id) as n_ok,
        sum((cand <> '')::int) over (partition by doc_id) as n_all,
        min(case when cand <> '' then greatest(off, 0) end) over (partition by doc_id) as first_off from (
        select *, cand <> '' and not {cross_ref('text', 'pv')} as ok, sum(length(text) + 1) over (partition by doc_id order by pos) - length(text) - 2 as off, sum(length(text) + 1) over (partition by doc_id) - 1 as tot from (
          select doc_id, pos, text, {_NUM} as cand, lag(text) over (partition by doc_id order by pos) as pv from rl) a) b) c
    where tot > 200 and n_all >= 2 and first_off <= 50 and n_ok >= 2 and g > 0 group by doc_id, g) d"""
query(
    "wn29_resplit_clauses",
    lambda t: se.resplit_clauses(t.numbered_sections).select("doc_id", "sub", "number", F.md5("content").alias("h")),
    "select doc_id, sub, number, md5(body) as h from rs",
    rl="select doc_id, u.pos - 1 as pos, ls[u.pos] as text from (select doc_id, string_split(" + strip("content") + ", chr(10)) as ls from numbered_sections) q, unnest(range(1, len(ls) + 1)) as u(pos)",
    rs=SQL_RESPLIT,
)

# ------------------------------------------------------------------ clauses

SQL_TL6 = f"""select doc_id, pos, text, {strip('text')} <> '' and (coalesce(h_head, false) or {rx('ht', '(?i)^(Article|Section|Clause|Part)' + chr(92) + 's+[0-9]+')}
    or {rx('ht', '(?i)^Part' + chr(92) + 's+[IVX]+')} or {rx('ht', '^제[ ]*[0-9]+[ ]*조')} or {rx('ht', '^[가-힣][.]' + chr(92) + 's')}) as hd from hinted"""
query(
    "wn6_split_clauses_text",
    lambda t: cl.split_clauses_text(
        t.numbered_sections.unionByName(t.sections.select(*t.numbered_sections.columns).withColumn("doc_id", F.col("doc_id") + 10_000_000)), "content"
    ).select("doc_id", "clause", F.md5("text").alias("h"), "needs_review"),
    f"""select doc_id, 'clause-' || row_number() over (partition by doc_id order by g) as clause, md5(case when head is null then body else head || chr(10) || body end) as h, false as needs_review from good
        union all select doc_id, 'clause-1', md5({strip("string_agg(text, chr(10) order by pos)")}), true from l6 where doc_id not in (select doc_id from good) group by doc_id""",
    lines0="""select doc_id, u.pos as pos, ls[u.pos] as text from (select doc_id, string_split(content, chr(10)) as ls from numbered_sections
        union all select doc_id + 10000000, string_split(content, chr(10)) from sections) q, unnest(range(1, len(ls) + 1)) as u(pos)""",
    hinted=hint("lines0", "text"),
    l6=SQL_TL6,
    good=f"""select doc_id, g, max({strip('text')}) filter (where hd) as head, {strip("string_agg(text, chr(10) order by pos) filter (where not hd)")} as body from (
        select *, sum(hd::int) over (partition by doc_id order by pos) as g from l6) a group by doc_id, g having coalesce(body, '') <> ''""",
)


#: Bytes of text in a file of a contract; a longer contract comes in several, as no file above 50 MB is accepted.
FILE_BYTES = 16 << 20


def contract_files(t, inbox, size=FILE_BYTES):
    """Files per contract, of the lines of its documents: of ten contracts one without the head of an accepted file, one without text."""
    sections = t.unstored("numbered_sections")
    lines = sections.select((F.col("doc_id") % 40).alias("contract"), "doc_id", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    lines = lines.where((F.trim("line") != "") & (F.col("contract") % 10 != 9))
    heads = sections.select((F.col("doc_id") % 40).alias("contract")).distinct().where("contract % 10 <> 8")
    rows = lines.unionByName(heads.select("contract", F.lit(-1).cast("long").alias("doc_id"), F.lit(0).alias("pos"), F.lit("%PDF-1.7").alias("line")))
    along = W.partitionBy("contract").orderBy("doc_id", "pos")
    before = F.sum(F.octet_length("line") + 1).over(along.rowsBetween(W.unboundedPreceding, -1))
    placed = rows.withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / size))
    # every further file begins with a head of its own
    opens = (F.col("part") > F.lag("part").over(along)) & (F.col("contract") % 10 != 8)
    placed = placed.withColumn("opens", opens)
    head = F.when(F.col("opens"), F.array(F.lit("%PDF-1.7"), F.col("line"))).otherwise(F.array("line"))
    each = placed.select("contract", F.format_string("%05d", "part").alias("part"), "doc_id", "pos", F.posexplode(head).alias("k", "line"))
    ordered = each.sortWithinPartitions("contract", "part", "doc_id", "pos", "k").select("contract", "part", "line")
    options = dict(extension="pdf", sep="\u0001", quote="\u0002", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    with no_shuffle_kept(t.spark):
        ordered.write.partitionBy("contract", "part").options(**options).csv(inbox)


def _st1_publish(t):
    inbox, sink = scratch_path(t.spark, "inbox"), scratch_path(t.spark, "intake")
    contract_files(t, inbox)
    number = F.regexp_extract("path", r"contract=(\d+)/", 1)
    st.publish_stream(t.spark, inbox, sink, contract=number).awaitTermination()
    read = lambda n: st.published(t.spark, sink, n)
    zones = read("document_zones").groupBy("contract_id").agg(F.count("*").alias("zones"), F.max("zone_type").alias("zone_type"))
    clauses = read("clauses").groupBy("contract_id").agg(F.count("*").alias("clauses"), F.sum(F.length("text")).alias("chars"), F.count_if("needs_review").alias("unsure"))
    out = read("contracts").select("contract_id", "status").join(zones, "contract_id", "left").join(clauses, "contract_id", "left")
    rejected = t.spark.read.parquet(f"{sink}/rejected").select("contract_id", F.col("reject_reason").alias("status")).distinct()
    every = out.unionByName(rejected, allowMissingColumns=True)
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.select("contract_id", "status", F.coalesce("zone_type", F.lit("")).alias("zone_type"), *(count(c) for c in ("zones", "clauses", "chars", "unsure")))


query(
    "st1_publish_stream",
    _st1_publish,
    f"""select c.contract as contract_id, case when c.contract % 10 = 8 then 'magic_pdf' when c.contract % 10 = 9 then 'error' when z.type in {NON_TARGET} then 'filtering' else 'ready' end as status,
          case when c.contract % 10 < 8 then z.type else '' end as zone_type, case when c.contract % 10 < 8 then 1 else 0 end as zones, coalesce(k.clauses, 0) as clauses, coalesce(k.chars, 0)::bigint as chars, coalesce(k.unsure, 0)::bigint as unsure
        from (select distinct doc_id % 40 as contract from numbered_sections) c left join (
          select doc_id, coalesce(part, 'contract_body') as type from (select *, {_sql_paragraph_part()} as part from headed) x) z on z.doc_id = c.contract
        left join (select doc_id, count(*) as clauses, sum(length(text)) as chars, sum(unsure) as unsure from (
          select doc_id, case when head is null then body else head || chr(10) || body end as text, 0 as unsure from good where doc_id % 10 < 8
          union all select doc_id, {strip("string_agg(text, chr(10) order by pos)")}, 1 from l6 where doc_id not in (select doc_id from good) and doc_id % 10 < 8 group by doc_id) q group by 1) k on k.doc_id = c.contract""",
    lines0="""select doc_id % 40 as doc_id, row_number() over (partition by doc_id % 40 order by doc_id, u.pos) as pos, ls[u.pos] as text
        from (select doc_id, string_split(content, chr(10)) as ls from numbered_sections) q, unnest(range(1, len(ls) + 1)) as u(pos) where trim(ls[u.pos]) <> '' and doc_id % 10 <> 9""",
    hinted=hint("lines0", "text"),
    l6=SQL_TL6,
    good=f"""select doc_id, g, max({strip('text')}) filter (where hd) as head, {strip("string_agg(text, chr(10) order by pos) filter (where not hd)")} as body from (
        select *, sum(hd::int) over (partition by doc_id order by pos) as g from l6) a group by doc_id, g having coalesce(body, '') <> ''""",
    firsts=f"select doc_id, {strip('text')} as heading, {strip('text')} as first_line from lines0 where pos = 1",
    headed=hint("firsts", "first_line"),
)
SQL_WI = f"""select *, zone = 'preamble' or coalesce((page_start, section_index) < fnum, false) as is_intro from (
    select *, min((page_start, section_index)) over (partition by contract_id, zone) as zfirst, min(case when hk is not null then (page_start, section_index) end) over (partition by contract_id, zone) as fnum
    from hinted where zone = 'preamble' or zone not in {NON_TARGET}) q"""
_INTRO_T = f"case when heading <> '' and {strip('content')} <> '' then heading || chr(10) || {strip('content')} when heading <> '' then heading else {strip('content')} end"
SQL_INTROS = f"""select contract_id, zone, zfirst, string_agg(nullif({_INTRO_T}, ''), {NL2} order by page_start, section_index) as content,
    arg_min(page_start, section_index) as page_start, case when zone = 'preamble' then 'preamble-1' else zone || '-intro' end as clause_number
    from wi where is_intro group by 1, 2, 3 having content is not null"""
SQL_ZS = "select *, coalesce(zone_hint, 'contract_body') as zone from mixed_sections"


def _wn11(t):
    intros, rest = cl.merge_zone_intros(t.mixed_sections)
    return intros.select("contract_id", "clause_number", "page_start", F.md5("content").alias("h")).unionByName(
        rest.select("contract_id", F.lit("rest").alias("clause_number"), "page_start", F.md5(F.concat("heading", "content")).alias("h"))
    )


query(
    "wn11_merge_zone_intros",
    _wn11,
    """select contract_id, clause_number, page_start, md5(content) as h from intros
       union all select contract_id, 'rest', page_start, md5(heading || content) from wi where not is_intro""",
    zs=SQL_ZS,
    hinted=hint("zs", "heading"),
    wi=SQL_WI,
    intros=SQL_INTROS,
)
SQL_PARENT = """case when a.hk is null then null
    when a.hk in ('rom', 'alp') then (select arg_max(b.h_norm, (b.page_start, b.section_index)) from {src} b where b.contract_id = a.contract_id and (b.page_start, b.section_index) < (a.page_start, a.section_index) and b.hk is not null and b.hk not in ('rom', 'alp'))
    when regexp_full_match(a.h_norm, '[0-9]+([.][0-9]+)+') then regexp_replace(a.h_norm, '[.][^.]*$', '')
    when a.h_level > 1 then (select arg_max(b.h_norm, b.h_level) from {src} b where b.contract_id = a.contract_id and (b.page_start, b.section_index) < (a.page_start, a.section_index)
      and b.h_level >= 1 and b.h_level < a.h_level and not exists (select 1 from {src} c where c.contract_id = a.contract_id and (c.page_start, c.section_index) < (a.page_start, a.section_index)
        and (c.page_start, c.section_index) > (b.page_start, b.section_index) and c.h_level <= b.h_level)) end"""
query(
    "wn19_with_parent_number",
    lambda t: cl.with_parent_number(
        nb.annotate_numbering(
            t.sections.withColumn("heading", F.expr("case when section_index = 14 then 'SECTION 3.1.2 x' when section_index = 22 then '14 days after ' || repeat('x', 80) else heading end")), "heading"
        )
    ).select("contract_id", "section_index", F.coalesce("parent_clause_number", F.lit("")).alias("parent")),
    f"select contract_id, section_index, coalesce({SQL_PARENT.format(src='hs')}, '') as parent from hs a",
    hs0="select * replace (case when section_index = 14 then 'SECTION 3.1.2 x' when section_index = 22 then '14 days after ' || repeat('x', 80) else heading end as heading) from sections",
    hs=hint("hs0", "heading"),
)

_GH1 = f"regexp_replace(content, '{ln.HEADER_AND_RULE}', chr(2) || '\\1' || chr(2), 'g')"
_GH2 = f"""array_to_string(list_transform(range(1, len(p1) + 1), lambda k: case when k % 2 = 0
     then array_to_string(list_filter(list_transform(string_split(p1[k], '|'), lambda v: {strip('v')}), lambda v: v <> ''), ' ') else p1[k] end), '')"""
_GIN = ex("p2[k]", r"(?s)^\|([^|]+(?:\|[^|]+)?)\|", 1)
_GH3 = f"""array_to_string(list_transform(range(1, len(p2) + 1), lambda k: case when k % 2 = 0 and length({strip(_GIN)}) >= 20
     then array_to_string(list_transform(string_split({_GIN}, '|'), lambda v: {strip('v')}), ' ') else p2[k] end), '')"""
_REFLOW = f"""array_to_string(list_transform(range(1, len(ls) + 1), lambda k: case
      when k = 1 then case when {strip('ls[1]')} = '' then '' else ls[1] end when {strip('ls[k]')} = '' then chr(10)
      when {strip('ls[k - 1]')} = '' or {rx('ls[k]', ln.REFLOW_MARKER)} or starts_with({strip('ls[k]')}, '|') or {rx('ls[k]', ln.BOLD_LINE)}
        or ({rx('ls[k - 1]', '[.;:]' + chr(92) + 's*$')} and {rx('ls[k]', '^' + chr(92) + 's*' + chr(92) + '([^)]{5,}')}) then chr(10) || ls[k]
      else ' ' || {strip('ls[k]')} end), '')"""
SQL_CLEAN = f"""select * exclude (ls), {_REFLOW} as content from (select * exclude (p2), string_split(regexp_replace({_GH3}, '\\n{{3,}}', {NL2}, 'g'), chr(10)) as ls from (
    select * exclude (p1), string_split(regexp_replace(regexp_replace({_GH2}, '{ln.RULE_ONLY}', '', 'g'), '{ln.LONE_ROW}', chr(2) || '\\0' || chr(2), 'g'), chr(2)) as p2
    from (select * exclude (content), string_split({_GH1}, chr(2)) as p1 from raw_clauses) a) b) c"""
_PR = rest_case("pt", "pk")
SQL_RAW = f"""select contract_id, row_number() over (partition by contract_id order by zfirst) - 1 as order_index, clause_number, null as parent_clause_number, null as title, content,
      false as is_auto_split, zone as zone_key, page_start, 'unnumbered' as clause_structure from intros
    union all
    select contract_id, st, coalesce(h_norm, coalesce(zone_hint, 'general') || case when heading <> '' then '-' else '-auto-' end || cast(st + 1 as varchar)), parent,
      substr(case when k = 'body' then null when k = 'title' then case when starts_with(rm, '[') then {strip(rep(rep('rm', '^' + chr(92) + '['), chr(92) + ']$'))} else rm end when heading <> '' then heading end, 1, 200),
      case when k = 'body' then {strip('heading || chr(10) || bd')} else bd end, heading = '', zone_hint, page_start,
      case k when 'body' then 'numbered_untitled' when 'title' then 'numbered_titled' else 'unnumbered' end
    from (select *, case when heading <> '' and hk is not null then {remainder_kind('rest')} end as k, case when rest <> '' then rest else heading end as rm from placed where n_sub is null) x
    union all
    select p.contract_id, p.st + r.sub, r.number, regexp_replace(r.number, '[.][^.]*$', ''), case when {remainder_kind('pr')} = 'title' then substr(case when pr <> '' then pr else pl end, 1, 120) end,
      r.body, true, coalesce(p.zone_hint, 'general_conditions'), p.page_start, case when {remainder_kind('pr')} = 'title' then 'numbered_titled' else 'numbered_untitled' end
    from placed p join (select *, {_PR} as pr from (select *, {kind_case('pt')} as pk from (select *, split_part(body, chr(10), 1) as pl, {strip("split_part(body, chr(10), 1)")} as pt from rs) a) b) r on r.doc_id = p.doc_id"""
SHAPE_CTES = dict(
    zs=SQL_ZS,
    hinted=hint("zs", "heading"),
    wi=SQL_WI,
    intros=SQL_INTROS,
    rl="select doc_id, u.pos - 1 as pos, ls[u.pos] as text from (select doc_id, string_split(" + strip("content") + ", chr(10)) as ls from wi where not is_intro) q, unnest(range(1, len(ls) + 1)) as u(pos)",
    rs=SQL_RESPLIT,
    todo=f"""select w.*, {strip('content')} as bd, n_sub from wi w left join (select doc_id, count(*) as n_sub from rs group by 1) r on r.doc_id = w.doc_id
        where not is_intro and ({strip('content')} <> '' or heading <> '')""",
    placed=f"""select a.*, {SQL_PARENT.format(src='todo')} as parent, coalesce((select count(*) from intros i where i.contract_id = a.contract_id), 0)
        + sum(coalesce(n_sub, 1)) over (partition by contract_id order by page_start, section_index) - coalesce(n_sub, 1) as st from todo a""",
    raw_clauses=SQL_RAW,
    shaped=SQL_CLEAN,
)
query(
    "sc14_shape_clauses",
    lambda t: cl.shape_clauses(t.mixed_sections).select(
        "contract_id", "order_index", "clause_number", F.coalesce("parent_clause_number", F.lit("")).alias("parent"), F.coalesce("title", F.lit("")).alias("title"),
        F.md5("content").alias("h"), "is_auto_split", F.coalesce("zone_key", F.lit("")).alias("zone_key"), "page_start", "clause_structure",
    ),
    """select contract_id, order_index::bigint as order_index, clause_number, coalesce(parent_clause_number, '') as parent, coalesce(title, '') as title, md5(content) as h, is_auto_split,
         coalesce(zone_key, '') as zone_key, page_start, clause_structure from shaped""",
    **SHAPE_CTES,
)
query(
    "ag12_quality_rules",
    lambda t: cl.quality_rules(
        t.clauses.withColumns({"needs_review": F.expr("needs_review and contract_id % 3 = 0"), "text": F.expr("case when contract_id % 4 = 1 then text else repeat(text || ' ', 30) end")})
    ),
    f"""select contract_id, count(*) not between 1 and 1500 or bool_or(length({strip("case when contract_id % 4 = 1 then text else repeat(text || ' ', 30) end")}) < 100)
          or bool_or(needs_review and contract_id % 3 = 0) as needs_review from clauses group by 1""",
)
query(
    "ag13_document_review_flag",
    lambda t: cl.document_review_flag(
        t.contracts.select("contract_id", (F.col("contract_id") % 5 == 0).alias("needs_review")),
        t.contracts.select("contract_id", F.when(F.col("contract_id") % 3 > 0, (F.col("contract_id") % 7) / 4.0 - 0.3).alias("score")),
        apart(t.zones.where("not is_analysis_target"), "contract_id", "contract_id % 11 <> 4"),
    ),
    """select contract_id, contract_id % 5 = 0 or (contract_id % 3 > 0 and least(1.0, greatest(0.0, (contract_id % 7) / 4.0 - 0.3)) < 0.5) or contract_id % 11 = 4 as needs_review from contracts""",
)
query(
    "ag14_dominant_language",
    lambda t: cl.dominant_language(t.clauses, cl.language_profiles(t.base("documents"))),
    """select contract_id, arg_max(lang, (sc, lang)) as lang from (select c.contract_id, p.lang, sum(c.n * p.weight) as sc from (
         select contract_id, gram, count(*) as n from (select contract_id, ch[u.k] || ch[u.k + 1] || ch[u.k + 2] as gram from (select contract_id, string_split(string_agg(lower(coalesce(text, '')) || chr(10), '' order by sort_order, clause_id), '') as ch from clauses group by 1) q,
           unnest(range(1, len(ch) - 1)) as u(k)) g group by 1, 2) c join prof p on p.gram = c.gram group by 1, 2) s group by 1""",
    grams="select lang, gram, count(*) as n from (select lang, ch[u.k] || ch[u.k + 1] || ch[u.k + 2] as gram from (select lang, string_split(lower(text), '') as ch from documents) q, unnest(range(1, len(ch) - 1)) as u(k)) g group by 1, 2",
    prof="select lang, gram, n::double / sum(n) over (partition by lang) as weight from grams",
)
query(
    "ag25_duplicate_census",
    lambda t: da.duplicate_census(t.clauses.withColumn("content_hash", tx.content_hash(F.col("text")))),
    f"select sha256({ws('text')}) as content_hash, count(*) as n from clauses group by 1",
)
query(
    "tk4_quality_preview",
    lambda t: da.quality_preview(t.clauses).select("contract_id", F.md5("preview").alias("h")),
    """select contract_id, md5(string_agg(k || '. [' || length(text) || 'ch] ' || substr(text, 1, 30), chr(10) order by k)) as h from (
         select *, row_number() over (partition by contract_id order by sort_order, clause_id) as k from clauses) x where k <= 8 group by 1""",
)
query(
    "tk5_order_sections",
    lambda t: da.order_sections(t.sections.withColumn("page_start", F.expr("cast((section_index * 7) % 11 + 1 as int)"))).select("contract_id", "section_index", "order_index"),
    "select contract_id, section_index, row_number() over (partition by contract_id order by (section_index * 7) % 11, section_index) - 1 as order_index from sections",
)
