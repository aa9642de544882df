"""Sources, sinks, filters, joins, set operations and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import dashboards as da
from paperloom.operators import filters as fl
from paperloom.operators import joins as jn
from paperloom.plans.scratch import scratch_path
from paperloom.sources import sinks as sk
from paperloom.sources import tables as src

from .registry import apart, query
from .sqltext import NON_TARGET, strip

STATUS_IN_PROGRESS = "('analyzing', 'parsing', 'filtering', 'partial')"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# ------------------------------------------------------------------ sources

query(
    "src1_validate_files",
    lambda t: src.validate_files(t.files.withColumn("head", F.encode("head", "UTF-8"))).select(
        "page_id", "accepted", F.coalesce("reject_reason", F.lit("")).alias("reject_reason")
    ),
    """select page_id, r = '' as accepted, r as reject_reason from (select page_id, case
         when not (ends_with(lower(name), '.pdf') or ends_with(lower(name), '.docx')) then 'extension'
         when length < 1 or length > 52428800 then 'size'
         when ends_with(lower(name), '.pdf') and not starts_with(head, '%PDF') then 'magic_pdf'
         when ends_with(lower(name), '.docx') and not starts_with(head, 'PK') then 'magic_docx' else '' end as r from files) x""",
)


def _nested_sections(t):
    item = F.struct("section_index", "heading", "level", "content", "page_start", "page_end", "zone_hint", "is_toc")
    sections = t.sections.groupBy("contract_id").agg(F.array_sort(F.collect_list(item)).alias("sections"))
    part = F.struct("part_index", "part_type", "title", "page_start", "page_end", F.col("section_count").cast("int").alias("section_count"))
    parts = t.parts.groupBy("contract_id").agg(F.array_sort(F.collect_list(part)).alias("document_parts"))
    return sections.join(parts, "contract_id")


def _src2(t):
    path = scratch_path(t.spark, "parses")
    _nested_sections(t).write.json(path)
    tables = src.read_parse_results(t.spark, path)
    sections = tables["sections"].select(
        "contract_id", F.lit("section").alias("kind"), F.col("section_index").alias("idx"), "heading", F.md5("content").alias("body"), "page_start", "page_end"
    )
    parts = tables["parts"].select(
        "contract_id", F.lit("part").alias("kind"), F.col("part_index").alias("idx"), F.col("title").alias("heading"), F.md5("part_type").alias("body"), "page_start", "page_end"
    )
    return sections.unionByName(parts)


query(
    "src2_read_parse_results",
    _src2,
    """select contract_id, 'section' as kind, section_index as idx, heading, md5(content) as body, page_start, page_end from sections
       union all select contract_id, 'part', part_index, title, md5(part_type), page_start, page_end from parts""",
)


def _src3(t):
    path = scratch_path(t.spark, "pages")
    item = F.struct("y0", "x0", "ord", "text", "x1", "y1", "font_size", "is_bold")
    t.page_lines.groupBy("contract_id", "page", F.col("page_height").alias("height")).agg(
        F.array_sort(F.collect_list(item)).alias("lines")
    ).write.parquet(path)
    return src.read_page_lines(t.spark, path).select("contract_id", "page", "line_no", "text", "y0", "font_size")


query(
    "src3_read_page_lines",
    _src3,
    """select contract_id, page, row_number() over (partition by contract_id, page order by y0, x0, ord) - 1 as line_no, text, y0, font_size
       from page_lines""",
)


def _items(t):
    words = t.page_lines.select(
        "contract_id", "page", "ord", "x0", "y0", "page_height", "font_size", "is_bold",
        F.posexplode(F.split("text", " ")).alias("k", "text"),
    ).where("text != ''")
    return words.select(
        "contract_id",
        "page",
        "page_height",
        (F.col("ord") * 100_000 + F.col("k")).alias("seq"),
        "text",
        (F.col("x0") + F.col("k") * 30).alias("tx"),
        (F.col("page_height") - F.col("y0") - F.col("font_size") + (F.col("k") % 4) * 0.9).alias("ty"),
        (F.length("text") * 5.0).alias("width"),
        "font_size",
        F.when(F.col("is_bold"), "Helvetica-Bold").otherwise("Helvetica").alias("font_name"),
    )


query(
    "src4_words_to_lines",
    lambda t: src.words_to_lines(_items(t)).select(
        "contract_id", "page", "line_no", "text", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1", "font_size")), "is_bold"
    ),
    # the fold over a page, word by word
    f"""select contract_id, page, line as line_no, {strip("string_agg(w, ' ' order by tx, seq)")} as text, round(min(tx), 6)::double as x0, round(min(page_height - ty - font_size), 6)::double as y0,
          round(max(tx + length(w) * 5.0), 6)::double as x1, round(max(page_height - ty + font_size * 0.2), 6)::double as y1, round(avg(font_size), 6)::double as font_size, avg(is_bold::int) >= 0.5 as is_bold
        from (with recursive o as (select *, row_number() over (partition by contract_id, page order by -ty, tx, seq) as rn from items),
          rec as (select o.*, ty as anchor, 0 as line from o where rn = 1
            union all select o.*, case when abs(o.ty - r.anchor) <= greatest(2.0, o.font_size * 0.4) then r.anchor else o.ty end,
              case when abs(o.ty - r.anchor) <= greatest(2.0, o.font_size * 0.4) then r.line else r.line + 1 end
            from rec r join o on o.contract_id = r.contract_id and o.page = r.page and o.rn = r.rn + 1)
          select * from rec) x
        group by contract_id, page, line having {strip("string_agg(w, ' ' order by tx, seq)")} <> ''""",
    items="""select contract_id, page, page_height::double as page_height, font_size::double as font_size, is_bold, ord * 100000 + k - 1 as seq, ws[k] as w, x0 + (k - 1) * 30 as tx,
        page_height - y0 - font_size + ((k - 1) % 4) * 0.9::double as ty
      from (select *, unnest(range(1, len(ws) + 1)) as k from (select *, string_split(text, ' ') as ws from page_lines) a) b where ws[k] <> ''""",
)

query(
    "src5_split_text_lines",
    lambda t: src.split_text(t.base("documents")).select("doc_id", "pos", "text"),
    f"""select doc_id, u.pos - 1 as pos, ls[u.pos] as text from
        (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: {strip('x')}), lambda x: x <> '') as ls
         from documents) q, unnest(range(1, len(ls) + 1)) as u(pos)""",
)
query(
    "src5_split_text_paragraphs",
    lambda t: src.split_text(
        t.base("documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))), "paragraph"
    ).select("doc_id", "pos", F.md5("text").alias("h")),
    f"""select doc_id, u.pos - 1 as pos, md5(ls[u.pos]) as h from
        (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') as ls
         from documents) q, unnest(range(1, len(ls) + 1)) as u(pos)""",
)
query(
    "src6_read_table",
    lambda t: src.read_table(
        t.spark,
        f"{t.folder}/events.parquet",
        ["event_id", "user_id", "event_type", "value"],
        {"event_type": "click"},
        ["user_id", "event_id"],
    ),
    "select event_id, user_id, event_type, value from events where event_type = 'click'",
)


def _src7(t):
    cols = ["contract_id", "section_index", "page_start", "page_end"]
    s = t.sections.select(*cols)
    shift = lambda df, off: df.withColumns({c: F.col(c) - off for c in ("page_start", "page_end")})
    batches = [
        s.where("section_index < 9"),
        shift(s.where("section_index between 9 and 16"), 13),
        None,
        shift(s.where("section_index > 16"), 25),
    ]
    return src.merge_batches(batches, [0, 13, 20, 25])


query("src7_merge_batches", _src7, "select contract_id, section_index, page_start, page_end from sections")

# ------------------------------------------------------------------ sinks


def _snk1(t):
    path = scratch_path(t.spark, "published")
    zones = t.zones.withColumn("page_from", F.expr("case when contract_id % 11 = 3 and zone_index = 2 then null else page_from end"))
    sk.publish_contract_tables(t.contracts, zones, t.clauses, path)
    read = lambda n: t.spark.read.parquet(f"{path}/{n}")
    n_zones = read("document_zones").groupBy("contract_id").agg(F.count("*").alias("zones"))
    n_clauses = read("clauses").groupBy("contract_id").agg(F.count("*").alias("clauses"))
    out = read("contracts").join(n_zones, "contract_id", "left").join(n_clauses, "contract_id", "left")
    return out.select("contract_id", "status", F.coalesce("zones", F.lit(0)).alias("zones"), F.coalesce("clauses", F.lit(0)).alias("clauses"))


query(
    "snk1_publish_contract_tables",
    _snk1,
    """select c.contract_id, case when c.contract_id % 11 = 3 then 'error' when u.n > 0 then 'filtering' else 'ready' end as status,
         case when c.contract_id % 11 = 3 then 0 else z.n end as zones, case when c.contract_id % 11 = 3 then 0 else k.n end as clauses
       from contracts c join (select contract_id, count(*) as n from zones group by 1) z using (contract_id)
       join (select contract_id, count(*) as n from clauses group by 1) k using (contract_id)
       left join (select contract_id, count(*) as n from zones where not is_analysis_target group by 1) u using (contract_id)""",
)
query(
    "snk2_latest_status",
    lambda t: sk.latest_status(t.status_events).select("contract_id", "status", stamp("ts").alias("ts")),
    f"""select contract_id, status, {sql_stamp('ts')} as ts from (select *, row_number() over (partition by contract_id order by ts desc, seq desc) as k
        from status_events) x where k = 1""",
)


def _snk3(t):
    left = sk.cascade_delete(
        {"contracts": t.contracts, "zones": t.zones, "clauses": t.clauses, "analyses": t.analyses},
        t.contracts.where("user_id = 3"),
    )
    rows = [
        df.agg(F.count("*").alias("n"), F.sum(key).alias("key_sum")).select(F.lit(name).alias("tbl"), "n", "key_sum")
        for name, df, key in [
            ("contracts", left["contracts"], "contract_id"),
            ("zones", left["zones"], "zone_id"),
            ("clauses", left["clauses"], "clause_id"),
            ("analyses", left["analyses"], "clause_id"),
        ]
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


query(
    "snk3_cascade_delete",
    _snk3,
    """select 'contracts' as tbl, count(*) as n, sum(contract_id)::bigint as key_sum from contracts where user_id <> 3
       union all select 'zones', count(*), sum(zone_id)::bigint from zones where contract_id % 7 <> 3
       union all select 'clauses', count(*), sum(clause_id)::bigint from clauses where contract_id % 7 <> 3
       union all select 'analyses', count(*), sum(clause_id)::bigint from analyses a
         where not exists (select 1 from clauses c where c.clause_id = a.clause_id and c.contract_id % 7 = 3)""",
)


def _toc_table(t):
    return t.sections.select(
        "contract_id",
        F.col("section_index").alias("entry_index"),
        F.col("heading").alias("title"),
        F.col("page_start").alias("page_number"),
        "level",
        F.lit(None).cast("string").alias("numbering"),
    )


query(
    "snk4_nest_parts",
    lambda t: sk.nest_parts(t.contracts, t.parts, _toc_table(t), t.subdocs).select(
        "contract_id",
        F.array_join(F.col("document_parts.title"), ",").alias("part_titles"),
        F.size("toc_entries").alias("n_toc"),
        F.array_join(F.transform("sub_documents", lambda s: s["page_end"].cast("string")), ",").alias("sub_ends"),
    ),
    """select c.contract_id, p.x as part_titles, e.n as n_toc, s.x as sub_ends from contracts c
       join (select contract_id, string_agg(title, ',' order by part_index) as x from parts group by 1) p using (contract_id)
       join (select contract_id, count(*) as n from sections group by 1) e using (contract_id)
       join (select contract_id, string_agg(cast(page_end as varchar), ',' order by subdoc_index) as x from subdocs group by 1) s using (contract_id)""",
)
query(
    "snk5_comparison_report",
    lambda t: sk.comparison_report(t.clauses, t.analyses),
    """select c.contract_id, c.clause_id, c.no, coalesce(title, number, '조항 ' || cast(c.no as varchar)) as title,
         coalesce(a.risk_level, '-') as risk_level, coalesce(a.comparison, '') as comparison
       from (select *, row_number() over (partition by contract_id order by sort_order, clause_id) as no from clauses) c
       left join analyses a using (clause_id)""",
)


def _word_tables(t):
    """Word grids of the documents: a row per line, up to three cells, some bracketed."""
    cells = F.transform(
        F.split("text", "\n"),
        lambda x: F.transform(
            F.slice(F.split(x, " "), 1, (F.col("doc_id") % 4).cast("int")),
            lambda w: F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("["), w)).when(w.contains("x"), None).otherwise(w),
        ),
    )
    return t.base("documents").select("doc_id", cells.alias("rows"))


SQL_GRID = """select doc_id, list_transform(string_split(text, chr(10)), lambda x: list_transform(string_split(x, ' ')[1:cast(doc_id % 4 as int)],
      lambda w: case when doc_id % 7 = 0 then '[' || w when contains(w, 'x') then null else w end)) as grid from documents"""

query(
    "snk6_table_to_markdown",
    lambda t: sk.table_to_markdown(_word_tables(t), "rows").select("doc_id", F.md5("markdown").alias("h")),
    """select doc_id, md5(array_to_string(lines[1:1] || ['| ' || array_to_string(list_transform(range(0, len(grid[1])), lambda k: '---'), ' | ') || ' |']
         || lines[2:], chr(10))) as h
       from (select doc_id, grid, list_transform(grid, lambda r: '| ' || array_to_string(list_transform(r, lambda w: trim(coalesce(w, ''))), ' | ') || ' |') as lines from g) x""",
    g=SQL_GRID,
)

# ------------------------------------------------------------------ filters

query(
    "flt1_with_analysis_target",
    lambda t: fl.with_analysis_target(t.clauses, "zone_key").select("clause_id", "is_target"),
    f"select clause_id, zone_key is null or zone_key not in {NON_TARGET} as is_target from clauses",
)
query(
    "flt2_is_target_whitelisted",
    lambda t: fl.is_target_whitelisted(t.clauses, "zone_key", "display")
    .withColumnRenamed("is_target", "display")
    .transform(lambda d: fl.is_target_whitelisted(d, "zone_key", "confidence"))
    .select("clause_id", "display", F.col("is_target").alias("sure")),
    """select clause_id, coalesce(zone_key in ('contract_agreement', 'general_conditions', 'particular_conditions', 'conditions_of_contract',
         'commercial_terms', 'definitions', 'letter_of_acceptance'), false) as display,
         coalesce(zone_key in ('contract_agreement', 'general_conditions', 'particular_conditions', 'conditions_of_contract',
         'commercial_terms', 'definitions'), false) as sure from clauses""",
)


def _flt3(t):
    sure, unsure = fl.split_by_confidence(t.zones)
    return sure.select("zone_id", F.lit("target").alias("side")).unionByName(unsure.select("zone_id", F.lit("uncertain").alias("side")))


query("flt3_split_by_confidence", _flt3, "select zone_id, case when confidence >= 0.7 then 'target' else 'uncertain' end as side from zones")
query(
    "flt4_uncertain_zones",
    lambda t: fl.uncertain_zones(t.zones),
    """select zone_id as id, zone_type as type, confidence, substr(text, 1, 200) || case when length(text) > 200 then '…' else '' end as preview,
         page_from, page_to from zones where not is_analysis_target and user_confirmed is null""",
)
query(
    "flt5_apply_zone_decisions",
    lambda t: fl.apply_zone_decisions(t.zones, t.zones.where("zone_id % 3 = 0"), t.zones.where("zone_id % 4 = 0")).select(
        "zone_id", "is_analysis_target", F.coalesce(F.col("user_confirmed").cast("string"), F.lit("none")).alias("user_confirmed")
    ),
    """select zone_id, case when zone_id % 4 = 0 then false when zone_id % 3 = 0 then true else is_analysis_target end as is_analysis_target,
         case when zone_id % 4 = 0 or zone_id % 3 = 0 then 'true' else coalesce(cast(user_confirmed as varchar), 'none') end as user_confirmed from zones""",
)
query(
    "flt5_status_after_decisions",
    lambda t: fl.status_after_decisions(t.contracts, t.zones.where("zone_id % 13 = 0")).select("contract_id", "status"),
    """select contract_id, case when exists (select 1 from zones z where z.contract_id = c.contract_id and z.zone_id % 13 = 0)
         then 'ready' else status end as status from contracts c""",
)
query(
    "flt6_analysable_clauses",
    lambda t: fl.analysable_clauses(t.clauses).select("clause_id", F.coalesce("zone_key", F.lit("")).alias("zone_key")),
    "select clause_id, coalesce(zone_key, '') as zone_key from clauses where zone_key is null or zone_key not in ('preamble', 'cover_page', 'toc')",
)
query(
    "flt7_filter_clauses",
    lambda t: fl.filter_clauses(jn.with_analyses(t.clauses, t.analyses), "HIGH", "general_conditions", "The").select("clause_id", "risk_level"),
    """select c.clause_id, a.risk_level from clauses c join analyses a using (clause_id)
       where upper(a.risk_level) = 'HIGH' and (zone_key is null or zone_key = 'general_conditions')
         and (contains(lower(text), 'the') or contains(lower(coalesce(title, '')), 'the') or contains(lower(coalesce(number, '')), 'the'))""",
)
query(
    "flt8_filter_contracts",
    lambda t: fl.filter_contracts(t.contracts, "in_progress", " Contract-1 ", t.contracts.where("contract_id % 5 = 2")).select("contract_id", "status"),
    f"select contract_id, status from contracts where status in {STATUS_IN_PROGRESS} and contains(lower(name), 'contract-1') and contract_id % 5 <> 2",
)


def _flt9(t):
    frames = [
        (name, fl.visible_rows(df, t.contracts, 2, role, t.clauses))
        for role in ("authenticated", "service_role")
        for name, df in [("contracts", t.contracts), ("zones", t.zones), ("clauses", t.clauses), ("analyses", t.analyses)]
    ]
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(f"{name}-{k // 4}").alias("tbl"), "n") for k, (name, df) in enumerate(frames)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


query(
    "flt9_visible_rows",
    _flt9,
    """select 'contracts-0' as tbl, count(*) as n from contracts where user_id = 2
       union all select 'zones-0', count(*) from zones where contract_id in (select contract_id from contracts where user_id = 2)
       union all select 'clauses-0', count(*) from clauses where contract_id in (select contract_id from contracts where user_id = 2)
       union all select 'analyses-0', count(*) from analyses where clause_id in
         (select clause_id from clauses where contract_id in (select contract_id from contracts where user_id = 2))
       union all select 'contracts-1', count(*) from contracts union all select 'zones-1', count(*) from zones
       union all select 'clauses-1', count(*) from clauses union all select 'analyses-1', count(*) from analyses""",
)
query(
    "flt10_with_status_class",
    lambda t: fl.with_status_class(t.contracts).select("contract_id", "in_progress", "done", "stage"),
    f"""select contract_id, status in {STATUS_IN_PROGRESS} as in_progress, status in ('ready', 'partial', 'error') as done,
         case status when 'parsing' then 2 when 'quality_checking' then 3 when 'filtering' then 5 when 'ready' then 6 when 'partial' then 6
           when 'error' then 5 else 1 end as stage from contracts""",
)
query(
    "flt11_with_auto_number_flag",
    lambda t: fl.with_auto_number_flag(t.clauses).select("clause_id", "is_auto_number"),
    """select clause_id, coalesce(number, '') = '' or contains(number, '-auto-') or starts_with(number, 'preamble') or ends_with(number, '-intro')
         or regexp_full_match(number, '[a-z_]+-[0-9]+') as is_auto_number from clauses""",
)
query(
    "flt12_with_confidence_band",
    lambda t: fl.with_confidence_band(t.zones).select("zone_id", "band"),
    "select zone_id, case when confidence >= 0.9 then 'high' when confidence >= 0.82 then 'medium' else 'low' end as band from zones",
)
query(
    "flt14_drop_lines_in_tables",
    lambda t: fl.drop_lines_in_tables(t.page_lines, t.table_boxes).select("contract_id", "page", "ord"),
    """select contract_id, page, ord from page_lines l where not exists (select 1 from table_boxes b where b.contract_id = l.contract_id
         and b.page = l.page and l.x0 >= b.x0 - 2 and l.y0 >= b.y0 - 2 and l.x1 <= b.x1 + 2 and l.y1 <= b.y1 + 2)""",
)
query(
    "flt15_drop_ghost_tables",
    lambda t: fl.drop_ghost_tables(_word_tables(t)).select("doc_id"),
    """select doc_id from (select doc_id, len(grid) as nr, list_max(list_transform(grid, lambda r: len(r))) as nc,
         list_filter(list_transform(flatten(grid), lambda w: trim(w)), lambda w: w is not null) as cells from g) x
       where nr > 1 and nc > 1 and length(array_to_string(cells, ' ')) >= 15
         and not (len(list_filter(cells, lambda w: w <> '')) > 0 and
           len(list_filter(cells, lambda w: w <> '' and (starts_with(w, '[') or ends_with(w, ']'))))::double / len(list_filter(cells, lambda w: w <> '')) > 0.5)""",
    g=SQL_GRID,
)


def _scan_pages(t):
    return t.doc.select("contract_id", F.col("i").alias("page"), F.expr("case when contract_id % 8 = 1 then '  ' || lang else text end").alias("text"))


query(
    "flt16_detect_scans",
    lambda t: fl.detect_scans(_scan_pages(t), apart(t.sections, "contract_id", "contract_id % 4 = 1")).select(
        "contract_id", F.round("avg_words", 4).alias("avg_words"), "is_scan"
    ),
    f"""select contract_id, round(a, 4) as avg_words, a < 10 as is_scan from (select contract_id,
          sum(len(regexp_split_to_array({strip('tx')}, '\\s+')))::double / count(*) as a
        from (select contract_id, i, case when contract_id % 8 = 1 then '  ' || lang else text end as tx from doc) d
        where contract_id % 4 = 1 group by 1) x""",
)
query(
    "flt17_risk_level",
    lambda t: t.analyses.select(
        "clause_id", fl.risk_level(F.expr("case when clause_id % 3 = 0 then upper(risk_level) when clause_id % 3 = 1 then risk_level end"), F.col("risk_summary")).alias("level")
    ),
    """select clause_id, case when clause_id % 3 = 1 then risk_level when regexp_matches(lower(risk_summary), '\\bhigh\\b') then 'high'
         when regexp_matches(lower(risk_summary), '\\bmedium\\b') then 'medium' when regexp_matches(lower(risk_summary), '\\blow\\b') then 'low'
         else 'info' end as level from analyses""",
)

# ------------------------------------------------------------------ joins

query(
    "jn1_with_analyses",
    lambda t: jn.with_analyses(t.clauses, t.analyses).select("clause_id", F.coalesce("risk_level", F.lit("")).alias("risk_level")),
    "select c.clause_id, coalesce(a.risk_level, '') as risk_level from clauses c left join analyses a using (clause_id)",
)
query(
    "jn2_with_zone_key",
    lambda t: jn.with_zone_key(t.clauses, apart(t.zones, "zone_id", "zone_index = 3")).select("clause_id", "zone"),
    """select c.clause_id, coalesce(z.zone_type, c.zone_key, 'unknown') as zone from clauses c
       left join (select * from zones where zone_index <> 3) z on z.zone_id = c.zone_id""",
)
query(
    "jn3_assign_zone",
    lambda t: jn.assign_zone(t.clauses.drop("zone_index"), apart(t.zones, "contract_id", "zone_index = 2")).select("clause_id", "zone_index"),
    """select c.clause_id, coalesce((select min(zone_index) from zones z where z.contract_id = c.contract_id and zone_index <> 2
           and c.page_start between z.page_from and z.page_to),
         (select min(zone_index) from zones z where z.contract_id = c.contract_id and zone_index <> 2 and z.zone_type = c.zone_key), 0) as zone_index
       from clauses c""",
)
query(
    "jn4_label_zones",
    lambda t: jn.label_zones(t.zones, t.parts, t.subdocs).select(
        "zone_id", F.coalesce("part_title", F.lit("")).alias("part_title"), F.coalesce("subdoc_title", F.lit("")).alias("subdoc_title")
    ),
    """select zone_id, coalesce((select arg_min(title, part_index) from parts p where p.contract_id = z.contract_id and z.page_from between p.page_start and p.page_end), '') as part_title,
         coalesce((select arg_min(title, subdoc_index) from subdocs s where s.contract_id = z.contract_id and z.page_from between s.page_start and s.page_end), '') as subdoc_title
       from zones z""",
)
query(
    "jn5_label_clauses",
    lambda t: jn.label_clauses(t.clauses, t.zones, t.subdocs).select("clause_id", F.coalesce("subdoc_title", F.lit("")).alias("subdoc_title")),
    """select c.clause_id, coalesce(s.title, '') as subdoc_title from clauses c join zones z on z.zone_id = c.zone_id
       left join subdocs s on s.contract_id = c.contract_id and z.page_from between s.page_start and s.page_end
       qualify row_number() over (partition by c.clause_id order by s.subdoc_index) = 1""",
)
query(
    "jn6_zone_text",
    lambda t: jn.zone_text(t.parts, t.sections).select("contract_id", "part_index", F.md5(F.coalesce("text", F.lit(""))).alias("h")),
    f"""select p.contract_id, p.part_index, md5(coalesce(string_agg(nullif(s.tx, ''), chr(10) || chr(10) order by s.section_index), '')) as h
        from parts p left join (select *, {strip("case when heading <> '' then heading || chr(10) || content else content end")} as tx from sections) s
          on s.contract_id = p.contract_id and s.page_start >= p.page_start and s.page_end <= p.page_end
        group by 1, 2""",
)
query(
    "jn7_pending_clauses",
    lambda t: jn.pending_clauses(t.clauses, t.analyses).select("clause_id"),
    "select clause_id from clauses where clause_id not in (select clause_id from analyses)",
)
query(
    "jn8_owned",
    lambda t: jn.owned(t.clauses, t.contracts, 4).select("clause_id"),
    "select clause_id from clauses where contract_id in (select contract_id from contracts where user_id = 4)",
)
query(
    "jn12_resolve_zone_id",
    lambda t: jn.resolve_zone_id(t.clauses.withColumn("zone_index", F.col("zone_index") + F.expr("case when sort_order % 10 = 9 then 7 else 0 end")), t.zones).select("clause_id", "zone_id"),
    "select clause_id, contract_id * 10 + case when sort_order % 10 = 9 then 0 else zone_index end as zone_id from clauses",
)
query(
    "jn16_orphan_rows",
    lambda t: jn.orphan_rows(t.clauses, apart(t.zones, "zone_id", "zone_id % 4 = 1"), "zone_id").select("clause_id", "zone_id"),
    "select clause_id, zone_id from clauses where zone_id % 4 = 1",
)

# ------------------------------------------------------------------ set operations


def _zone_rows(t):
    return t.zones.select("contract_id", "zone_index", "page_from", "page_to", "zone_type", "confidence", "is_analysis_target", "text").withColumn(
        "zone_type", F.expr("case when contract_id % 4 = 0 and zone_index = 1 then 'preamble' else zone_type end")
    )


query(
    "set1_add_preamble_zone",
    lambda t: jn.add_preamble_zone(_zone_rows(t), t.sections).select(
        "contract_id", "zone_index", "page_from", "page_to", "zone_type", "confidence", F.md5("text").alias("h")
    ),
    f"""select contract_id, zone_index, page_from, page_to, case when contract_id % 4 = 0 and zone_index = 1 then 'preamble' else zone_type end as zone_type,
          confidence, md5(text) as h from zones
        union all
        select contract_id, -1, arg_min(page_start, section_index), arg_max(page_end, section_index), 'preamble', 0.85,
          md5(string_agg(tx, chr(10) || chr(10) order by section_index))
        from (select *, {strip("case when heading <> '' then heading || chr(10) || content else content end")} as tx from sections where zone_hint = 'preamble') s
        where contract_id % 4 <> 0 group by contract_id""",
)
query(
    "set2_union_parts",
    lambda t: jn.union_parts(
        t.parts,
        t.subdocs.select("contract_id", (F.col("subdoc_index") + 100).alias("part_index"), "title", "page_start", "page_end").withColumn("confidence", F.lit(0.85)),
    ).select("contract_id", "part_index", "title", F.coalesce("part_type", F.lit("none")).alias("part_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")),
    """select contract_id, part_index, title, part_type, 0.0::double as confidence from parts
       union all select contract_id, subdoc_index + 100, title, 'none', 0.85::double from subdocs""",
)
query(
    "set3_with_fallback_rows",
    lambda t: jn.with_fallback_rows(
        t.contracts,
        apart(t.clauses, "contract_id", "contract_id % 3 = 0").select("contract_id", F.col("sort_order").cast("long").alias("order_index"), F.coalesce("number", F.lit("")).alias("number"), "text", "is_auto_split"),
        t.sections,
    ).select("contract_id", "order_index", "number", F.md5("text").alias("h"), "is_auto_split"),
    f"""select case when contract_id % 3 = 0 then -1 - contract_id else contract_id end as contract_id, sort_order as order_index, coalesce(number, '') as number, md5(text) as h, is_auto_split from clauses
        union all
        select contract_id, 0, 'contract_body-auto-1', md5({strip("string_agg(content, chr(10) || chr(10) order by page_start, section_index)")}), true
        from sections where contract_id % 3 = 0 and coalesce(zone_hint, '') not in ('toc', 'cover_page') group by contract_id""",
)
query(
    "set4_distinct_patterns",
    lambda t: jn.distinct_patterns(t.page_lines.select("contract_id", F.lower("text").alias("norm"))),
    "select distinct contract_id, lower(text) as norm from page_lines",
)
query(
    "set5_parity_diff",
    lambda t: jn.parity_diff(t.clauses, apart(t.clauses, "contract_id", "clause_id % 17 = 5"), "contract_id"),
    """select contract_id, sum(l)::bigint as left_rows, sum(r)::bigint as right_rows from (select contract_id, 1 as l, 0 as r from clauses
         union all select case when clause_id % 17 = 5 then -1 - contract_id else contract_id end, 0, 1 from clauses) x group by 1 having sum(l) <> sum(r)""",
)

# ------------------------------------------------------------------ dashboards

query(
    "ag1_dashboard_stats",
    lambda t: da.dashboard_stats(t.contracts, t.clauses, t.analyses),
    f"""select (select count(*) from contracts) as total_contracts, (select count(*) from contracts where status = 'ready') as completed,
          (select count(*) from contracts where status in {STATUS_IN_PROGRESS}) as in_progress, count(*) as analysed_clauses,
          count(*) filter (where risk_level = 'high') as high, count(*) filter (where risk_level = 'medium') as medium,
          count(*) filter (where risk_level = 'low') as low, count(*) filter (where risk_level = 'info') as info from analyses""",
)
query(
    "ag2_status_counts",
    lambda t: da.status_counts(t.contracts),
    f"""select count(*) as "all", count(*) filter (where status = 'ready') as ready, count(*) filter (where status in {STATUS_IN_PROGRESS}) as in_progress,
          count(*) filter (where status = 'error') as error from contracts""",
)
RISK_COUNTS = ", ".join(f"count(*) filter (where risk_level = '{r}') as {r}" for r in fl.RISK_LEVELS)
query(
    "ag3_risk_distribution",
    lambda t: da.risk_distribution(t.clauses, t.analyses),
    f"""select contract_id, {RISK_COUNTS}, count(risk_level) as analysed, count(*) - count(risk_level) as unanalysed
        from clauses left join analyses using (clause_id) group by contract_id""",
)
query(
    "ag4_section_risk_stats",
    lambda t: da.section_risk_stats(jn.with_zone_key(t.clauses, t.zones), t.analyses),
    """select c.contract_id, z.zone_type as zone, count(*) filter (where risk_level = 'high') as high, count(*) filter (where risk_level = 'medium') as medium,
         count(*) filter (where risk_level = 'low') as low, count(*) filter (where risk_level is null) as unanalysed
       from clauses c join zones z on z.zone_id = c.zone_id left join analyses a on a.clause_id = c.clause_id group by 1, 2""",
)
query(
    "ag5_with_bar_ratio",
    lambda t: da.with_bar_ratio(da.risk_distribution(t.clauses, t.analyses)).withColumn("ratio", F.round("ratio", 4)),
    f"""select contract_id, level, value, round(value::double / greatest(max(value) over (partition by contract_id), 1), 4) as ratio
        from (unpivot (select contract_id, {RISK_COUNTS} from clauses left join analyses using (clause_id) group by contract_id)
          on high, medium, low, info into name level value value) u""",
)
query(
    "ag6_zone_totals",
    lambda t: da.zone_totals(t.zones.withColumn("is_analysis_target", F.expr("is_analysis_target or contract_id % 2 = 0"))),
    """select contract_id, count(*) filter (where x) as targets, count(*) filter (where not x) as uncertain,
         case when count(*) filter (where not x) > 0 then 'filtering' else 'ready' end as status
       from (select *, is_analysis_target or contract_id % 2 = 0 as x from zones) z group by 1""",
)
query(
    "ag18_clauses_by_zone",
    lambda t: da.clauses_by_zone(jn.with_zone_key(t.clauses, t.zones)).select(
        "contract_id", "zone", "piece", F.array_join(F.col("clauses").cast("array<string>"), ",").alias("clauses")
    ),
    """select c.contract_id, z.zone_type as zone, 0::bigint as piece, string_agg(cast(clause_id as varchar), ',' order by sort_order, clause_id) as clauses
       from clauses c join zones z on z.zone_id = c.zone_id group by 1, 2""",
)


def _labelled(t):
    return jn.label_zones(t.zones, t.parts, t.subdocs).withColumn("page_to", F.expr("case when zone_index = 1 then null else page_to end"))


SQL_LABELLED = """select z.zone_id, z.contract_id, z.zone_index, z.page_from, case when z.zone_index = 1 then null else z.page_to end as page_to,
    p.title as part_title, s.title as subdoc_title from zones z
    left join parts p on p.contract_id = z.contract_id and z.page_from between p.page_start and p.page_end
    left join subdocs s on s.contract_id = z.contract_id and z.page_from between s.page_start and s.page_end
    qualify row_number() over (partition by z.zone_id order by p.part_index, s.subdoc_index) = 1"""
query(
    "ag19_group_zones",
    lambda t: da.group_zones(_labelled(t)).select(
        "contract_id", F.coalesce("part_title", F.lit("")).alias("part_title"), "first_zone", F.coalesce("page_label", F.lit("")).alias("page_label"),
        F.array_join(F.col("zones").cast("array<string>"), ",").alias("zones"),
    ),
    """select contract_id, coalesce(part_title, '') as part_title, min(zone_index) as first_zone,
         coalesce(list_extract(list('pp.' || page_from || '–' || page_to order by zone_index), 1), '') as page_label,
         string_agg(cast(zone_id as varchar), ',' order by zone_index) as zones from lab group by contract_id, part_title""",
    lab=SQL_LABELLED,
)
query(
    "ag19_group_zones_two_depth",
    lambda t: da.group_zones(_labelled(t), 2).select(
        "contract_id", F.coalesce("subdoc_title", F.lit("")).alias("subdoc_title"), "first_zone",
        F.array_join(F.transform("parts", lambda p: F.concat(F.coalesce(p["part_title"], F.lit("")), F.lit(":"), F.array_join(p["zones"].cast("array<string>"), "+"))), ",").alias("parts"),
    ),
    """select contract_id, coalesce(subdoc_title, '') as subdoc_title, min(f) as first_zone, string_agg(coalesce(part_title, '') || ':' || zs, ',' order by f) as parts
       from (select contract_id, subdoc_title, part_title, min(zone_index) as f, string_agg(cast(zone_id as varchar), '+' order by zone_index) as zs
         from lab group by 1, 2, 3) x group by contract_id, subdoc_title""",
    lab=SQL_LABELLED,
)
query(
    "ag20_first_index",
    lambda t: da.first_index(t.clauses.where("zone_key is not null"), ["contract_id", "zone_key"], "sort_order"),
    "select contract_id, zone_key, min(sort_order) as sort_order from clauses where zone_key is not null group by 1, 2",
)
query(
    "ag22_page_count",
    lambda t: da.page_count(t.clauses, 30),
    "select count(*) as total, cast(ceil(count(*) / 30.0) as bigint) as pages from clauses",
)
SQL_CATEGORIES = " union all ".join(
    f"select '{c}' as category, count(*) filter (where {' or '.join(f'contains(tx, {chr(39)}{w}{chr(39)})' for w in ws)}) as n from tx"
    for c, ws in da.RISK_CATEGORIES.items()
)
query(
    "ag24_top_risk_categories",
    lambda t: da.top_risk_categories(
        t.clauses.withColumn("title", F.expr("case when sort_order % 6 = 0 then 'Termination' when sort_order % 9 = 1 then 'Liability and indemnity' else title end"))
    ),
    f"select * from ({SQL_CATEGORIES}) x",
    tx="""select lower(concat_ws(' ', case when sort_order % 6 = 0 then 'Termination' when sort_order % 9 = 1 then 'Liability and indemnity' else title end, text)) as tx from clauses""",
)
query(
    "tk1_list_contracts",
    lambda t: da.list_contracts(t.contracts, "status", True, 2, 15).select("contract_id", "status", "name"),
    "select contract_id, status, name from contracts order by status, contract_id limit 15 offset 15",
)
query(
    "tk6_order_zone_sections",
    lambda t: da.order_zone_sections(
        jn.with_zone_key(t.clauses, apart(t.zones, "zone_id", "zone_index = 0")).groupBy("contract_id", "zone").agg(F.min("sort_order").alias("first_seen"))
    ).select("contract_id", "zone", "zone_rank", "first_seen"),
    """select contract_id, zone, coalesce(list_position(['preamble', 'contract_agreement', 'general_conditions', 'particular_conditions',
         'conditions_of_contract', 'commercial_terms', 'definitions', 'letter_of_acceptance', 'technical_specifications', 'appendices', 'toc',
         'cover_page', 'drawing_list', 'form_of_tender', 'bill_of_quantities'], zone) - 1, 99) as zone_rank, min(sort_order) as first_seen
       from (select c.contract_id, c.sort_order, coalesce(z.zone_type, c.zone_key, 'unknown') as zone from clauses c
         left join (select * from zones where zone_index <> 0) z on z.zone_id = c.zone_id) x group by 1, 2""",
)
query(
    "tk7_order_parts",
    lambda t: da.order_parts(t.parts).select("contract_id", "part_index", "page_start"),
    "select contract_id, part_index, page_start from parts",
)
query(
    "tk7_order_lines",
    lambda t: da.order_lines(t.page_lines).select("contract_id", "page", "ord", "x0", "y0"),
    "select contract_id, page, ord, x0, y0 from page_lines",
)
query(
    "wn1_backfill_sort_order",
    lambda t: da.backfill_sort_order(t.clauses.drop("sort_order")).select("clause_id", "sort_order"),
    "select clause_id, row_number() over (partition by contract_id order by created_at, clause_id) - 1 as sort_order from clauses",
)
query(
    "wn2_with_position",
    lambda t: da.with_position(t.clauses, ["contract_id"], ["sort_order", "clause_id"], F.floor(F.col("sort_order") / 7)).select("clause_id", "idx"),
    "select clause_id, row_number() over (partition by contract_id order by sort_order, clause_id) - 1 as idx from clauses",
)
SQL_DEPTH = """case when number is null then 0 when regexp_matches(number, '(?i)^\\((?:i{1,3}|iv|vi{0,3}|ix|xi{0,3}|xiv|x{1,3})\\)$') then 3
    when regexp_matches(number, '(?i)^\\([a-z]\\)$') then 2 when regexp_matches(number, '^\\d+(?:\\.\\d+)+$') then least(len(string_split(number, '.')) - 1, 4)
    when regexp_matches(number, '(?i)^SECTION\\s+\\d+\\.\\d') then 1 else 0 end"""
SQL_TREE = f"""select a.clause_id, a.contract_id, a.sort_order, a.depth, (select arg_max(b.clause_id, b.sort_order) from dp b
    where b.contract_id = a.contract_id and b.sort_order < a.sort_order and b.depth < a.depth) as parent_id from dp a"""
query(
    "wn20_with_tree_parent",
    lambda t: da.with_tree_parent(t.clauses).select("clause_id", "depth", F.coalesce("parent_id", F.lit(-1)).alias("parent_id")),
    "select clause_id, depth, coalesce(parent_id, -1) as parent_id from tree",
    dp=f"select *, {SQL_DEPTH} as depth from clauses",
    tree=SQL_TREE,
)
query(
    "ag23_tree_closure",
    lambda t: da.tree_closure(da.with_tree_parent(t.clauses)).select("ancestor", "descendant", "dist"),
    """select ancestor, descendant, dist from (with recursive up(descendant, ancestor, dist) as (
         select clause_id, parent_id, 1 from tree where parent_id is not null
         union all select u.descendant, t.parent_id, u.dist + 1 from up u join tree t on t.clause_id = u.ancestor where t.parent_id is not null)
       select * from up) x""",
    dp=f"select *, {SQL_DEPTH} as depth from clauses",
    tree=SQL_TREE,
)
query(
    "ag23_descendant_counts",
    lambda t: da.descendant_counts(da.tree_closure(da.with_tree_parent(t.clauses))).select("ancestor", "descendants"),
    """select ancestor, count(*) as descendants from (with recursive up(descendant, ancestor) as (
         select clause_id, parent_id from tree where parent_id is not null
         union all select u.descendant, t.parent_id from up u join tree t on t.clause_id = u.ancestor where t.parent_id is not null)
       select * from up) x group by 1""",
    dp=f"select *, {SQL_DEPTH} as depth from clauses",
    tree=SQL_TREE,
)
query(
    "wn21_subdoc_runs",
    lambda t: da.subdoc_runs(jn.label_clauses(t.clauses, t.zones, t.subdocs).withColumn("subdoc_title", F.expr("case when sort_order % 5 > 2 then null else subdoc_title end"))).select("clause_id", "run_id"),
    """select clause_id, (sum(ch) over (partition by contract_id order by sort_order, clause_id) - 1)::bigint as run_id from (
         select *, case when row_number() over w = 1 or lag(tt) over w is distinct from tt then 1 else 0 end as ch from (
           select c.clause_id, c.contract_id, c.sort_order, case when c.sort_order % 5 > 2 then null else s.title end as tt
           from clauses c join zones z on z.zone_id = c.zone_id
           left join subdocs s on s.contract_id = c.contract_id and z.page_from between s.page_start and s.page_end
           qualify row_number() over (partition by c.clause_id order by s.subdoc_index) = 1) x
         window w as (partition by contract_id order by sort_order, clause_id)) y""",
)
query(
    "wn31_monotone_stage",
    lambda t: da.monotone_stage(t.status_events).select("seq", "max_stage"),
    "select seq, max(stage) over (partition by contract_id order by ts, seq) as max_stage from status_events",
)
query(
    "ag26_stage_progress",
    lambda t: da.stage_progress(t.progress).select("event_id", "overall"),
    """select event_id, case when stage = 0 then 0.0 when done then 100.0 else round(((case when stage > 1 then 0.01 when stage = 1 then 0.01 * stage_progress / 100 else 0 end)
         + (case when stage > 2 then 0.93 when stage = 2 then 0.93 * stage_progress / 100 else 0 end)
         + (case when stage > 3 then 0.05 when stage = 3 then 0.05 * stage_progress / 100 else 0 end)
         + (case when stage > 4 then 0.01 when stage = 4 then 0.01 * stage_progress / 100 else 0 end)) * 1000) / 10 end::double as overall from progress""",
)
