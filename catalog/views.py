"""Tables the engine works on, derived from the given tables.

Every view is one SELECT that both engines run; the few spots where their
dialects differ go through a ``Dialect``.  ``spark_view`` gives the DataFrame,
``duck`` the SELECT with the needed views in front as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from paperloom.plans.scratch import scratch_path

BASE_TABLES = ["documents", "labels", "events", "embeddings", "pages", "conversations"]


class Spark:
    name = "spark"
    string = "string"
    double = "double"

    def idiv(self, a, b):
        return f"(({a}) div {b})"

    def words(self, text, n):
        return f"array_join(slice(split(translate({text}, chr(10), ' '), ' '), 1, {n}), ' ')"

    def lines(self, text):
        return f"split({text}, chr(10))"

    def map_lines(self, text, body):
        return f"array_join(transform(split({text}, chr(10)), (x, p) -> {body}), chr(10))"

    def explode_lines(self, select, text, source):
        return f"select {select}, pos, line as text from {source} lateral view posexplode(split({text}, chr(10))) t as pos, line"

    def explode_range(self, select, n, source, var):
        return f"select {select}, {var} from {source} lateral view explode(sequence(0, {n} - 1)) t as {var}"

    def hours_after(self, day, n):
        return f"(timestamp_ntz'{day}' + make_dt_interval(0, cast({n} as int), 0, 0))"

    def floor_int(self, x):
        return f"cast(floor({x}) as int)"

    def concat(self, *parts):
        return f"concat({', '.join(parts)})"

    def agg_text(self, text, order, sep):
        return f"listagg({text}, {sep}) within group (order by {order})"

    def prefix(self, text, n):
        return f"substring({text}, 1, {n})"


class Duck(Spark):
    name = "duck"
    string = "varchar"

    def idiv(self, a, b):
        return f"(({a}) // {b})"

    def words(self, text, n):
        return f"array_to_string(string_split(translate({text}, chr(10), ' '), ' ')[1:{n}], ' ')"

    def lines(self, text):
        return f"string_split({text}, chr(10))"

    def map_lines(self, text, body):
        shifted = re.sub(r"\bp\b", "(p-1)", body)
        return f"array_to_string(list_transform(string_split({text}, chr(10)), lambda x, p: {shifted}), chr(10))"

    def explode_lines(self, select, text, source):
        return (
            f"select {select}, pos - 1 as pos, ls[pos] as text from (select *, string_split({text}, chr(10)) as ls from {source}) q, "
            "unnest(range(1, len(ls) + 1)) as u(pos)"
        )

    def explode_range(self, select, n, source, var):
        return f"select {select}, {var} from {source}, unnest(range(0, {n})) as u({var})"

    def hours_after(self, day, n):
        return f"(timestamp '{day}' + to_hours(cast({n} as int)))"

    def concat(self, *parts):
        return f"({' || '.join(parts)})"

    def agg_text(self, text, order, sep):
        return f"string_agg({text}, {sep} order by {order})"


def _doc(d):
    return f"select doc_id, {d.idiv('doc_id', 25)} as contract_id, doc_id % 25 as i, text, lang, source, n_chars from documents"


def _sections(d):
    w = lambda n: d.words("text", n)
    nl = "chr(10)"
    toc = d.concat(
        "'1 General Provisions ........ 3'", nl, "'1.1 Definitions ....... 5'", nl, "'PARTICULAR CONDITIONS ..... 23'", nl,
        w(3), "' 12'", nl, w(2), "'    14'", nl, "'ARTICLE IV '", w(2), "' --- 17'", nl, "'Payment 2021'", nl, w(4), nl,
        w(1), "chr(9)", "'18'", nl, "'16-18'", nl, "'A. Annex ...... 37'", nl, w(2), "' .... 41'", nl, "' '", nl, "'.....'", nl,
        "'Closing pages ....... 36'", nl, "'2.1.3 Deep ......... 20'", nl, "'12'",
    )
    heading = f"""case i
      when 0 then 'CONTRACT AGREEMENT' when 1 then 'TABLE OF CONTENTS' when 2 then 'GENERAL CONDITIONS OF CONTRACT'
      when 3 then '1 General Provisions' when 4 then '1.1 Definitions'
      when 5 then {d.concat("'1.1.1 '", "chr(34)", w(1), "chr(34)", "' means'")}
      when 6 then {d.concat("'(a) '", w(3))} when 7 then {d.concat("'(iv) '", w(2))}
      when 8 then {d.concat("'ARTICLE IV '", w(2))} when 9 then {d.concat("'2.1 '", w(3))}
      when 10 then {d.concat("'SECTION 3.1 '", w(2))} when 11 then {d.concat("'14 days after '", w(12))}
      when 12 then '제3조 목적' when 13 then {d.concat("'4.2 [Rights '", w(2), "']'")}
      when 14 then {w(4)} when 15 then 'PARTICULAR CONDITIONS' when 16 then {d.concat("'1. '", w(2))}
      when 17 then {d.concat("'6. COMMENCEMENT 6.1 '", w(3))} when 18 then {d.concat("'18.2.1 '", w(3))}
      when 19 then case when contract_id % 3 = 0 then 'COVER PAGE' else {w(2)} end
      when 20 then 'Schedule of Rates' when 21 then 'Schedule A' when 22 then ''
      when 23 then '1.1' else {w(2)} end"""
    content = f"""case when i = 1 then {toc}
      when i in (3, 23) and contract_id % 2 = 0 then ''
      when i = 13 then {w(5)} when i = 7 then {w(3)}
      when i = 19 and contract_id % 3 = 0 then {d.concat("'Page 1 of 12'", nl, "text")}
      else text end"""
    return f"""select contract_id, cast(i as int) as section_index, doc_id, {heading} as heading,
      cast(case when i in (4, 9, 10, 13, 23) then 2 when i in (5, 6, 7, 18) then 3 else 1 end as int) as level,
      {content} as content,
      cast({d.idiv('i * 3', 2)} + 1 as int) as page_start, cast({d.idiv('i * 3 + 2', 2)} + 1 as int) as page_end,
      i = 1 as is_toc,
      case when i = 0 then 'contract_agreement' when i = 1 then 'toc' when i = 4 then 'definitions'
        when i = 14 then 'contract_body' when i = 19 and contract_id % 3 = 0 then 'cover_page'
        when i in (20, 21) then 'appendices' when i = 22 then null when i = 24 then 'preamble'
        when i < 15 then 'general_conditions' else 'particular_conditions' end as zone_hint
      from doc"""


def _numbered(d):
    num = f"{d.concat(f'cast(i + 1 as {d.string})', chr(39) + '.' + chr(39), f'cast({d.idiv(chr(112), 3)} as {d.string})')}"
    body = f"""case when p > 0 and p % 12 = 0 then {d.concat(num, "' [Title], the '", "x")}
      when p > 0 and p % 3 = 0 and p % 2 = 1 then {d.concat("'  '", num, "' '", "x")}
      when p > 0 and p % 3 = 0 then {d.concat(num, "'.1 '", "x")}
      when p % 7 = 5 then {d.concat("x", "' Sub-Clause'")}
      when p % 10 = 4 then {d.concat("'(a) '", "x")}
      when p % 11 = 7 then {d.concat("'| '", "x", "' | b |'")}
      when p % 13 = 8 then {d.concat("x", "'-'")}
      when p % 17 = 10 then ''
      when p % 19 = 11 then '| --- | --- |'
      when p % 23 = 14 then {d.concat("'(together with) '", "x")}
      else x end"""
    text = f"replace(text, '. ', {d.concat(chr(39) + '.' + chr(39), 'chr(10)')})"
    return f"""select contract_id, cast(i as int) as section_index, doc_id,
      {d.concat(f'cast(i + 1 as {d.string})', chr(39) + ' ' + chr(39), d.words('text', 2))} as heading,
      cast(1 as int) as level,
      case when i % 8 = 3 then {d.concat(f'cast(i + 1 as {d.string})', chr(39) + '.9 Opening' + chr(39), 'chr(10)')} else '' end
        || {d.map_lines(text, body)} as content,
      cast({d.idiv('i * 3', 2)} + 1 as int) as page_start, cast({d.idiv('i * 3 + 2', 2)} + 1 as int) as page_end,
      case when i = 1 then 'toc' when i < 12 then 'general_conditions' else 'particular_conditions' end as zone_hint
      from doc"""


def _page_lines(d):
    return f"""select contract_id, cast(i * 4 + least({d.idiv('pos', 30)}, 3) as int) as page, i * 1000 + pos as ord, text,
        cast(50 + case when pos % 7 = 6 then 90 else 0 end + case when pos % 5 = 2 then 40 else 0 end as double) as x0,
        cast(100 + (pos % 30) * 20 + case when pos % 6 = 5 then 9 else 0 end as double) as y0,
        cast(500 as double) as x1, cast(112 + (pos % 30) * 20 + case when pos % 6 = 5 then 9 else 0 end as double) as y1,
        cast(842 as double) as page_height,
        cast(case when pos % 30 = 0 then 14 else 10 end as double) as font_size, pos % 11 = 0 as is_bold
      from body_lines
      union all
      select contract_id, page, cast(-1 as bigint), 'General Conditions of Contract', cast(50 as double), cast(30 as double),
        cast(500 as double), cast(42 as double), cast(842 as double), cast(9 as double), false from page_list
      union all
      select contract_id, page, cast(999999 as bigint), {d.concat("'Page '", f"cast(page + 1 as {d.string})", "' of 100'")},
        cast(50 as double), cast(800 as double), cast(500 as double), cast(812 as double), cast(842 as double), cast(9 as double), false
      from page_list"""


def _clauses(d):
    number = """case i when 0 then 'preamble-1' when 1 then 'ARTICLE 1' when 2 then '1.1' when 3 then '1.1.1' when 4 then '(a)'
      when 5 then '(ii)' when 6 then '(b)' when 7 then '1.2' when 8 then 'ARTICLE 2' when 9 then '2.1.1.1' when 10 then '2.1'
      when 11 then 'SECTION 3.1' when 12 then '(c)' when 13 then '(xiv)' when 14 then 'general_conditions-15'
      when 15 then 'SCHEDULE A' when 16 then '1.2.3.4.5' when 17 then 'particular_conditions-auto-3' when 18 then 'appendices-intro'
      when 19 then '7' when 20 then '7.1' when 21 then '(d)' when 22 then null when 23 then '7.2' else '(v)' end"""
    return f"""select doc_id as clause_id, contract_id, contract_id * 10 + zone_index as zone_id, zone_index, {number} as number,
      case when i % 4 = 1 then null else {d.words('text', 3)} end as title, text, cast(i as int) as sort_order,
      case when i % 6 = 5 then null when zone_index = 0 then 'preamble' else zone_type end as zone_key, i % 9 = 0 as needs_review,
      i % 5 = 2 as is_auto_split, cast({d.idiv('i * 3', 2)} + 1 as int) as page_start,
      {d.hours_after('2024-01-01 00:00:00', 'doc_id % 7')} as created_at
      from clause_zone"""


VIEWS = {
    "doc": _doc,
    "contracts": lambda d: f"""select contract_id, contract_id % 7 as user_id,
        {d.concat("'Contract-'", f"cast(contract_id as {d.string})")} as name,
        case contract_id % 8 when 0 then 'uploading' when 1 then 'parsing' when 2 then 'quality_checking' when 3 then 'filtering'
          when 4 then 'analyzing' when 5 then 'ready' when 6 then 'partial' else 'error' end as status,
        cast(38 as int) as page_count, {d.hours_after('2024-01-01 00:00:00', 'contract_id')} as created_at,
        {d.hours_after('2024-01-01 00:00:00', 'contract_id + contract_id % 5')} as updated_at
      from (select distinct contract_id from doc) c""",
    "sections": _sections,
    "numbered_sections": _numbered,
    "body_lines": lambda d: d.explode_lines("contract_id, i, doc_id", "text", "doc"),
    "page_list": lambda d: "select distinct contract_id, cast(i * 4 as int) + q as page from doc, (select 0 as q union all select 1 union all select 2 union all select 3) p"
    if d.name == "duck"
    else "select distinct contract_id, cast(i * 4 as int) + q as page from doc lateral view explode(array(0, 1, 2, 3)) t as q",
    "num_lines": lambda d: d.explode_lines("contract_id, section_index, doc_id", "content", "numbered_sections"),
    "mixed_sections": lambda d: """select s.contract_id, s.section_index, s.doc_id, s.heading, s.level,
        case when s.section_index in (9, 16, 18, 20) then n.content else s.content end as content, s.page_start, s.page_end, s.is_toc, s.zone_hint
      from sections s join numbered_sections n on n.doc_id = s.doc_id""",
    "page_lines": _page_lines,
    "clause_zone": lambda d: """select *, case when i = 0 then 0 when i = 1 then 1 when i < 15 then 2 when i < 21 then 3 else 4 end as zone_index,
        case when i = 0 then 'contract_agreement' when i = 1 then 'toc' when i < 15 then 'general_conditions'
          when i < 21 then 'particular_conditions' else 'appendices' end as zone_type from doc""",
    "clauses": _clauses,
    "zones": lambda d: f"""select contract_id * 10 + zone_index as zone_id, contract_id, cast(zone_index as int) as zone_index,
        cast(min({d.idiv('i * 3', 2)} + 1) as int) as page_from, cast(max({d.idiv('i * 3 + 2', 2)} + 1) as int) as page_to, zone_type,
        cast(case zone_index when 0 then 0.92 when 1 then 0.85 when 2 then 0.9 when 3 then 0.65 else 0.8 end as double) as confidence,
        zone_index in (0, 2, 3) as is_analysis_target,
        case when (contract_id + zone_index) % 3 = 0 then (contract_id % 2 = 0) else null end as user_confirmed,
        min(text) as text
      from clause_zone group by contract_id, zone_index, zone_type""",
    "analyses": lambda d: f"""select doc_id as clause_id,
        case when toxic = 1 then 'high' when quality = 0 then 'medium' when doc_id % 2 = 0 then 'low' else 'info' end as risk_level,
        case when doc_id % 5 = 0 then null else {d.concat("'finding '", f"cast(doc_id as {d.string})")} end as comparison,
        {d.concat("'- check '", f"cast(doc_id as {d.string})", "'; * verify'", "chr(10)", "'report；file'")} as recommendations,
        case doc_id % 4 when 0 then 'The risk is High here' when 1 then 'medium exposure' when 2 then 'a low one' else 'nothing' end as risk_summary,
        {d.hours_after('2024-01-02 00:00:00', 'doc_id % 48')} as created_at
      from labels""",
    "parts": lambda d: f"""select contract_id, cast(k as int) as part_index,
        case k when 0 then 'contract_agreement' when 1 then 'toc' when 2 then 'general_conditions' when 3 then 'cover_page' else 'particular_conditions' end as part_type,
        {d.concat("'Part '", f"cast(k as {d.string})")} as title,
        cast(case k when 0 then 1 when 1 then 2 when 2 then 4 when 3 then 23 else 25 end as int) as page_start,
        cast(case k when 0 then 2 when 1 then 3 when 2 then 20 when 3 then 24 else 33 + contract_id % 4 end as int) as page_end,
        cast(3 as bigint) as section_count
      from ({d.explode_range('contract_id', 5, '(select distinct contract_id from doc) c', 'k')}) x""",
    "subdocs": lambda d: f"""select contract_id, cast(k as int) as subdoc_index, {d.concat("'Volume '", f"cast(k as {d.string})")} as title,
        cast(1 + k * 15 as int) as page_start, cast(case k when 0 then 16 else 30 end as int) as page_end
      from ({d.explode_range('contract_id', 2, '(select distinct contract_id from doc) c', 'k')}) x""",
    "calls": lambda d: """select event_id, ts, case event_type when 'signup' then 'flash25' when 'error' then 'flash25Lite'
        when 'click' then 'gemma27b' when 'view' then 'gemma12b' else 'embedding' end as model_key from events""",
    "progress": lambda d: f"""select event_id, user_id as contract_id, ts, {d.floor_int('value')} % 101 as percent,
        cast(event_id % 6 as int) as stage, cast({d.floor_int('value')} % 101 as double) as stage_progress,
        cast(event_id % 90 as bigint) * 1000 as elapsed_ms, cast(event_id % 40 as bigint) * 1000 as stage_elapsed_ms,
        cast({d.floor_int('value')} % 101 as double) as overall, event_id % 97 = 0 as done from events""",
    "status_events": lambda d: """select event_id as seq, user_id as contract_id, ts,
        case event_id % 6 when 0 then 'parsing' when 1 then 'quality_checking' when 2 then 'filtering' when 3 then 'analyzing'
          when 4 then 'ready' else 'partial' end as status, cast(event_id % 6 as int) as stage from events""",
    "files": lambda d: f"""select page_id, {d.concat("'f'", f"cast(page_id as {d.string})", "case page_id % 4 when 0 then '.pdf' when 1 then '.docx' when 2 then '.PDF' else '.html' end")} as name,
        case page_id % 3 when 0 then '%PDF' when 1 then 'PKzz' else substr(html, 1, 4) end as head,
        case when page_id % 10 = 9 then cast(0 as bigint) when page_id % 10 = 8 then cast(60000000 as bigint) else cast(length(html) as bigint) end as length from pages""",
    "ref_clauses": lambda d: f"""select clause_id, contract_id, sort_order, number, case when sort_order % 8 = 4 then 'definitions' else zone_key end as zone_key,
        {d.concat("text",
          "' The Advance-Party shall follow Sub-Clause 2.1 [Scope], see (see 7.2) and Article 2. '",
          "case when sort_order % 4 = 1 then 'As in Clauses 1.1 [GP], 7.1 [Ins 3] and 7, and Sub-Clauses 2.1.1.1 [A] or 9.9B. ' else '' end",
          "case when sort_order % 5 = 2 then 'Under Sub-Clauses 7.1 [Tests] to 7.9 [Repeat] the EPC Works stop. ' else '' end",
          f"case when sort_order % 3 = 0 then {d.concat(chr(39) + chr(34) + 'Works ' + chr(39), f'cast(clause_id as {d.string})', chr(39) + chr(34) + ' or ' + chr(34) + 'EPC Works' + chr(34) + ' means all. ' + chr(34) + 'Advance-Party' + chr(34) + ' has the meaning given in Section 3.1. ' + chr(34) + 'Defect' + chr(34) + ' means: (the ' + chr(34) + '**Disclosing Party**' + chr(34) + ') and 제3조 제1항. ' + chr(39))} else '' end")} as text
      from clauses""",
    "answers": lambda d: f"""select clause_id, case clause_id % 6
        when 0 then '{{"riskSummary":"s","recommendations":"r","fidicComparison":"c","riskLevel":"high"}}'
        when 1 then '{{"riskSummary":12,"riskLevel":"low","fidicComparison":"with text"}}'
        when 2 then 'not json' when 3 then '{{"riskSummary":"This is high","riskLevel":"HIGH","recommendations":"look"}}'
        when 4 then '{{"riskSummary":"","fidicComparison":null,"riskLevel":"medium"}}'
        else '{{"fidicComparison":{{"a":1}},"riskLevel":"info","riskSummary":"fine"}}' end as answer,
        {d.concat("'model-'", f"cast(clause_id % 3 as {d.string})")} as model,
        {d.concat("'{\"riskLevel\":\"'", "case when clause_id % 4 = 0 then 'high' else 'medium' end", "'\",\"confidence\":0.'", f"cast(clause_id % 10 as {d.string})", "'}'")} as recheck
      from (select doc_id as clause_id from doc) c""",
    "vectors": lambda d: "select vec_id, embedding, label from embeddings",
    "table_boxes": lambda d: """select distinct contract_id, page, cast(45 as double) as x0, cast(180 as double) as y0,
        cast(500 as double) as x1, cast(260 as double) as y1 from page_list where page % 3 = 0""",
}


def spark_sql(sf_dir: str, name: str, body: str | None = None) -> str:
    d = Spark()
    ctes = _needed(body or name, lambda v: VIEWS[v](d), [name] if body is None else None)
    base = {t: f"select * from parquet.`{sf_dir}/{t}.parquet`" for t in BASE_TABLES}
    used = {t: q for t, q in base.items() if any(re.search(rf"\b{t}\b", c) for c in list(ctes.values()) + [body or ""])}
    parts = [f"{n} as ({q})" for n, q in {**used, **ctes}.items()]
    return f"with {', '.join(parts)} {body or f'select * from {name}'}"


_STORED: dict[tuple[str, str, str], str] = {}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table, written once per application to the shared scratch folder.

    Downstream queries then read parquet, so their filters and column lists
    reach the scan instead of being folded into the derivation.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_path(spark, f"view-{name}")
        sql = spark_sql(sf_dir, name)
        df, cores = spark.sql(sql), spark.sparkContext.defaultParallelism
        given = [f"{sf_dir}/{t}.parquet" for t in BASE_TABLES if f"/{t}.parquet`" in sql]
        if spark.sparkContext.master.startswith("local") and all(spark.read.parquet(p).rdd.getNumPartitions() < cores for p in given):
            # each given table is one small file: spread it, or later queries use one core
            df = df.repartition(cores)
        df.write.option("compression", "zstd").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def stored_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    return _STORED[(spark.sparkContext.applicationId, sf_dir, name)]


def duck(body: str, **extra: str) -> str:
    """``body`` with the views and extra CTEs it mentions in front."""
    d = Duck()
    extra_text = " ".join(extra.values())
    ctes = _needed(body + " " + extra_text, lambda v: VIEWS[v](d), None)
    parts = [f"{n} as ({q})" for n, q in {**ctes, **extra}.items()]
    return (f"with {', '.join(parts)} " if parts else "") + body


def _needed(text: str, build, roots: list[str] | None) -> dict[str, str]:
    found: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in found:
            return
        query = build(name)
        for other in VIEWS:
            if other != name and re.search(rf"\b{other}\b", query):
                visit(other)
        found[name] = query

    for name in roots or [v for v in VIEWS if re.search(rf"\b{v}\b", text)]:
        visit(name)
    return found
