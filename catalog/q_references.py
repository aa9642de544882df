"""Cross-reference and defined-term queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import references as rf
from paperloom.plans.scratch import scratch_path

from .registry import query
from .sqltext import ex, rx


def found(t):
    c = t.ref_clauses
    return rf.extract_refs(c).unionByName(rf.extract_list_refs(c)).unionByName(rf.expand_ranges(c, c))


def resolved(t):
    return rf.resolve_refs(rf.dedupe_refs(found(t)), t.ref_clauses)


def terms(t):
    return rf.extract_terms(rf.definition_clauses(t.ref_clauses))


def _spans_sql(pattern: str, kind: str, source: str = "ref_clauses", text: str = "text") -> str:
    p = pattern.replace("'", "''")
    return f"""select contract_id, clause_id, '{kind}' as pattern_type, parts[u.k] as matched_text,
        coalesce(list_sum(list_transform(parts[1:u.k - 1], lambda x: length(x))), 0)::bigint as offset_start
      from (select *, string_split(regexp_replace({text}, '{p}', chr(2) || '\\0' || chr(2), 'g'), chr(2)) as parts from {source}) q,
        unnest(range(2, len(parts) + 1, 2)) as u(k)"""


SQL_SINGLE = " union all ".join(f"select *, {ex('matched_text', p, 1)} as target_ref from ({_spans_sql(p, k)}) s_{k}" for k, p in rf.SINGLE.items())
COLS = ["contract_id", "clause_id", "pattern_type", "target_ref", "matched_text", "offset_start"]
query(
    "xr1_extract_refs",
    lambda t: rf.extract_refs(t.ref_clauses).select(*COLS),
    "select contract_id, clause_id, pattern_type, target_ref, matched_text, offset_start from singles",
    singles=SQL_SINGLE,
)
query(
    "xr2_extract_list_refs",
    lambda t: rf.extract_list_refs(t.ref_clauses).select("contract_id", "clause_id", "target_ref", "matched_text", "offset_start"),
    f"""select contract_id, real_id as clause_id, {ex('matched_text', '^(' + rf.NUM + ')', 1)} as target_ref, matched_text, (off + offset_start)::bigint as offset_start
        from (select i.*, b.off, b.real_id from ({_spans_sql(rf.NUM + rf.TITLE, 'x', 'bodies', 'body')}) i join bodies b on b.clause_id = i.clause_id) z""",
    lists=_spans_sql(rf.LIST, "list"),
    bodies=f"""select contract_id, clause_id * 1000000 + offset_start as clause_id, clause_id as real_id, substr(matched_text, length(lead) + 1) as body, offset_start + length(lead) as off
        from (select *, {ex('matched_text', '(?i)^(?:' + rf.KEYWORD + ')' + chr(92) + 's+', 0)} as lead from lists) x""",
)
SQL_LISTED = f"""select contract_id, real_id as clause_id, kind as pattern_type, {ex('matched_text', '^(' + rf.NUM + ')', 1)} as target_ref, matched_text, (off + offset_start)::bigint as offset_start
    from (select i.*, b.off, b.real_id, b.kind from ({_spans_sql(rf.NUM + rf.TITLE, 'x', 'bodies', 'body')}) i join bodies b on b.clause_id = i.clause_id) z"""
SQL_BODIES = f"""select contract_id, clause_id * 1000000 + offset_start as clause_id, clause_id as real_id, substr(matched_text, length(lead) + 1) as body, offset_start + length(lead) as off,
      case when starts_with(lower(lead), 'sub') then 'subclause' when starts_with(lower(lead), 'clause') then 'clause' when starts_with(lower(lead), 'article') then 'article' else 'section' end as kind
    from (select *, {ex('matched_text', '(?i)^(?:' + rf.KEYWORD + ')' + chr(92) + 's+', 0)} as lead from lists) x"""
# whole numbers at both ends; what lies between shares all parts but the last
SQL_RANGED = f"""select r.contract_id, r.clause_id, r.kind as pattern_type, n.number as target_ref, r.matched_text, r.offset_start from (
      select *, {ex('matched_text', rf.RANGE, 1)} as lo, {ex('matched_text', rf.RANGE, 2)} as hi,
        case when starts_with(lower(matched_text), 'sub') then 'subclause' when starts_with(lower(matched_text), 'clause') then 'clause' when starts_with(lower(matched_text), 'article') then 'article' else 'section' end as kind
      from ({_spans_sql(rf.RANGE, 'range')}) q) r
    join (select distinct contract_id, number from ref_clauses where regexp_full_match(number, '[0-9]+([.][0-9]+)*')) n on n.contract_id = r.contract_id
      and regexp_replace(n.number, '[.]?[^.]*$', '') = regexp_replace(lo, '[.]?[^.]*$', '')
      and cast(regexp_extract(n.number, '[^.]*$') as bigint) between cast(regexp_extract(lo, '[^.]*$') as bigint) and cast(regexp_extract(hi, '[^.]*$') as bigint)"""
SQL_FOUND = """select distinct *, offset_start + length(matched_text) as offset_end from (
    select contract_id, clause_id, pattern_type, target_ref, matched_text, offset_start, false as is_list from singles
    union all select contract_id, clause_id, pattern_type, target_ref, matched_text, offset_start, true from listed
    union all select contract_id, clause_id, pattern_type, target_ref, matched_text, offset_start, true from ranged) f"""
# the walk keeps a single reference that starts behind the end of the last one kept and touches no list or range
SQL_DEDUPED = """select contract_id, clause_id, pattern_type, target_ref, matched_text, offset_start, offset_end, is_list from found where is_list
    union all
    select contract_id, clause_id, pattern_type, target_ref, matched_text, offset_start, offset_end, is_list from (
      with recursive o as (
        select *, row_number() over (partition by contract_id, clause_id order by offset_start, offset_end desc, target_ref, pattern_type) as rn from found f
        where not is_list and not exists (select 1 from found l where l.is_list and l.clause_id = f.clause_id and f.offset_start < l.offset_end and l.offset_start < f.offset_end)),
      rec as (
        select clause_id, rn, offset_end as reach, true as kept from o where rn = 1
        union all
        select o.clause_id, o.rn, case when o.offset_start >= r.reach then o.offset_end else r.reach end, o.offset_start >= r.reach from rec r join o on o.clause_id = r.clause_id and o.rn = r.rn + 1)
      select o.* from o join rec on rec.clause_id = o.clause_id and rec.rn = o.rn where kept) k"""
_PLAIN = "lower(regexp_replace(regexp_replace({0}, '\\s+', '', 'g'), '\\b0+([0-9])', '\\1', 'g'))"
_BASE = "regexp_replace({0}, '[A-Za-z]+$', '')"
SQL_RESOLVED = f"""select *, target_clause_id is not null as is_resolved from (
    select d.*, coalesce(
        (select arg_max(c.clause_id, (c.sort_order, c.clause_id)) from ref_clauses c where c.contract_id = d.contract_id and c.number = d.target_ref),
        (select arg_max(c.clause_id, (c.sort_order, c.clause_id)) from ref_clauses c where c.contract_id = d.contract_id and {_PLAIN.format('c.number')} = {_PLAIN.format('d.target_ref')}),
        (select arg_min(c.clause_id, (c.sort_order, c.clause_id)) from ref_clauses c where c.contract_id = d.contract_id and {_BASE.format('c.number')} = {_BASE.format('d.target_ref')}),
        (select arg_min(c.clause_id, (c.sort_order, c.clause_id)) from ref_clauses c where c.contract_id = d.contract_id and regexp_full_match(c.number, '[0-9]+([.][0-9]+)+') and starts_with(c.number, d.target_ref || '.'))
      ) as target_clause_id from deduped d) r where target_clause_id is null or target_clause_id <> clause_id"""
FOUND = dict(
    singles=SQL_SINGLE, lists=_spans_sql(rf.LIST, "list"), bodies=SQL_BODIES, listed=SQL_LISTED, ranged=SQL_RANGED, found=SQL_FOUND, deduped=SQL_DEDUPED, resolved=SQL_RESOLVED
)
query(
    "xr3_expand_ranges",
    lambda t: rf.expand_ranges(t.ref_clauses, t.ref_clauses).select("contract_id", "clause_id", "target_ref"),
    "select contract_id, clause_id, target_ref from ranged",
    ranged=SQL_RANGED,
)
query(
    "xr4_dedupe_refs",
    lambda t: rf.dedupe_refs(found(t)).select(*COLS, "is_list"),
    "select contract_id, clause_id, pattern_type, target_ref, matched_text, offset_start, is_list from deduped",
    **FOUND,
)
query(
    "xr5_resolve_refs",
    lambda t: resolved(t).select("contract_id", "clause_id", "target_ref", "offset_start", F.coalesce("target_clause_id", F.lit(-1)).alias("target_clause_id"), "is_resolved"),
    "select contract_id, clause_id, target_ref, offset_start, coalesce(target_clause_id, -1) as target_clause_id, is_resolved from resolved",
    **FOUND,
)
query(
    "xr6_incoming_refs",
    lambda t: rf.incoming_refs(resolved(t)),
    "select contract_id, target_clause_id, count(*) as incoming, count(distinct clause_id) as sources from resolved where is_resolved group by 1, 2",
    **FOUND,
)
query(
    "xr6_ref_stats",
    lambda t: rf.ref_stats(resolved(t)),
    """select contract_id, pattern_type, count(*) as total, count(*) filter (where is_resolved) as resolved, count(*) filter (where not is_resolved) as unresolved
       from resolved group by 1, 2""",
    **FOUND,
)
_DEF = f"""(coalesce(zone_key, '') = 'definitions' or regexp_full_match(coalesce(number, ''), '1[.]1([.][0-9]+)+')
   or (coalesce(zone_key, '') = 'general_conditions' and {rx('text', '"[^"]{1,80}"' + chr(92) + 's+means' + chr(92) + 'b')}))"""
query("xr7_definition_clauses", lambda t: rf.definition_clauses(t.ref_clauses).select("clause_id"), f"select clause_id from ref_clauses where {_DEF}")
SQL_NAMES = f"""select clause_id, contract_id, offset_start, term, dt, inl, n > 1 as grp from (
      select clause_id, contract_id, offset_start, unnest(names) as term, len(names) as n, dt, inl from (
        select clause_id, contract_id, offset_start, regexp_extract_all(matched_text, '"([^"]{{1,80}})"', 1) as names, false as inl,
          case when {rx('matched_text', 'means' + chr(92) + 's*:$')} then 'enumerated' when {rx('matched_text', 'has' + chr(92) + 's+the' + chr(92) + 's+meaning$')} then 'reference' else 'direct' end as dt
        from ({_spans_sql(rf.DEFINITION, 'd', 'defs')}) a
        union all select clause_id, contract_id, offset_start, regexp_extract_all(matched_text, '"([^"]{{1,80}})"', 1), false, 'direct' from ({_spans_sql(rf.KO_DEFINITION, 'k', 'defs')}) b
        union all select clause_id, contract_id, offset_start, [trim({ex('matched_text', rf.INLINE, 1)})], true, 'direct' from ({_spans_sql(rf.INLINE, 'i', 'defs')}) c
        union all select clause_id, contract_id, offset_start, [trim({ex('matched_text', rf.CONSTRUED, 1)})], true, 'direct' from ({_spans_sql(rf.CONSTRUED, 'c', 'defs')}) d) x) y"""
SQL_DEFS = f"select * from ref_clauses where {_DEF}"
query(
    "xr8_extract_terms",
    lambda t: terms(t).select("clause_id", "term", "definition_type", "is_inline", F.col("group_id").isNotNull().alias("grouped")),
    "select distinct clause_id, term, dt as definition_type, inl as is_inline, grp as grouped from names",
    defs=SQL_DEFS,
    names=SQL_NAMES,
)
query(
    "xr9_term_variants",
    lambda t: rf.term_variants(terms(t)).select("clause_id", "term", "variant"),
    """select distinct clause_id, term, variant from (select clause_id, term, unnest([term, term || chr(39) || 's', term || '’s', case when not ends_with(term, 's') then term || 's' end,
         case when ends_with(term, 'y') and not regexp_matches(term, '(?i)[aeiou]y$') then term[1:length(term) - 1] || 'ies' end,
         case when contains(term, '-') then replace(term, '-', '') end, case when contains(term, '-') then replace(term, '-', ' ') end]) as variant from names) x where variant is not null""",
    defs=SQL_DEFS,
    names=SQL_NAMES,
)
SQL_VARIANTS = """select distinct contract_id, term, variant, regexp_extract(variant, '^[A-Za-z0-9]+') as head from (select contract_id, term, unnest([term, term || chr(39) || 's', term || '’s',
      case when not ends_with(term, 's') then term || 's' end, case when ends_with(term, 'y') and not regexp_matches(term, '(?i)[aeiou]y$') then term[1:length(term) - 1] || 'ies' end,
      case when contains(term, '-') then replace(term, '-', '') end, case when contains(term, '-') then replace(term, '-', ' ') end]) as variant from names) x where variant is not null"""
SQL_STARTS = """select contract_id, clause_id, i - 1 as s, substr(text, i, (select max(length(variant)) + 1 from variants)) as ahead, substr(text, greatest(i - 5, 1), least(i - 1, 5)) as before
    from (select contract_id, clause_id, text, c, unnest(range(1, len(c) + 1)) as i from (select contract_id, clause_id, text, string_split(text, '') as c from ref_clauses) q) w
    where regexp_matches(c[i], '[A-Za-z0-9]') and (i = 1 or not regexp_matches(c[i - 1], '[A-Za-z0-9]'))"""
SQL_HITS = """select *, row_number() over (partition by clause_id order by length(term) desc, term, length(variant) desc, s) as rn from (
    select distinct clause_id, term, variant, s, s + length(variant) as e from starts p join variants v on v.contract_id = p.contract_id and v.head = regexp_extract(ahead, '^[A-Za-z0-9]+')
    where starts_with(ahead, variant) and not regexp_matches(substr(ahead, length(variant) + 1, 1), '[A-Za-z0-9_]')
      and not ((s = 0 or regexp_matches(before, '[.!?:;]\\s*$') or contains(substr(before, -2), chr(10))) and not regexp_matches(term, '^[A-Z]'))) h"""
# the walk keeps a use that overlaps no reference and no use kept before
SQL_USED = """select h.clause_id, h.term, h.variant as matched_text, h.s as offset_start from hits h join (
    with recursive rec as (
      select h.clause_id, 0::bigint as rn, coalesce(b.busy, []) as busy, false as kept from (select distinct clause_id from hits) h
        left join (select clause_id, list({'s': offset_start, 'e': offset_end}) as busy from deduped group by 1) b using (clause_id)
      union all
      select clause_id, rn, case when clash then busy else list_append(busy, {'s': s::bigint, 'e': e::bigint}) end, not clash from (
        select h.clause_id, h.rn, r.busy, h.s, h.e, len(list_filter(r.busy, lambda o: h.s < o.e and o.s < h.e)) > 0 as clash
        from rec r join hits h on h.clause_id = r.clause_id and h.rn = r.rn + 1) t)
    select clause_id, rn from rec where kept) k on k.clause_id = h.clause_id and k.rn = h.rn"""
USED = dict(FOUND, defs=SQL_DEFS, names=SQL_NAMES, variants=SQL_VARIANTS, starts=SQL_STARTS, hits=SQL_HITS, used=SQL_USED)
query(
    "xr10_term_usages",
    lambda t: rf.term_usages(t.ref_clauses, rf.term_variants(terms(t)), rf.dedupe_refs(found(t))).select("clause_id", "term", "matched_text", "offset_start"),
    "select clause_id, term, matched_text, offset_start from used",
    **USED,
)
# a term that several clauses of a contract define counts for one of them only; which one is not part of the result
query(
    "xr10_usage_counts",
    lambda t: rf.usage_counts(terms(t), rf.term_usages(t.ref_clauses, rf.term_variants(terms(t)), rf.dedupe_refs(found(t))))
    .groupBy("contract_id", "term")
    .agg(F.sum("usage_count").alias("usage_count")),
    """select n.contract_id, n.term, coalesce(max(u.k), 0) as usage_count from (select distinct contract_id, term from names) n
       left join (select c.contract_id, term, count(*) as k from used join ref_clauses c using (clause_id) group by 1, 2) u using (contract_id, term) group by 1, 2""",
    **USED,
)
query(
    "xr11_term_aliases",
    lambda t: rf.term_aliases(terms(t)).select("clause_id", "term", F.array_join("aliases", "|").alias("aliases")),
    """select distinct n.clause_id, n.term, coalesce((select string_agg(distinct o.term, '|' order by o.term) from names o
         where n.grp and o.clause_id = n.clause_id and o.offset_start = n.offset_start and o.term <> n.term), '') as aliases from names n""",
    defs=SQL_DEFS,
    names=SQL_NAMES,
)


def _xr12(t):
    """All contracts are stored, then all are rebuilt twice, a third of them with texts that hold no reference any more."""
    path = scratch_path(t.spark, "refs")
    c = t.ref_clauses
    rf.rebuild_contract_refs(c, path, buckets=32)
    later = c.withColumn("text", F.when(F.col("contract_id") % 3 == 1, "nothing here").otherwise(F.col("text")))
    for _ in range(2):
        rf.rebuild_contract_refs(later, path, buckets=32)
    return rf.stored_refs(t.spark, path).groupBy("contract_id").agg(F.count("*").alias("refs"))


query(
    "xr12_rebuild_contract_refs",
    _xr12,
    "select contract_id, count(*) as refs from resolved where contract_id % 3 <> 1 group by 1",
    **FOUND,
)
