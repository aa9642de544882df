"""Risk distribution per contract and zone, from sections to counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import numbering as nb
from paperloom.functions import zoning as zn
from paperloom.operators import dashboards as da

from .registry import query
from .sqltext import detect_part, zone_hint


def risk_by_zone(t):
    """Zone every section by its heading, number it, and count risks per zone."""
    zoned = zn.classify_zones(t.sections.select("doc_id", "contract_id", "heading"), "heading")
    clauses = nb.annotate_numbering(zoned.where("is_target"), "heading").select(
        F.col("doc_id").alias("clause_id"), "contract_id", F.col("zone_key").alias("zone")
    )
    return da.section_risk_stats(clauses, t.analyses)


query(
    "risk_by_zone",
    risk_by_zone,
    f"""select contract_id, zone, count(*) filter (where risk_level = 'high') as high, count(*) filter (where risk_level = 'medium') as medium,
          count(*) filter (where risk_level = 'low') as low, count(*) filter (where risk_level is null) as unanalysed
        from (select contract_id, doc_id, {zone_hint('heading', detect_part('heading', 'sections'))} as zone from sections) s left join analyses a on a.clause_id = s.doc_id
        where zone not in ('toc', 'cover_page', 'preamble', 'drawing_list', 'form_of_tender', 'bill_of_quantities', 'appendices', 'technical_specifications') group by 1, 2""",
)
