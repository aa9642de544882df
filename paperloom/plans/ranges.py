"""Page-range joins as equi-joins.

A range predicate alone plans as a nested loop, and an equality on the
contract alone pairs every row of a contract with every range of it.  Page
numbers are small integers, so a range is expanded to its pages and the join
becomes an equality on (contract, page).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_pages(ranges: DataFrame, lo: str, hi: str, keep: list[str], page: str = "page") -> DataFrame:
    """One row per page covered by each range; empty ranges vanish."""
    return ranges.where(F.col(lo) <= F.col(hi)).select(*keep, F.explode(F.sequence(lo, hi)).alias(page))


def first_range_by_page(
    ranges: DataFrame, by: list[str], lo: str, hi: str, rank: Column, payload: dict[str, Column]
) -> DataFrame:
    """(by, page) -> payload of the lowest-ranked range that covers the page."""
    value = F.struct(*[c.alias(n) for n, c in payload.items()])
    expanded = ranges.where(F.col(lo) <= F.col(hi)).select(
        *by, F.explode(F.sequence(lo, hi)).alias("page"), rank.alias("__rank"), value.alias("__value")
    )
    best = expanded.groupBy(*by, "page").agg(F.min_by("__value", "__rank").alias("__value"))
    return best.select(*by, "page", "__value.*")
