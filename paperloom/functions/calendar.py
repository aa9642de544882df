"""Quota clock, durations and display dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the quota day starts at 17:00 Korean time, 08:00 UTC.
RESET_HOUR_UTC = 8


def quota_day_start(ts: Column) -> Column:
    return F.date_trunc("day", ts - F.expr(f"interval {RESET_HOUR_UTC} hours")) + F.expr(
        f"interval {RESET_HOUR_UTC} hours"
    )


def next_reset(ts: Column) -> Column:
    """First quota reset strictly after ``ts``."""
    return quota_day_start(ts) + F.expr("interval 1 day")


def reset_label(ts: Column) -> Column:
    local = F.from_utc_timestamp(next_reset(ts), "Asia/Seoul")
    return F.concat(F.date_format(local, "yyyy-MM-dd"), F.lit(" 17:00 KST"))


def display_date(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, "Asia/Seoul"), "yyyy. MM. dd.")


def expected_duration_ms(size: Column) -> Column:
    """Parse-time estimate: 30 s plus 12 s per MB, within 30 s and 600 s."""
    mb = size / F.lit(1024.0 * 1024.0)
    estimate = F.greatest(F.lit(30000.0), F.least(F.lit(600000.0), F.lit(30000.0) + mb * 12000.0))
    return F.when(size.isNull() | (size <= 0), F.lit(180000)).otherwise(F.round(estimate)).cast("long")


def usage_pct(used: Column, limit: Column) -> Column:
    return F.when(limit > 0, F.least(F.lit(100.0), used / limit * 100.0)).otherwise(F.lit(0.0))
