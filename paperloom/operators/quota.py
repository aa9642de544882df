"""Model quota, call rates and processing progress."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import quota_day_start
from ..plans.scan import RATE, VALUE, affine_scan, island, last_value, ordered_scan, plain_keys, previous, running_sum, time_chunk
from ..plans.scratch import cut

# Calls per day, calls per minute and least interval in ms per model.
MODEL_LIMITS = [
    ("flash31Lite", 20, 10, 6000),
    ("flash25", 20, 5, 12000),
    ("flash25Lite", 20, 10, 6000),
    ("flash3", 1500, 15, 4000),
    ("gemma27b", 14400, 30, 2000),
    ("gemma12b", 14400, 30, 2000),
    ("gemma4b", 14400, 30, 2000),
    ("embedding", 1000, 100, 600),
]

# Quota groups and the models in them.
MODEL_GROUPS = {
    "analysis": ["flash31Lite"],
    "crossValidation": ["flash25", "flash25Lite", "flash3"],
    "preprocessing": ["gemma27b", "gemma12b", "gemma4b"],
    "embedding": ["embedding"],
}

# Task -> model key, and the fallback chains in order.
TASK_ROUTES = [
    ("DOCUMENT_ZONING", "gemma27b", "preprocessing"),
    ("CLAUSE_SPLIT_VERIFY", "gemma12b", "preprocessing"),
    ("METADATA_EXTRACTION", "gemma12b", "preprocessing"),
    ("LANGUAGE_DETECTION", "gemma4b", "preprocessing"),
    ("QUALITY_CHECK", "gemma12b", "preprocessing"),
    ("TEXT_CLEANUP", "gemma4b", "preprocessing"),
    ("RISK_ANALYSIS", "flash25Lite", "analysis"),
    ("FIDIC_COMPARISON", "flash25Lite", "analysis"),
    ("CROSS_VALIDATION", "flash25", "analysis"),
    ("DEEP_ANALYSIS", "flash3", "analysis"),
    ("FALLBACK_ANALYSIS", "flash25Lite", "analysis"),
    ("EMBEDDING", "embedding", None),
]
FALLBACK_CHAINS = {
    "analysis": ["flash25", "flash25Lite", "gemma27b", "gemma12b", "gemma4b"],
    "preprocessing": ["gemma27b", "gemma12b", "gemma4b", "flash25", "flash25Lite"],
}

# Clauses and embeddings one contract needs on average.
ANALYSES_PER_CONTRACT, EMBEDDINGS_PER_CONTRACT = 80, 40

# Expected stage durations in ms and the smoothing of the estimate.
STAGE_MS = {1: 5_000, 2: 180_000, 3: 30_000, 4: 20_000, 5: 60_000}
ETA_ALPHA = 0.3
ETA_MIN_ELAPSED_MS = 8_000
# Fixed value: expected duration in ms of a stage that is not listed.
ETA_OTHER_MS = 30_000


def quota_usage(llm_calls: DataFrame, limits: DataFrame, at: Column) -> DataFrame:
    """Calls per model in the quota day that contains ``at``."""
    start = quota_day_start(at)
    inside = llm_calls.where((F.col("ts") >= start) & (F.col("ts") < start + F.expr("interval 1 day")))
    used = inside.groupBy("model_key").agg(F.count(F.lit(1)).alias("used"))
    return (
        limits.select("model_key", F.col("day_limit").alias("limit"))
        .join(used, "model_key", "left")
        .withColumn("used", F.coalesce("used", F.lit(0)))
        .withColumn("remaining", F.greatest(F.lit(0), F.col("limit") - F.col("used")))
        .select("model_key", "used", "remaining", "limit")
    )


def quota_groups(usage: DataFrame, groups: DataFrame) -> DataFrame:
    """Totals per model, per group and overall."""
    joined = usage.join(groups, "model_key")
    sets = joined.groupingSets([[F.col("grp"), F.col("model_key")], [F.col("grp")], []], F.col("grp"), F.col("model_key"))
    totals = sets.agg(F.sum("used").alias("used"), F.sum("limit").alias("limit"), F.sum("remaining").alias("__r"), F.grouping("model_key").alias("__t"))
    rest = F.when(F.col("__t") == 0, F.col("__r")).otherwise(F.greatest(F.lit(0), F.col("limit") - F.col("used")))
    return totals.select("grp", "model_key", "used", rest.alias("remaining"), "limit")


def extra_contracts(usage: DataFrame) -> DataFrame:
    """How many further contracts the remaining quota allows."""
    left = F.col("limit") - F.col("used")
    one = usage.agg(
        F.max(F.when(F.col("model_key") == "flash31Lite", left)).alias("a"),
        F.max(F.when(F.col("model_key") == "embedding", left)).alias("e"),
    )
    guess = F.floor(F.least(F.col("a") / ANALYSES_PER_CONTRACT, F.col("e") / EMBEDDINGS_PER_CONTRACT))
    return one.select(F.greatest(F.lit(0), guess).alias("extra_contracts"))


def rate_violations(llm_calls: DataFrame, limits: DataFrame) -> DataFrame:
    """Gap to the previous call and calls in the last minute, with their limits.

    A handful of models carry all calls, so a model is cut into hours; every
    hour also sees the last minute of the hour before.
    """
    gaps = ordered_scan(
        llm_calls, ["model_key"], ["ts", "event_id"], {"__p": previous(F.col("ts"))}, time_chunk("ts", "hour")
    )
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    base = gaps.withColumns(
        {"__ms": ms(F.col("ts")), "gap_ms": ms(F.col("ts")) - ms(F.col("__p")), "__h": time_chunk("ts", "hour")}
    ).drop("__p")
    late = F.col("__ms") >= (F.col("__h") + 3600) * 1000 - 60_000
    copies = F.when(late, F.array(F.col("__h"), F.col("__h") + 3600)).otherwise(F.array(F.col("__h")))
    spread = base.withColumn("__c", F.explode(copies))
    w = W.partitionBy("model_key", "__c").orderBy("__ms").rangeBetween(-60_000, 0)
    counted = spread.withColumn("rpm", F.count(F.lit(1)).over(w)).where(F.col("__c") == F.col("__h"))
    joined = counted.join(limits.select("model_key", "minute_limit", "min_interval_ms"), "model_key")
    return joined.select(
        "event_id",
        "model_key",
        "gap_ms",
        "rpm",
        F.coalesce(F.col("gap_ms") < F.col("min_interval_ms"), F.lit(False)).alias("too_close"),
        (F.col("rpm") > F.col("minute_limit")).alias("too_many"),
    )


# ---------------------------------------------------------------- progress


def throttle_progress(progress: DataFrame, seconds: int = 3) -> DataFrame:
    """Keep changed values, at most one per ``seconds`` since the last kept one; null is a value like others.

    After a pause of ``seconds`` the next value is compared only with the last
    kept value, and afterwards that value is the last kept one whichever way
    it went.  So the rows between two pauses form a burst with two possible
    courses, first row kept or first row dropped.  Inside a burst the row kept
    after a kept row depends on that row alone: both courses follow the same
    pointers from two rows, found by doubling them.  A running pass over the bursts
    picks one course for each: no contract and no burst has to fit into one task.
    """
    order = ["ts", "event_id"]
    timed = progress.withColumn("__ms", F.unix_millis(F.col("ts").cast("timestamp")))
    pause = lambda p, c: c - p >= seconds * 1000
    steps = {"__b": island(F.col("__ms"), pause), "__run": island(F.col("percent")), "__n": running_sum(F.lit(1).cast("long"))}
    scanned = ordered_scan(timed, ["contract_id"], order, steps, time_chunk("ts"))
    keys = plain_keys(scanned, ["contract_id"])
    rows = cut(scanned.withColumns(keys), "progress")
    key = [*keys]
    bursts = rows.groupBy(*key, "__b").agg(F.min("__n").alias("__start"), F.max("__n").alias("__stop"), F.min("ts").alias("ts"), F.min_by("contract_id", "__n").alias("contract_id"))
    bursts = cut(bursts, "bursts")
    courses = _burst_courses(rows, bursts, key, seconds * 1000)
    marked = rows.join(bursts.select(*key, "__b", "__start", "__stop"), [*key, "__b"]).join(courses, [*key, "__n"], "left")
    first = F.col("__n") == F.col("__start")
    marked = marked.withColumns({"__ka": first | F.coalesce(F.col("__a") > 0, F.lit(False)), "__kb": F.coalesce(F.col("__c") > 0, F.lit(False))}).drop("__a", "__c")
    streamed = cut(marked, "courses")
    value = F.struct("percent")
    summary = streamed.groupBy(*key, "__b").agg(
        F.min_by(value, "__n").alias("__first"),
        F.max_by(value, F.when(F.col("__ka"), F.col("__n"))).alias("__ea"),
        F.coalesce(F.max_by(value, F.when(F.col("__kb"), F.col("__n"))), F.min_by(value, "__n")).alias("__eb"),
        F.min("ts").alias("ts"),
    )
    summary = cut(summary, "ends")
    # course a (first row kept) unless the burst before ended on the same value
    chunk = time_chunk("ts")
    before = ordered_scan(summary, key, ["__b"], {"__pa": previous(F.col("__ea")), "__pb": previous(F.col("__eb"))}, chunk)
    start = F.col("__pa").isNull()
    after_a = start | ~F.col("__pa").eqNullSafe(F.col("__first"))
    after_b = start | ~F.col("__pb").eqNullSafe(F.col("__first"))
    modes = before.withColumns(
        {
            "__const": F.when(after_a == after_b, F.struct("__b", after_a.alias("v"))),
            "__swap": F.when(~after_a & after_b, 1).otherwise(0),
        }
    )
    passes = ordered_scan(modes, key, ["__b"], {"__lc": last_value(F.col("__const")), "__sw": running_sum(F.col("__swap"))}, chunk)
    at_const = ordered_scan(passes, key, ["__b"], {"__s0": last_value(F.when(F.col("__const").isNotNull(), F.col("__sw")))}, chunk)
    flips = (F.col("__sw") - F.col("__s0")) % 2 == 1
    picked = at_const.select(*key, "__b", (F.col("__lc.v") != flips).alias("__a"))
    kept = F.when(F.col("__a"), F.col("__ka")).otherwise(F.col("__kb"))
    return streamed.join(picked, [*key, "__b"]).where(kept).select(*progress.columns)


def _burst_courses(rows: DataFrame, bursts: DataFrame, key: list[str], wait_ms: int) -> DataFrame:
    """(key, __n, __a, __c): rows kept if their burst's first row is kept (__a), or dropped (__c).

    The row after a kept one is the first that is ``wait_ms`` later or, where that has
    the kept value, the first of the next run of equal values.  Only bursts of several
    rows are followed.
    """
    inside = cut(rows.join(bursts.where("__stop > __start").select(*key, "__b", "__start"), [*key, "__b"]).select(*key, "__b", "__start", "__n", "__ms", "__run", "percent"), "inside")
    # later times come first: what was seen last is the earliest row not before a time
    seen = inside.select(*key, "__b", (-F.col("__ms")).alias("__t"), F.lit(0).alias("__asks"), (-F.col("__n")).alias("__m"), F.struct("__n", "__run", "percent").alias("__to"))
    asks = inside.select(*key, "__b", (-F.col("__ms") - wait_ms).alias("__t"), F.lit(1).alias("__asks"), (-F.col("__n")).alias("__m"), F.lit(None).cast(seen.schema["__to"].dataType).alias("__to"))
    span = F.floor(F.col("__t") / max(60_000, 16 * wait_ms))
    found = ordered_scan(seen.unionByName(asks), [*key, "__b"], ["__t", "__asks", "__m"], {"__at": last_value(F.col("__to"))}, span)
    found = found.where("__asks = 1").select(*key, (-F.col("__m")).alias("__n"), "__at")
    runs = inside.groupBy(*key, "__b", "__run").agg(F.min("__n").alias("__change"))
    after = lambda run: runs.select(*key, "__b", (F.col("__run") - 1).alias(run), "__change")
    asked = inside.join(found, [*key, "__n"]).withColumn("__at_run", F.col("__at.__run"))
    asked = asked.join(after("__at_run"), [*key, "__b", "__at_run"], "left")
    same = F.col("__at.percent").eqNullSafe(F.col("percent"))
    jump = cut(asked.select(*key, "__n", F.when(same, F.col("__change")).otherwise(F.col("__at.__n")).alias("__to")).where("__to is not null"), "jump")
    firsts = inside.where("__n = __start")
    dropped = firsts.join(after("__run"), [*key, "__b", "__run"]).select(*key, F.col("__change").alias("__n"), F.lit(0).alias("__a"), F.lit(1).alias("__c"))
    reached = firsts.select(*key, "__n", F.lit(1).alias("__a"), F.lit(0).alias("__c")).unionByName(dropped)
    reached = cut(reached.groupBy(*key, "__n").agg(F.max("__a").alias("__a"), F.max("__c").alias("__c")), "reached")
    total, count = F.sum(F.col("__a") + F.col("__c")), None
    while (now := reached.agg(total).first()[0]) != count:
        # after k rounds the rows within 2 ** k hops are reached
        count = now
        hop = reached.join(jump, [*key, "__n"]).select(*key, F.col("__to").alias("__n"), "__a", "__c")
        reached = cut(reached.unionByName(hop).groupBy(*key, "__n").agg(F.max("__a").alias("__a"), F.max("__c").alias("__c")), "reached")
        far = jump.select(*key, F.col("__n").alias("__to"), F.col("__to").alias("__far"))
        jump = cut(jump.join(far, [*key, "__to"]).select(*key, "__n", F.col("__far").alias("__to")), "jump")
    return reached


def eta(progress: DataFrame, stage_ms: dict[int, int] | None = None, alpha: float | str = ETA_ALPHA, other_ms: int = ETA_OTHER_MS) -> DataFrame:
    """Remaining time: current stage from its speed plus the stages to come, smoothed.

    Every row stays: without an estimate (stage 5, too early, no progress) the
    result is null, for a finished contract with one it is 0.  The smoothing starts
    afresh with every stage: x = alpha * x of the row before + (1 - alpha) * estimate.
    That is an affine scan in decimals (progress counts with six places); the
    result is rounded to nine places, then half up to whole milliseconds, so exact halves
    are halves whichever way a run was cut into pieces.  A stage that ``stage_ms`` does
    not list is expected to take ``other_ms``.
    """
    ms_of = stage_ms or STAGE_MS
    smooth = Decimal(str(alpha))
    expected = F.lit(other_ms)
    future = F.lit(0)
    for stage, ms in ms_of.items():
        expected = F.when(F.col("stage") == stage, ms).otherwise(expected)
        future = future + F.when((F.col("stage") < stage) & F.lit(stage != 5), ms).otherwise(0)
    percent = F.least(F.col("stage_progress").cast("decimal(9,6)"), F.lit(99).cast("decimal(9,6)"))
    elapsed = F.col("stage_elapsed_ms").cast("decimal(13,0)")
    measured = (percent > 5) & (F.col("stage_elapsed_ms") > 3_000)
    # a try: the unused branch may divide by zero
    remaining = F.when(measured, F.try_divide(elapsed * (F.lit(100) - percent), percent)).otherwise(expected.cast("decimal(13,0)") * (F.lit(100) - percent) / F.lit(100))
    usable = F.coalesce((F.col("stage") != 5) & (F.col("elapsed_ms") >= ETA_MIN_ELAPSED_MS) & (F.col("overall") > 0), F.lit(False))
    done = F.coalesce("done", F.lit(False)) if "done" in progress.columns else F.lit(False)
    raw = progress.withColumn("__raw", F.when(usable & ~done, (remaining + future).cast(VALUE)))
    others = raw.where(F.col("__raw").isNull()).select(*progress.columns, F.when(usable & done, 0).cast("long").alias("eta_ms"))
    steps = {"__stage": previous(F.col("stage")), "__k": running_sum(F.lit(1).cast("long"))}
    rows = ordered_scan(raw.where(F.col("__raw").isNotNull()), ["contract_id"], ["ts", "event_id"], steps, time_chunk("ts"))
    first = F.col("__stage").isNull() | (F.col("__stage") != F.col("stage"))
    rate = F.when(first, F.lit(Decimal(0)).cast(RATE)).otherwise(F.lit(smooth).cast(RATE))
    value = F.when(first, F.col("__raw")).otherwise((F.col("__raw") * F.lit(1 - smooth).cast(RATE)).cast(VALUE))
    out = affine_scan(rows, ["contract_id"], F.col("__k") - 1, rate, value, "__smooth")
    whole = F.round(F.round(F.col("__smooth"), 9), 0)
    return out.select(*progress.columns, F.greatest(F.lit(0), whole).cast("long").alias("eta_ms")).unionByName(others)
