"""Ordered scans that survive one huge key.

A plain ``Window.partitionBy(contract).orderBy(...)`` sends a whole contract
to one task.  If a single contract holds a third of the table, that task is
the job.  ``ordered_scan`` computes the same running values in two levels:

1. rows are windowed inside ``(key, chunk)``, where ``chunk`` is a bounded,
   monotone piece of the order (for example ``section_index div 20000``);
2. every chunk is reduced to one summary row (partial aggregation before the
   shuffle), the few summary rows of a key are windowed to get what each chunk
   inherits from the chunks before (or after) it;
3. the inherited values are joined back on ``(key, chunk)`` and combined.

The inherited side has one row per chunk, reads only the columns the scan
needs, and AQE broadcasts it whenever its measured size allows.  Nulls in a key
are made values of their own before the window, so the join needs the same
partitioning as the window and the wide side is shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import cut

# Rows that an affine scan folds at once, and the types of its rates and values.
FOLD_ROWS = 64
RATE, VALUE = T.DecimalType(25, 24), T.DecimalType(30, 18)

# Rows of a dense integer order, and pages, that make up one chunk.
CHUNK_ROWS = 20_000
CHUNK_PAGES = 2_000


@dataclass(frozen=True)
class Step:
    """One running value: ``kind`` over ``value``."""

    kind: str
    value: Column
    breaks: Callable[[Column, Column], Column] | None = None


def running_sum(value: Column) -> Step:
    """Sum of the rows up to and including the current one."""
    return Step("sum", value)


def running_max(value: Column) -> Step:
    """Greatest non-null value so far, current row included."""
    return Step("max", value)


def last_value(value: Column) -> Step:
    """Latest non-null value so far, current row included."""
    return Step("last", value)


def last_before(value: Column) -> Step:
    """Latest non-null value strictly before the current row."""
    return Step("last_before", value)


def previous(value: Column) -> Step:
    """Value of the row just before (null for the first row)."""
    return Step("prev", value)


def following(value: Column) -> Step:
    """Value of the row just after (null for the last row)."""
    return Step("next", value)


def first_value(value: Column) -> Step:
    """Least value so far.  A value that starts with the order columns gives the earliest row."""
    return Step("first", value)


def island(value: Column, breaks: Callable[[Column, Column], Column] | None = None) -> Step:
    """1-based number of the run a row belongs to.

    A new run starts where ``breaks(previous, current)`` holds, by default
    where the value changes.
    """
    return Step("island", value, breaks or (lambda p, c: ~p.eqNullSafe(c)))


def int_chunk(col: str) -> Column:
    """Chunk id of a non-negative integer order column."""
    return F.floor(F.col(col) / F.lit(CHUNK_ROWS)).cast("long")


def page_chunk(col: str = "page_start") -> Column:
    """Chunk id of an order that starts with a page number."""
    return F.floor(F.col(col) / F.lit(CHUNK_PAGES)).cast("long")


def time_chunk(col: str, unit: str = "day") -> Column:
    """Chunk id of a timestamp order column."""
    return F.unix_timestamp(F.date_trunc(unit, F.col(col)))


def range_chunked(df: DataFrame, by: list[str], order: list[str], out: str = "range_chunk") -> DataFrame:
    """Add a chunk id for an order without a usable number in it.

    The rows are range-partitioned by the whole order, so every partition is a
    bounded piece of it however the keys are distributed.  The result is cut
    off: both sides of a scan must see the same boundaries.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *by, *order).withColumn(out, F.spark_partition_id()))


def ordered_scan(
    df: DataFrame,
    by: list[str],
    order: list[str],
    steps: dict[str, Step],
    chunk: Column | None = None,
) -> DataFrame:
    """Add the running values of ``steps`` to ``df``.

    ``order`` must be a total order inside ``by``, and ``chunk`` must not
    decrease along it.  Without ``chunk`` the key must be bounded by nature
    (one page, one cell) and a single window is used.
    """
    src = {f"__v_{n}": s.value for n, s in steps.items()}
    islands = {n: s for n, s in steps.items() if s.kind == "island"}
    safe = {} if chunk is None else plain_keys(df, by, "__y")
    one = [*safe] if safe else by
    # rows without a chunk come first, as nulls do
    own = {} if chunk is None else {"__ck": F.coalesce(chunk.cast("long"), F.lit(-(2**63)).cast("long"))}
    base = df.withColumns({**src, **safe, **own})
    keys = [*one, *own]
    local = W.partitionBy(*keys).orderBy(*order)
    if islands:
        base = base.withColumns(
            {f"__b_{n}": _break_flag(s, F.col(f"__v_{n}"), F.lag(F.struct(F.col(f"__v_{n}").alias("v"))).over(local)) for n, s in islands.items()}
        )
    keyed = base.withColumns(
        {
            f"__l_{n}": F.sum(f"__b_{n}").over(local.rowsBetween(W.unboundedPreceding, W.currentRow))
            if s.kind == "island"
            else _local(s.kind, F.col(f"__v_{n}"), local)
            for n, s in steps.items()
        }
    )
    drops = [*safe, *own, *src, *[f"__b_{n}" for n in islands], *[f"__l_{n}" for n in steps]]
    if chunk is None:
        done = {n: _combine(s.kind, F.col(f"__l_{n}"), F.lit(None)) for n, s in steps.items() if s.kind not in ("island",)}
        done |= {n: F.col(f"__l_{n}") + 1 for n in islands}
        return keyed.withColumns(done).drop(*drops)

    key = F.struct(*order)
    marks = [f"__b_{n}" for n in islands]
    summary = (
        base.select(*keys, *order, *src, *marks)
        .groupBy(*keys)
        .agg(*[_summary(s.kind, F.col(f"__v_{n}"), key, f"__b_{n}").alias(f"__s_{n}") for n, s in steps.items()])
    )
    across = W.partitionBy(*one).orderBy("__ck")
    for n, s in islands.items():
        # does the first row of this chunk break from the last row of the chunk before?
        joint = _break_flag(s, F.col(f"__s_{n}.first.v"), F.lag(f"__s_{n}.last").over(across), 1)
        summary = summary.withColumn(f"__j_{n}", joint)
    carry = summary.select(
        *keys,
        *[
            _island_start(F.col(f"__s_{n}"), F.col(f"__j_{n}"), across).alias(f"__c_{n}")
            if s.kind == "island"
            else _inherit(s.kind, F.col(f"__s_{n}"), across).alias(f"__c_{n}")
            for n, s in steps.items()
        ],
    )
    joined = keyed.join(carry, keys, "left")
    out = joined.withColumns(
        {n: _combine(s.kind, F.col(f"__l_{n}"), F.col(f"__c_{n}")) for n, s in steps.items()}
    )
    return out.drop(*drops, *[f"__c_{n}" for n in steps])


def plain_keys(df: DataFrame, by: list[str], name: str = "__z") -> dict[str, Column]:
    """Key columns without nulls that tell the same keys apart: each value, and which of them are missing."""
    out = {f"{name}_{i}": _filled(F.col(c), df.schema[c].dataType) for i, c in enumerate(by)}
    missing = [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(by)]
    return out | {f"{name}_nul": sum(missing[1:], missing[0])}


def _filled(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.coalesce(c, F.lit(0).cast(kind))
    if isinstance(kind, T.StringType):
        return F.coalesce(c, F.lit(""))
    return F.struct(c)


def _break_flag(step: Step, value: Column, before: Column, at_start: int = 0) -> Column:
    """1 where a run starts; the first row of a window gives ``at_start``."""
    starts = F.coalesce(step.breaks(before["v"], value), F.lit(True))
    return F.when(before.isNull(), at_start).otherwise(starts.cast("int"))


def _island_start(summary: Column, joint: Column, across) -> Column:
    before = F.sum(summary["breaks"]).over(across.rowsBetween(W.unboundedPreceding, -1))
    return F.coalesce(before, F.lit(0)) + F.sum(joint).over(across.rowsBetween(W.unboundedPreceding, W.currentRow))


def _local(kind: str, value: Column, w) -> Column:
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    if kind == "sum":
        return F.sum(value).over(upto)
    if kind == "max":
        return F.max(value).over(upto)
    if kind == "first":
        return F.min(value).over(upto)
    if kind == "last":
        return F.last(value, ignorenulls=True).over(upto)
    if kind == "last_before":
        return F.last(value, ignorenulls=True).over(before)
    wrapped = F.struct(value.alias("v"))
    if kind == "prev":
        return F.lag(wrapped).over(w)
    if kind == "next":
        return F.lead(wrapped).over(w)
    raise ValueError(kind)


def _summary(kind: str, value: Column, key: Column, mark: str) -> Column:
    if kind == "island":
        wrapped = F.struct(value.alias("v"))
        return F.struct(
            F.sum(mark).alias("breaks"), F.min_by(wrapped, key).alias("first"), F.max_by(wrapped, key).alias("last")
        )
    if kind == "first":
        return F.min(value)
    if kind == "sum":
        return F.sum(value)
    if kind == "max":
        return F.max(value)
    if kind in ("last", "last_before"):
        return F.max_by(value, F.when(value.isNotNull(), key))
    wrapped = F.struct(value.alias("v"))
    return F.max_by(wrapped, key) if kind == "prev" else F.min_by(wrapped, key)


def _inherit(kind: str, value: Column, across) -> Column:
    before = across.rowsBetween(W.unboundedPreceding, -1)
    if kind == "sum":
        return F.sum(value).over(before)
    if kind == "max":
        return F.max(value).over(before)
    if kind == "first":
        return F.min(value).over(before)
    if kind in ("last", "last_before"):
        return F.last(value, ignorenulls=True).over(before)
    return F.lag(value).over(across) if kind == "prev" else F.lead(value).over(across)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind in ("sum", "island"):
        return F.coalesce(local + carry, local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "first":
        return F.coalesce(carry, local)
    if kind in ("last", "last_before"):
        return F.coalesce(local, carry)
    return F.coalesce(local, carry)["v"]


def affine_scan(df: DataFrame, by: list[str], place: Column, rate: Column, value: Column, out: str) -> DataFrame:
    """Add ``out``: along ``place`` (0, 1, 2, ... inside ``by``) x = rate * x of the row before + value.

    A rate of 0 starts afresh.  Two steps in a row are a step of the same kind, so
    pieces of ``FOLD_ROWS`` rows are folded to one each, the pieces are scanned in
    the same way, and what a piece inherits is put into its rows; a key of any length
    needs a level for every factor of ``FOLD_ROWS`` and no row loop outside a piece.
    Values are decimals with 18 places, rates (at most 1) with 24; nothing is ever divided.
    The columns of ``df`` have to be of types that can be ordered.
    """
    safe = plain_keys(df, by)
    rows = df.select(
        *(c.alias(n) for n, c in safe.items()),
        place.cast("long").alias("p"),
        rate.cast(RATE).alias("a"),
        value.cast(VALUE).alias("x"),
        F.struct(*df.columns).alias("row"),
    )
    return _affine(rows, [*safe]).select("row.*", F.col("x").alias(out))


def _affine(rows: DataFrame, keys: list[str]) -> DataFrame:
    done = F.array().cast(T.ArrayType(T.StructType([rows.schema["p"], rows.schema["row"], T.StructField("a", RATE), T.StructField("x", VALUE)])))
    start = F.struct(F.lit(1).cast(RATE).alias("a"), F.lit(0).cast(VALUE).alias("x"), done.alias("done"))

    def step(s: Column, r: Column) -> Column:
        a, x = (s["a"] * r["a"]).cast(RATE), (r["a"] * s["x"] + r["x"]).cast(VALUE)
        row = F.struct(r["p"].alias("p"), r["row"].alias("row"), a.alias("a"), x.alias("x"))
        return F.struct(a.alias("a"), x.alias("x"), F.concat(s["done"], F.array(row)).alias("done"))

    pieces = rows.groupBy(*keys, F.floor(F.col("p") / FOLD_ROWS).cast("long").alias("piece")).agg(F.array_sort(F.collect_list(F.struct("p", "a", "x", "row"))).alias("rows"))
    folded = cut(pieces.select(*keys, "piece", F.aggregate("rows", start, step).alias("f")).select(*keys, "piece", "f.*"), "folded")
    each = folded.select(*keys, "piece", F.explode("done").alias("d")).select(*keys, "piece", "d.*")
    if not folded.agg(F.max("piece")).first()[0]:
        return each.select(*keys, "p", "row", "x")
    ends = folded.select(*keys, F.col("piece").alias("p"), "a", "x", F.lit(0).alias("row"))
    carry = _affine(ends, keys).select(*keys, (F.col("p") + 1).alias("piece"), F.col("x").alias("before"))
    whole = (F.col("x") + F.col("a") * F.coalesce("before", F.lit(0).cast(VALUE))).cast(VALUE)
    return each.join(carry, [*keys, "piece"], "left").select(*keys, "p", "row", whole.alias("x"))


def ordered_fold(df: DataFrame, by: list[str], order: list[Column], inputs: dict[str, Column], step: Callable, out: str) -> DataFrame:
    """Add ``out``, an int: the last part of the state that ``step(state, *inputs)`` leaves at each row of a key, None before its first.

    For decisions that need all decisions before them.  A key must be bounded by nature, such as a page: its rows
    are sorted in one task.  They pass one by one, so a task holds a state and a batch, and no row is joined back.
    """
    rows = df.repartition(*by).sortWithinPartitions(*by, *order).withColumns({f"__in_{n}": c for n, c in inputs.items()})
    columns, taken = list(df.columns), [f"__in_{n}" for n in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = state = None
        for batch in batches:
            at = batch.schema.get_field_index
            keys = zip(*(batch.column(at(c)).to_pylist() for c in by))
            values = zip(*(batch.column(at(c)).to_pylist() for c in taken))
            found = []
            for key, value in zip(keys, values):
                state = step(state if key == last else None, *value)
                last = key
                found.append(state[-1])
            kept = [batch.column(at(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.int32())], names=[*columns, out])

    return rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())]))
