"""Ordered folds whose rows are shuffled as compressed columns.

A shuffle writes whole rows, so narrow values (a word and where it stands) take many
times the room of the values themselves, and sorting them as rows costs more than the
work on them.  Here a task's rows are gathered, and the share of a target travels as one
compressed Arrow batch.  Behind the shuffle they are dealt out once more, to a file of
the task, in parts that are sorted as columns one at a time.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows, or bytes, that a task gathers before it deals them out; parts of a partition; rows that are sorted, and rows that are given out, at once.
PACK_ROWS, PACK_BYTES = 300_000, 48 << 20
PARTS = 64
SORT_ROWS, BATCH_ROWS = 1_000_000, 20_000


def packed_fold(df: DataFrame, by: list[str], order: list[str], fold: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], out: T.StructType) -> DataFrame:
    """What ``fold`` makes of the rows in order of (``by``, ``order``), nulls first and NaN last; a key's rows are in one partition.

    Keys come in any order, each without a break.  A task holds ``PACK_ROWS`` rows, or ``SORT_ROWS`` of a part; a longer
    part is sorted in ranges of (key, first of ``order``), so only rows that agree in both have to fit.
    """
    targets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = to_arrow_schema(T.StructType([*df.schema.fields, T.StructField("__h", T.LongType())]))
    hashed = df.withColumn("__h", F.xxhash64(*by))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(b.cast(schema) for b in batches):
            to, sizes, pieces = zip(*_dealt(rows, _hashes(rows) % targets, 3))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(sizes, pa.int64()), pa.array(pieces, pa.binary())], names=["to", "size", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")

        def unpacked(size: int, piece: pa.Buffer | bytes) -> pa.RecordBatch:
            return pa.ipc.read_record_batch(codec.decompress(piece, decompressed_size=size), schema)

        def ordered() -> Iterator[pa.RecordBatch]:
            places: dict[int, list[tuple[int, int, int]]] = {}
            with tempfile.TemporaryFile() as file:
                pieces = (unpacked(n.as_py(), p.as_buffer()) for b in batches for n, p in zip(b.column("size"), b.column("piece")))
                for rows in _gathered(pieces):
                    for part, size, piece in _dealt(rows, _hashes(rows) // targets % PARTS, 1):
                        places.setdefault(part, []).append((file.tell(), size, len(piece)))
                        file.write(piece)

                def read(at: int, size: int, length: int) -> pa.RecordBatch:
                    file.seek(at)
                    return unpacked(size, file.read(length))

                for own in places.values():
                    for rows in _ranges([lambda x=x: read(*x) for x in own], order[0]):
                        rows = _in_order(rows, by, order)
                        for at in range(0, rows.num_rows, BATCH_ROWS):
                            yield rows.slice(at, BATCH_ROWS)

        yield from fold(ordered())

    pieces = hashed.mapInArrow(pack, "to int, size long, piece binary")
    return pieces.repartitionById(targets, F.col("to")).mapInArrow(run, out)


def _hashes(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("__h").to_numpy()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PACK_ROWS or size >= PACK_BYTES:
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
    if rows:
        yield pa.concat_batches(held)


def _dealt(rows: pa.RecordBatch, to: np.ndarray, level: int) -> Iterator[tuple[int, int, bytes]]:
    """(target, size, compressed rows) of each target; rows keep their order."""
    order = np.argsort(to, kind="stable")
    to, rows = to[order], rows.take(pa.array(order))
    codec = pa.Codec("zstd", compression_level=level)
    starts = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(to)]):
        raw = rows.slice(a, b - a).serialize()
        yield int(to[a]), raw.size, codec.compress(raw, asbytes=True)


def _ranges(pieces: list[Callable[[], pa.RecordBatch]], first: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``pieces`` in ranges of (hash, ``first``) of about ``SORT_ROWS`` rows."""
    whole, rows = [], 0
    for piece in pieces:
        whole.append(piece())
        rows += whole[-1].num_rows
        if rows > SORT_ROWS:
            break
    else:
        yield pa.concat_batches(whole)
        return
    del whole
    # the place of every row's (hash, null, value) tells its range
    number = _is_number(pieces[0]().column(first))
    places = lambda r: np.rec.fromarrays([_hashes(r), *(sort_keys(r.column(first), True) if number else [])])
    every = np.concatenate([places(p()) for p in pieces])
    every = every[np.lexsort([every[n] for n in every.dtype.names[::-1]])]
    marks = every[SORT_ROWS::SORT_ROWS]
    for lo, hi in zip([None, *marks], [*marks, None]):
        found = []
        for piece in pieces:
            rows = piece()
            at = places(rows)
            found.append(rows.filter(pa.array(~_below(at, lo) & (_below(at, hi) if hi is not None else True))))
        rows = pa.concat_batches(found)
        if rows.num_rows:
            yield rows


def _below(at: np.ndarray, mark: np.record | None) -> np.ndarray:
    """Whether a place comes before ``mark``; NaN comes last."""
    out, same = np.zeros(len(at), bool), np.ones(len(at), bool)
    for n in at.dtype.names if mark is not None else ():
        a, b = at[n], mark[n]
        out |= same & ((a < b) | ((b != b) & (a == a)))
        same &= (a == b) | ((a != a) & (b != b))
    return out


def _in_order(rows: pa.RecordBatch, by: list[str], order: list[str]) -> pa.RecordBatch:
    hashes, keys = _hashes(rows), [k for c in order for k in sort_keys(rows.column(c))]
    ordered = rows.take(pa.array(np.lexsort([*keys[::-1], hashes])))
    if (new_keys(ordered, by) & (np.diff(_hashes(ordered), prepend=0) == 0))[1:].any():  # two keys with one hash
        ordered = rows.take(pa.array(np.lexsort([*keys[::-1], *(ranks(rows.column(c)) for c in by)])))
    return ordered


def sort_keys(column: pa.Array, always: bool = False) -> list[np.ndarray]:
    """Arrays that put a column in order, nulls first: whether there is a value, and the value."""
    if not _is_number(column):
        return [ranks(column)]
    if not column.null_count and not always:
        return [column.to_numpy()]
    return [column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy()]


def _is_number(column: pa.Array) -> bool:
    return pa.types.is_integer(column.type) or pa.types.is_floating(column.type)


def ranks(column: pa.Array) -> np.ndarray:
    return pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()


def new_keys(batch: pa.RecordBatch, by: list[str], before: list | None = None) -> np.ndarray:
    """Whether the key of a row differs from that of the row before; ``before`` is the key ahead of the first."""
    new = np.zeros(batch.num_rows, bool)
    for c in by:
        a, b = batch.column(c)[:-1], batch.column(c)[1:]
        missing = pc.and_(pc.is_null(a), pc.is_null(b))
        new[1:] |= ~pc.coalesce(pc.equal(a, b), missing).to_numpy(zero_copy_only=False)
    new[0] = before is None or before != [batch.column(c)[0].as_py() for c in by]
    return new


def whole_keys(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in order of their keys, and where each key begins; no key is torn apart."""
    key, held = None, []
    for batch in batches:
        starts = np.flatnonzero(new_keys(batch, by, key))
        key = [batch.column(c)[-1].as_py() for c in by]
        if not len(starts):
            held.append(batch)
            continue
        ahead = sum(h.num_rows for h in held)
        at = [0] * bool(ahead) + (starts[:-1] + ahead).tolist()
        if at:
            yield pa.concat_batches([*held, batch.slice(0, starts[-1])]), np.array(at)
        held = [batch.slice(starts[-1])]
    if held:
        yield pa.concat_batches(held), np.array([0])
