"""Structured Streaming counterparts of the intake, status, quota and reuse jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.headings import text_heading
from ..functions.text import BLANKS, strip
from ..functions.zoning import CLAUSE_STARTS, analysis_target, zone_paragraphs
from ..plans.packed import new_keys, packed_fold, whole_keys
from ..plans.scan import following, int_chunk, island, ordered_scan, running_sum
from ..plans.scratch import lean_cut, no_shuffle_kept, scratch_path, uncut
from ..sources.sinks import publish_contract_tables
from ..sources.tables import file_heads, fitting_content, validate_files


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def intake_stream(spark: SparkSession, path: str, sink: str) -> StreamingQuery:
    """Watch a folder: accepted files go to ``sink/accepted``, others to ``sink/rejected``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    checked = validate_files(file_heads(raw))
    return file_sink(checked, sink, {"accepted": "accepted", "rejected": "not accepted"})


def plain_text(content: Column) -> Column:
    """Text of an accepted file that holds plain text behind its header line; null where the bytes are no UTF-8."""
    text = F.try_validate_utf8(content.cast("string"))
    end = F.instr(text, "\n")
    rest = F.when(end > 0, F.substring(text, end + 1, F.length(text))).otherwise("")
    return F.when(text.startswith("%PDF"), rest).otherwise(text)


def parse_files(files: DataFrame, text: Column) -> dict[str, DataFrame]:
    """Contracts, zones and clauses of accepted files (contract_id, name, content; path, if a contract has several).

    The files of a contract are the parts of one text, in order of their paths; a line ends with its part.
    A text without a line of text, or with a file that can't be read, is damaged: its contract gets the status
    ``error`` and nothing else.  Paragraphs are typed by their first line; a run of equal
    types is a zone, from its first paragraph to its last.  Clauses are split at heading lines.
    A file is held as a whole only while it is read; all that follows works on its lines, so
    no task needs room for more than one file.
    """
    path = F.col("path" if "path" in files.columns else "name").alias("path")
    read = files.select("contract_id", "name", path, F.monotonically_increasing_id().alias("part_id"), text.alias("text"))
    lines = read.select("contract_id", "name", "path", "part_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    # a paragraph has no empty line, a clause begins with a heading line
    lines = lean_cut(lines.withColumn("head", F.coalesce(text_heading(_clean("line")), F.lit(False))), "read")
    parts = lean_cut(_parts_in_order(lines), "listed")
    listed = parts.where("part_id = file").select("contract_id", "name", "file", "damaged")
    damaged = listed.where("damaged")
    places = parts.where("not damaged").select("part_id", "file", "ahead", "kept")
    body = lines.join(F.broadcast(places), "part_id").where("pos < kept").select("contract_id", "file", (F.col("pos") + F.col("ahead")).cast("int").alias("pos"), "line", "head")
    scanned = lean_cut(_numbered(body), "lines")
    uncut(lines)
    typed = _typed_paragraphs(scanned)
    runs = ordered_scan(lean_cut(typed, "typed"), ["file"], ["pos"], {"zone_index": island(F.col("type"))}, int_chunk("pos"))
    zones = runs.groupBy("contract_id", "zone_index", F.col("type").alias("zone_type")).agg(
        F.min("pos").alias("page_from"), F.max("pos").alias("page_to"), F.max("confidence").alias("confidence")
    )
    # a damaged contract gets one zone without a page, which is what fails a contract on publishing
    broken = damaged.select("contract_id", F.lit(1).cast("long").alias("zone_index"), F.lit(None).cast("string").alias("zone_type"), F.lit(None).cast("int").alias("page_from"), F.lit(None).cast("int").alias("page_to"), F.lit(None).cast("double").alias("confidence"))
    zones = lean_cut(zones.select(broken.columns).unionByName(broken).withColumn("is_analysis_target", analysis_target(F.col("zone_type"))), "zones")
    clauses = _line_clauses(scanned)
    uncut(scanned)
    return {"contracts": listed.select("contract_id", "name"), "zones": zones, "clauses": clauses, "damaged": damaged.select("contract_id", "name")}


def _parts_in_order(lines: DataFrame) -> DataFrame:
    """One row per file: the first file of its contract's text, lines ahead of its own, its lines, and whether the text is damaged.

    What follows the last line feed of a part is a line only if there is something, or no other part.
    """
    solid = F.coalesce(F.col("line").rlike(r"\S"), F.lit(False))
    each = lines.groupBy("contract_id", "name", "path", "part_id").agg(
        F.max(solid).alias("solid"), F.count("pos").alias("n"), F.coalesce(F.max_by(F.col("line") == "", "pos"), F.lit(False)).alias("bare")
    )
    # files without a contract have nothing to do with each other
    one = W.partitionBy("contract_id", F.when(F.col("contract_id").isNull(), F.col("part_id")))
    along = one.orderBy("path", "part_id")
    more = F.lead("part_id").over(along).isNotNull()
    kept = each.withColumn("kept", F.col("n") - (F.col("bare") & more).cast("int"))
    ahead = F.coalesce(F.sum("kept").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    damaged = ~F.max("solid").over(one) | (F.min("n").over(one) == 0)
    return kept.select("contract_id", "name", "part_id", F.first("part_id").over(along).alias("file"), ahead.alias("ahead"), "kept", damaged.alias("damaged"))


def _numbered(lines: DataFrame) -> DataFrame:
    """Add the empty lines (``part``) and the heading lines (``clause``) of a text up to each line.

    As in ``ordered_scan``, but lines travel packed and what a chunk inherits, a row for ``CHUNK_ROWS`` lines, is broadcast.
    """
    chunked = lines.withColumn("chunk", int_chunk("pos"))
    before = W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = chunked.groupBy("file", "chunk").agg(F.count_if(F.col("line") == "").alias("part"), F.count_if("head").alias("clause"))
    ahead = counts.select("file", "chunk", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}s_ahead") for c in ("part", "clause")))
    kinds = T.StructType([*chunked.schema.fields, T.StructField("part", T.LongType()), T.StructField("clause", T.LongType())])
    local = packed_fold(chunked, ["file", "chunk"], ["pos"], _count_lines, kinds).join(F.broadcast(ahead), ["file", "chunk"])
    return local.select(*lines.columns, (F.col("part") + F.col("parts_ahead")).alias("part"), (F.col("clause") + F.col("clauses_ahead")).alias("clause"))


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order of (file, chunk, pos) with the empty and the heading lines of their chunk so far."""
    key, last = None, [0, 0]
    for batch in batches:
        new = new_keys(batch, ["file", "chunk"], key)
        group = np.cumsum(new)
        counts = []
        for k, mark in enumerate((pc.equal(batch.column("line"), ""), batch.column("head"))):
            sums = np.cumsum(mark.to_numpy(zero_copy_only=False).astype(np.int64))
            # sums ahead of each key; the first may go on from the batch before
            base = np.concatenate([[-last[k]], np.concatenate([[0], sums])[:-1][new]])
            counts.append(sums - base[group])
            last[k] = int(counts[-1][-1])
        key = [batch.column(c)[-1].as_py() for c in ("file", "chunk")]
        columns = {n: batch.column(n) for n in batch.schema.names if n != "__h"}
        yield pa.RecordBatch.from_pydict(columns | {"part": pa.array(counts[0]), "clause": pa.array(counts[1])})


def _clean(line: str) -> Column:
    """A line without the carriage return in front of its line feed."""
    return F.regexp_replace(line, r"\r\z", "")


def _typed_paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraphs (contract_id, file, pos, type, confidence) of lines, as ``zone_paragraphs`` types those of whole texts.

    A clause-like start may reach over line feeds, to the next line with text or the one after it; what it
    finds there are numbers and the word 조.  So these few properties of lines are looked up, not lines.
    """
    line, left = F.col("line"), F.ltrim(F.col("line"), F.lit(BLANKS))
    named = {"digit": r"^\s*\d", "dotted": r"^\s*\d+\.\d", "article": r"^\s*\d+\s*조", "number": r"^\s*\d+\s*\z", "word": r"^\s*조"}
    open_ends = {"keyword": r"(?im)^\s*(Article|Section|Clause)\s*\z", "ko": r"(?m)^\s*제\s*\z", "ko_number": r"(?m)^\s*제\s*\d+\s*\z"}
    looks = F.struct(F.col("part"), *(line.rlike(rx).alias(n) for n, rx in named.items())).alias("looks")
    # a paragraph is stripped, so its first line counts without leading blanks
    ends = [F.struct(F.regexp_count(c, F.lit(CLAUSE_STARTS)).alias("n"), *(c.rlike(rx).alias(n) for n, rx in open_ends.items())) for c in (line, left)]
    solid = lines.where(line.rlike(r"\S")).select("contract_id", "file", "pos", "part", looks, ends[0].alias("own"), ends[1].alias("bare"), (strip(line) != "").alias("text"))
    near = ordered_scan(solid, ["file"], ["pos"], {"n1": following(F.col("looks"))}, int_chunk("pos"))
    near = ordered_scan(near, ["file"], ["pos"], {"n2": following(F.col("n1"))}, int_chunk("pos"))
    at = lambda c, name: F.coalesce((F.col(f"{c}.part") == F.col("part")) & F.col(f"{c}.{name}"), F.lit(False))

    def starts(c: str) -> Column:
        keyword = F.col(f"{c}.keyword") & at("n1", "digit")
        ko = F.col(f"{c}.ko") & (at("n1", "article") | (at("n1", "number") & at("n2", "word")))
        # the number behind a keyword is no start of its own
        return F.col(f"{c}.n") + (keyword & ~at("n1", "dotted")).cast("int") + (ko | (F.col(f"{c}.ko_number") & at("n1", "word"))).cast("int")

    found = near.groupBy("contract_id", "file", "part").agg(
        F.sum(starts("own")).alias("n"), F.min(F.when(F.col("text"), F.col("pos"))).alias("at"), F.min_by(starts("bare") - starts("own"), F.when(F.col("text"), F.col("pos"))).alias("more")
    )
    found = lean_cut(found.where("at is not null").select("contract_id", "file", "at", (F.col("n") + F.col("more")).alias("starts")), "paragraphs")
    numbered = ordered_scan(found, ["file"], ["at"], {"pos": running_sum(F.lit(1))}, int_chunk("at")).withColumn("pos", (F.col("pos") - 1).cast("int"))
    first = lines.select("file", F.col("pos").alias("at"), left.alias("text"))
    return zone_paragraphs(numbered.join(first, ["file", "at"]), starts=F.col("starts")).select("contract_id", "file", "pos", "type", "confidence")


def _line_clauses(lines: DataFrame) -> DataFrame:
    """Clauses (contract_id, clause, text, needs_review) of lines, as ``split_clauses_text`` cuts whole texts."""
    filled = F.coalesce(F.max(~F.col("head") & (strip(F.col("line")) != "")), F.lit(False))
    held = lean_cut(lines.groupBy("file", "clause").agg(filled.alias("filled")), "clauses")
    kept = ordered_scan(held.where("filled"), ["file"], ["clause"], {"no": running_sum(F.lit(1))}, int_chunk("clause")).select("file", "clause", "no")
    # a clause's number goes ahead of its lines
    empty = {"contract_id": F.lit(None).cast(lines.schema["contract_id"].dataType), "pos": F.lit(-1), "head": F.lit(False), "line": F.lit("")}
    rows = lines.select("file", "clause", "contract_id", "pos", "head", _clean("line").alias("line"), F.lit(None).cast("long").alias("no"))
    rows = rows.unionByName(kept.withColumns(empty))
    kinds = T.StructType([rows.schema["contract_id"], T.StructField("no", T.LongType()), T.StructField("opened", T.BooleanType()), T.StructField("l", T.ArrayType(T.StringType()))])
    made = packed_fold(rows, ["file", "clause"], ["pos"], _lines_of_clauses, kinds).withColumn("needs_review", F.lit(False))
    # without a clause the whole text is one
    bare = held.groupBy("file").agg(F.max("filled").alias("any")).where("not any").select("file")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("pos", _clean("line").alias("line")))), lambda x: x["line"])
    whole = lines.join(F.broadcast(bare), "file", "left_semi").groupBy("contract_id", "file").agg(texts.alias("l")).drop("file")
    made = made.unionByName(whole.withColumns({"no": F.lit(1).cast("long"), "opened": F.lit(False), "needs_review": F.lit(True)}))
    joined = lambda c: strip(F.array_join(c, "\n"))
    text = F.when(F.col("opened"), F.concat(strip(F.get("l", F.lit(0))), F.lit("\n"), joined(F.slice("l", F.lit(2), F.size("l"))))).otherwise(joined(F.col("l")))
    return lean_cut(made.select("contract_id", F.concat(F.lit("clause-"), F.col("no").cast("string")).alias("clause"), text.alias("text"), "needs_review"), "texts")


def _lines_of_clauses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each clause that has a number, which is its first row, and whether a heading opens it."""
    for rows, at in whole_keys(batches, ["file", "clause"]):
        pos = rows.column("pos").to_numpy()
        numbered, sizes = pos[at] < 0, np.diff(at, append=len(pos))
        if not numbered.any():
            continue
        lines = rows.column("line").filter(pa.array(np.repeat(numbered, sizes) & (pos >= 0)))
        ends = np.concatenate([[0], np.cumsum(sizes[numbered] - 1)]).astype(np.int32)
        at, first = pa.array(at[numbered]), pa.array(at[numbered] + 1)
        out = {"contract_id": rows.column("contract_id").take(first), "no": rows.column("no").take(at), "opened": rows.column("head").take(first)}
        yield pa.RecordBatch.from_pydict(out | {"l": pa.ListArray.from_arrays(pa.array(ends), lines)})


def publish_stream(spark: SparkSession, path: str, sink: str, text: Callable[[Column], Column] = plain_text, contract: Column | None = None) -> StreamingQuery:
    """Watch a folder; parse accepted files and publish their contracts, zones and clauses below ``sink``.

    ``published`` reads them.  A contract in several files has to come in one batch.  Every micro-batch is published under its own number, so repeating one replaces it
    and changes nothing.  Files that are no contracts go to ``sink/rejected`` with the reason; ``sink/counts``
    has a row per batch: files, accepted, rejected and damaged ones, as observed while
    the batch was written.  ``contract`` gives a file's id from its ``path`` (default: a hash of it).
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = fitting_content(spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path))
    key = (F.xxhash64("path") if contract is None else contract).cast("long").alias("contract_id")

    def write(batch: DataFrame, number: int) -> None:
        here = f"batch_id={number}"
        heads = batch.select(key, "path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.substring("content", 1, 4).alias("head"), "content")
        checked = validate_files(heads)
        seen = Observation(f"intake-{number}")
        slim = checked.select("contract_id", "name", "length", "reject_reason").observe(
            seen, F.count(F.lit(1)).alias("files"), F.count_if(F.col("reject_reason").isNull()).alias("accepted"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected")
        )
        listed = lean_cut(slim, "listed")
        listed.where("reject_reason is not null").write.mode("overwrite").parquet(f"{sink}/rejected/{here}")
        parsed = parse_files(checked.where("accepted").select("contract_id", "name", "path", "content"), text(F.col("content")))
        with no_shuffle_kept(spark):
            publish_contract_tables(parsed["contracts"], parsed["zones"], parsed["clauses"], f"{sink}/published", batch=str(number))
        counts = seen.get | {"damaged": parsed["damaged"].count()}
        names = ["files", "accepted", "rejected", "damaged"]
        spark.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"{n} long" for n in names)).coalesce(1).write.mode("overwrite").parquet(f"{sink}/counts/{here}")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", f"{sink}/_state").trigger(availableNow=True).start()


#: Columns that ``publish_stream`` publishes; a batch without a row of a table leaves no file to find them in.
PUBLISHED = {
    "contracts": "contract_id long, name string, status string",
    "document_zones": "contract_id long, zone_index long, zone_type string, page_from int, page_to int, confidence double, is_analysis_target boolean",
    "clauses": "contract_id long, clause string, text string, needs_review boolean",
}


def published(spark: SparkSession, sink: str, table: str) -> DataFrame:
    """A table that ``publish_stream`` has published below ``sink``, empty if no batch had a row for it."""
    return spark.read.schema(PUBLISHED[table]).parquet(f"{sink}/published/{table}")


def file_sink(stream: DataFrame, sink: str, routes: dict[str, str] | None = None, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Write every micro-batch to its own folder, so a repeated batch replaces itself.

    Everything available is processed unless ``trigger`` says otherwise; a stream whose state
    expires never runs out of batches and needs a trigger of its own.
    """

    # keyed state needs a store that keeps several states of a key
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(batch: DataFrame, batch_id: int) -> None:
        for name, condition in (routes or {"rows": "true"}).items():
            batch.where(condition).write.mode("overwrite").parquet(f"{sink}/{name}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{sink}/_state")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_available(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Process everything available and return the written rows.

    With ``keys`` the newest version of every key is returned, which turns an
    update-mode stream into the table it maintains.
    """
    spark = stream.sparkSession
    sink = scratch_path(spark, name)
    query = file_sink(stream, sink, mode=mode)
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{sink}/rows").schema(
        stream.schema.add("batch_id", "long")
    ).parquet(f"{sink}/rows")
    if not keys:
        return rows.drop("batch_id")
    rest = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("v"))
    return newest.select(*keys, "v.*")


def latest_status_stream(events: DataFrame) -> DataFrame:
    """Current status per contract; run it in update mode."""
    return (
        events.groupBy("contract_id")
        .agg(F.max(F.struct("ts", "seq", "status")).alias("e"))
        .select("contract_id", "e.status", "e.ts")
    )


def quota_stream(calls: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Calls per model and quota day (it starts at 08:00 UTC)."""
    day = F.window("ts", "1 day", "1 day", "8 hours")
    return (
        calls.withWatermark("ts", delay)
        .groupBy("model_key", day.alias("day"))
        .agg(F.count(F.lit(1)).alias("used"))
        .select("model_key", F.col("day.start").alias("day_start"), "used")
    )


def rate_stream(calls: DataFrame, limits: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Calls per model in sliding minutes, and whether they exceed the model's limit.

    ``limits`` is a static table (model_key, minute_limit); a model without a limit never exceeds it.
    """
    minute = F.window("ts", "1 minute", "10 seconds")
    counted = calls.withWatermark("ts", delay).groupBy("model_key", minute.alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    joined = counted.join(limits.select("model_key", "minute_limit"), "model_key", "left")
    too_many = F.coalesce(F.col("calls") > F.col("minute_limit"), F.lit(False))
    return joined.select("model_key", F.col("w.start").alias("window_start"), "calls", too_many.alias("too_many"))


#: Rows of a key that are turned into Python values, or written, at once.
PIECE_ROWS = 50_000


def _in_order(chunks: Iterator[pd.DataFrame], columns: list[str], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of one key in the order of ``columns``, ``names`` only, as frames of ``PIECE_ROWS``.

    The rows of a key in a micro-batch are held as flat columns, some tens of bytes a row.
    """
    whole = pd.concat([c[names] for c in chunks], ignore_index=True)
    order = np.lexsort([whole[c].to_numpy() for c in columns[::-1]])
    for at in range(0, len(order), PIECE_ROWS):
        yield whole.take(order[at : at + PIECE_ROWS])


class _Interval(StatefulProcessor):
    """The last call of a model; a model without calls for ``ttl_ms`` is forgotten."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts_ms long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        first = next(rows)
        model, least = first["model_key"].iloc[0], first["min_interval_ms"].iloc[0]
        for part in _in_order(chain([first], rows), ["ts_ms", "event_id"], ["ts_ms", "event_id"]):
            ms = part["ts_ms"].astype("int64").to_numpy()
            gap = np.diff(ms, prepend=ms[0] if last is None else last)
            known = np.arange(len(ms)) >= (last is None)
            close = known & (gap < least) if not pd.isna(least) else np.zeros(len(ms), bool)
            last = int(ms[-1])
            yield pd.DataFrame({"event_id": part["event_id"].to_numpy(), "model_key": model, "gap_ms": pd.arrays.IntegerArray(gap, ~known), "too_close": close})
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


def interval_stream(calls: DataFrame, limits: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Gap of every call to the model's call before it, and whether that is below the model's least interval.

    Keyed state holds one time per model and crosses micro-batches; inside a batch the
    calls of a model are taken in order of (ts, event_id).  A call that arrives in a later batch
    than a call after it has a negative gap and counts as too close.  ``limits`` is a static table (model_key, min_interval_ms);
    a model without a limit is never too close.  With ``ttl_ms`` the state of a silent model expires.
    """
    timed = calls.select("event_id", "model_key", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    joined = timed.join(limits.select("model_key", F.col("min_interval_ms").cast("long").alias("min_interval_ms")), "model_key", "left")
    mode = "ProcessingTime" if ttl_ms else "None"
    return joined.groupBy("model_key").transformWithStateInPandas(_Interval(ttl_ms), "event_id long, model_key string, gap_ms long, too_close boolean", "append", mode)


def dedup_stream(clauses: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """First clause of every content hash within the TTL."""
    return clauses.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["content_hash"])


class _Throttle(StatefulProcessor):
    """The last kept value of a contract and its time; a contract without rows for ``ttl_ms`` is forgotten."""

    def __init__(self, wait_ms: int, ttl_ms: int | None):
        self.wait_ms, self.ttl_ms = wait_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "ts_ms long, percent int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last_ms, last = self.kept.get() if self.kept.exists() else (None, None)
        kept = False
        for part in _in_order(rows, ["ts_ms", "event_id"], ["contract_id", "event_id", "ts", "ts_ms", "percent"]):
            out = []
            for i, (ms, percent) in enumerate(zip(part["ts_ms"].tolist(), part["percent"].tolist())):
                if percent != last and (last_ms is None or ms - last_ms >= self.wait_ms):
                    last_ms, last = int(ms), int(percent)
                    out.append(i)
            if out:
                kept = True
                yield part.iloc[out][["contract_id", "event_id", "ts", "percent"]]
        if kept:
            self.kept.update((last_ms, last))

    def close(self) -> None:
        pass


def throttle_stream(progress: DataFrame, seconds: int = 3, ttl_ms: int | None = None) -> DataFrame:
    """Changed values only, at most one per ``seconds`` since the last kept one.

    Keyed state holds the last kept value of a contract; inside a micro-batch its rows are
    taken in order of (ts, event_id).  With ``ttl_ms`` the state of a silent contract expires.
    Rows without a value are left out.  ``maxFilesPerTrigger`` on the source bounds a batch.
    """
    ts = F.col("ts").cast("timestamp")
    typed = progress.where("percent is not null").select(
        F.col("contract_id").cast("long").alias("contract_id"), "event_id", ts.alias("ts"), F.unix_millis(ts).alias("ts_ms"), F.col("percent").cast("int").alias("percent")
    )
    mode = "ProcessingTime" if ttl_ms else "None"
    return typed.groupBy("contract_id").transformWithStateInPandas(
        _Throttle(seconds * 1000, ttl_ms), "contract_id long, event_id long, ts timestamp, percent int", "append", mode
    )
