"""Readers and source-shaped transformations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..plans.packed import new_keys, packed_fold, ranks, sort_keys

# Accepted upload types and the size limit.
MAX_FILE_BYTES = 50 * 1024 * 1024

PARSE_SCHEMA = """
contract_id long, total_pages int, warnings array<string>,
sections array<struct<heading:string,level:int,content:string,page_start:int,page_end:int,zone_hint:string,is_toc:boolean>>,
document_parts array<struct<part_type:string,title:string,page_start:int,page_end:int,section_count:int>>,
toc_entries array<struct<title:string,page_number:int,level:int,numbering:string>>,
sub_documents array<struct<title:string,page_start:int,page_end:int>>
"""


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """File name, size and first bytes; the content itself is not kept."""
    return file_heads(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def file_heads(raw: DataFrame) -> DataFrame:
    """Name, size and first bytes of binary files; of files of a wrong size only the metadata is read."""
    name, fits = F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").between(1, MAX_FILE_BYTES)
    opened = raw.where(fits).select(name, "length", F.substring("content", 1, 4).alias("head"))
    return opened.unionByName(raw.where(~fits).select(name, "length", F.lit(None).cast("binary").alias("head")))


def fitting_content(raw: DataFrame) -> DataFrame:
    """Binary files; the content of files of a wrong size is null and not read."""
    fits = F.col("length").between(1, MAX_FILE_BYTES)
    return raw.where(fits).unionByName(raw.where(~fits).withColumn("content", F.lit(None).cast("binary")))


def validate_files(files: DataFrame) -> DataFrame:
    """Add ``accepted`` and the first failing rule as ``reject_reason``."""
    name = F.lower("name")
    head = F.hex("head")
    return files.withColumn(
        "reject_reason",
        F.when(~(name.endswith(".pdf") | name.endswith(".docx")), "extension")
        .when(~F.coalesce(F.col("length").between(1, MAX_FILE_BYTES), F.lit(False)), "size")
        .when(name.endswith(".pdf") & ~head.startswith("25504446"), "magic_pdf")
        .when(name.endswith(".docx") & ~head.startswith("504B"), "magic_docx"),
    ).withColumn("accepted", F.col("reject_reason").isNull())


def read_parse_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nested parser output as flat tables; list positions become index columns."""
    raw = spark.read.schema(PARSE_SCHEMA).json(path)
    return {name: flatten_parse(raw, field, index) for name, field, index in PARSE_LISTS}


PARSE_LISTS = [
    ("sections", "sections", "section_index"),
    ("parts", "document_parts", "part_index"),
    ("toc", "toc_entries", "entry_index"),
    ("subdocs", "sub_documents", "subdoc_index"),
]


def flatten_parse(raw: DataFrame, field: str, index: str) -> DataFrame:
    return raw.select("contract_id", F.posexplode(field).alias(index, "item")).select("contract_id", index, "item.*")


def read_page_lines(spark: SparkSession, path: str) -> DataFrame:
    """Pages with nested lines -> one row per line in (page, y0, x0) order."""
    pages = spark.read.parquet(path)
    return pages.select("contract_id", "page", F.col("height").alias("page_height"), F.posexplode("lines").alias("line_no", "l")).select(
        "contract_id", "page", "page_height", "line_no", "l.*"
    )


def words_to_lines(items: DataFrame) -> DataFrame:
    """Group positioned text items of a page into lines.

    An item joins the current line when its baseline lies within
    max(2, 0.4 x font size) of the line's first item, so the line number
    depends on the previous decision: the sorted items of a page pass one by one.
    The items of a line are next to each other in that order, so a line is put together
    where it ends, and items are shuffled once, as packed columns.
    """
    top = F.col("page_height") - F.col("ty")
    boxes = {"x0": F.col("tx"), "y0": top - F.col("font_size"), "x1": F.col("tx") + F.col("width"), "y1": top + F.col("font_size") * 0.2}
    kinds = items.select(*(c.alias(n) for n, c in boxes.items())).schema
    numbers = {n: F.col(n) for n in ("page_height", "tx", "width", "font_size")} | {"down": -F.col("ty")}
    words = items.select(*LINE_KEYS, "seq", F.col("text").cast("string").alias("text"), F.lower("font_name").contains("bold").alias("bold"), *(c.cast("double").alias(n) for n, c in numbers.items()))
    fields = [T.StructField(k, items.schema[k].dataType) for k in LINE_KEYS] + [T.StructField("line_no", T.IntegerType()), T.StructField("text", T.StringType())]
    fields += [T.StructField(n, T.DoubleType()) for n in (*boxes, "font_size")] + [T.StructField("is_bold", T.BooleanType())]
    lines = packed_fold(words, LINE_KEYS, ["down", "tx", "seq"], _fold_lines, T.StructType(fields))
    lines = lines.withColumns({"text": strip(F.col("text"))} | {n: F.col(n).cast(kinds[n].dataType) for n in boxes})
    return lines.where(F.col("text") != "")


LINE_KEYS = ["contract_id", "page"]


def _fold_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of items that come in order of (contract_id, page, -ty, tx, seq)."""
    key, anchor, line, open_line = None, None, -1, -1
    held: list[pa.RecordBatch] = []  # the items of the line that has not ended
    for batch in batches:
        size, sized = _numbers(batch.column("font_size"))
        reaches = np.where(sized, np.maximum(2.0, size * 0.4), 2.0).tolist()
        starts, numbers = [], []
        for i, (new, y, reach) in enumerate(zip(new_keys(batch, LINE_KEYS, key).tolist(), _values(batch.column("down")), reaches)):
            if new:
                anchor, line = None, -1
            if anchor is None or y is None or not abs(y - anchor) <= reach:
                anchor, line = y, line + 1
                starts.append(i)
                numbers.append(line)
        key = [batch.column(k)[-1].as_py() for k in LINE_KEYS]
        if not starts:
            held.append(batch)
            continue
        ahead = sum(h.num_rows for h in held)
        at = [0] * bool(ahead) + [s + ahead for s in starts[:-1]]
        if at:
            yield _whole_lines(pa.concat_batches([*held, batch.slice(0, starts[-1])]), np.array(at), [open_line] * bool(ahead) + numbers[:-1])
        held, open_line = [batch.slice(starts[-1])], numbers[-1]
    if held:
        yield _whole_lines(pa.concat_batches(held), np.array([0]), [open_line])


def _whole_lines(rows: pa.RecordBatch, at: np.ndarray, numbers: list[int]) -> pa.RecordBatch:
    """One row for each of the lines that begin at ``at``; nulls and NaN count as in Spark's aggregates."""
    starts = pa.array(at)
    out = {k: rows.column(k).take(starts) for k in LINE_KEYS} | {"line_no": pa.array(numbers, pa.int32())}
    text = rows.column("text").take(pa.array(_reading_order(rows, np.repeat(np.arange(len(at)), np.diff(at, append=rows.num_rows)))))
    found = np.add.reduceat(text.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), at)
    ends = pa.array(np.concatenate([[0], np.cumsum(found)]).astype(np.int32))
    out["text"] = pc.binary_join(pa.ListArray.from_arrays(ends, text.drop_null()), " ")
    (tx, has_tx), (width, has_width), (size, sized), (height, has_height), (down, has_down), (bold, has_bold) = (
        _numbers(rows.column(n)) for n in ("tx", "width", "font_size", "page_height", "down", "bold")
    )
    top, has_top = height + down, has_height & has_down
    out["x0"] = _extreme(np.fmin, tx, has_tx, at)
    out["y0"] = _extreme(np.fmin, top - size, has_top & sized, at)
    out["x1"] = _extreme(np.fmax, tx + width, has_tx & has_width, at)
    out["y1"] = _extreme(np.fmax, top + size * 0.2, has_top & sized, at)
    for name, value, valid in (("font_size", size, sized), ("is_bold", bold, has_bold)):
        n = np.add.reduceat(valid.astype(np.int64), at)
        mean = np.add.reduceat(np.where(valid, value, 0.0), at) / np.maximum(n, 1)
        out[name] = pa.array(mean if name == "font_size" else mean >= 0.5, mask=n == 0)
    return pa.RecordBatch.from_pydict(out)


def _extreme(best: np.ufunc, value: np.ndarray, valid: np.ndarray, at: np.ndarray) -> pa.Array:
    """Least or greatest value from each of ``at`` to the next; NaN is the greatest number."""
    most = best.reduceat(np.where(valid, value, np.nan), at)
    if best is np.fmax:
        most = np.where(np.logical_or.reduceat(valid & np.isnan(value), at), np.nan, most)
    return pa.array(most, mask=~np.logical_or.reduceat(valid, at))


def _reading_order(rows: pa.RecordBatch, line: np.ndarray) -> np.ndarray:
    """Order of (line, tx, seq, text), nulls first and NaN last."""
    keys = [line, *sort_keys(rows.column("tx")), *sort_keys(rows.column("seq"))]
    order = np.lexsort(keys[::-1])
    again = np.ones(len(order) - 1, bool)
    for k in (k[order] for k in keys):
        again &= (k[1:] == k[:-1]) | ((k[1:] != k[1:]) & (k[:-1] != k[:-1]))
    return np.lexsort([ranks(rows.column("text")), *keys[::-1]]) if again.any() else order


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values as floats, 0 where there is none, and which there are."""
    return column.cast(pa.float64()).fill_null(0.0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)


def _values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy().tolist()


def split_text(docs: DataFrame, unit: str = "line", text: str = "text") -> DataFrame:
    """Non-empty lines or paragraphs with their position."""
    pattern = r"\r?\n" if unit == "line" else r"\n{2,}"
    kept = F.filter(F.transform(F.split(text, pattern), strip), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(kept).alias("pos", "text"))


def read_table(
    spark: SparkSession, path: str, cols: list[str], where: dict[str, object], order: list[str]
) -> DataFrame:
    """Column list, equality keys and order; all of it reaches the parquet scan."""
    df = spark.read.parquet(path).select(*cols)
    df = reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), where.items(), df)
    return df.orderBy(*order) if order else df


def merge_batches(dfs: list[DataFrame | None], offsets: list[int]) -> DataFrame:
    """Union page batches of one parse; failed batches (None) drop out."""
    shifted = [
        df.withColumns({c: F.col(c) + F.lit(off) for c in ("page_start", "page_end")})
        for df, off in zip(dfs, offsets)
        if df is not None
    ]
    return reduce(DataFrame.unionByName, shifted)
