"""The corpus pipeline: five stages, each on what the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a table, which is written as
Parquet to the shared folder and read again as the next stage's ``docs``.  Rows are
told apart by their content, so rows with a null or repeated id are handled too.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import boosted_quality, bpe, decontaminate, line_winnow, ngram_join
from paperloom.llm.queries import table
from paperloom.llm.textkit import held_out, row_key
from paperloom.plans.scratch import cut

#: A document of a lower score is rejected.
LEAST_SCORE = 0.3
#: Share of its words that a document must keep when repeated lines are deleted from it; of a copy that is as similar
#: as a near duplicate (0.8) less is left.
LEAST_LEFT = 0.2
#: Bytes of a batch on its way to a Python worker and back.  Spark's 10,000 rows of text are held several times in an
#: executor, outside its heap; rows are handled by themselves, so the size of a batch changes no result.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` from now on, in the whole session: plans take the setting when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier holds for bad; it learns as op2 does, but from the documents at hand."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    scored = boosted_quality.score(docs, boosted_quality.learn(docs, labels), name="_score")
    return scored.where(F.col("_score") >= LEAST_SCORE).drop("_score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; ``n_chars``, where there is one, becomes the new length.

    A document of which less than ``LEAST_LEFT`` of its words is left was a copy of others:
    what remains of it are the words in which it differs, no document, and goes too.  Documents of which
    nothing was deleted all stay, empty ones included.
    """
    small_batches(spark)
    out = line_winnow.dedup_lines(docs)
    left, gone = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.col("n_removed_words")
    out = out.where((gone == 0) | (left >= LEAST_LEFT * (left + gone)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group (5-word shingles, similarity 0.8), and all without a word.

    It is the row with the smallest id, null ids last, of equal ids the one with the
    least key of id and text, of equal rows any one; so nothing depends on ids being there or different.
    """
    small_batches(spark)
    rows = ngram_join.row_components(docs).where("component is not null").groupBy("component", "doc_id", "key").count()
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "count")).alias("_f"))
    keep = cut(first.select(F.col("_f.key").alias("_in"), (F.col("_f.count") > 1).alias("_more")), "keep")
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.withColumns({"_key": row_key(F.col("doc_id"), F.col("text")), "_blank": blank})
    single = keyed.join(keep, F.col("_key") == F.col("_in"), "left").where(F.col("_blank") | ~F.col("_more"))
    # few ids repeat with their text as a rule: only these rows are compared as a whole
    several = keyed.where(~F.col("_blank")).join(keep.where("_more"), F.col("_key") == F.col("_in")).dropDuplicates(["_key"])
    return single.select(docs.columns).unionByName(several.select(docs.columns))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    small_batches(spark)
    return decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).drop("leaks")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    small_batches(spark)
    return bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"), keep=("doc_id",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("bpe encoding and decoding", tokens),
]

#: SQL cannot express the stages; tests compare them with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
