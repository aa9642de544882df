"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans.scratch import scratch_path

from . import ball_search, boosted_quality, bpe, contextual_pii, decontaminate, host_reputation, language_id, line_winnow, ngram_join, piece_prefix, prefix_trie, quality_rules, warc
from .textkit import held_out

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed by the contract of op1.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is the quality label that bears its id."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    outcomes = pages.join(labels, pages.page_id == labels.doc_id).select(host_reputation.url_part(F.col("url"), 1).alias("host"), F.col("quality").alias("good"))
    return host_reputation.judge_urls(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"), 5, 0)
    trees = boosted_quality.learn(docs, table(spark, sf_dir, "labels").where(~held))
    scored = boosted_quality.score(docs, trees)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"), keep=("doc_id",))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    warc.write_archives(pages, path)
    rows = warc.resolved(warc.read_archives(spark, path))
    kind = pages.schema["page_id"].dataType
    return rows.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of the fixed forms."""
    found = contextual_pii.find_pii(table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(contextual_pii.KINDS)]
    base, spans = contextual_pii.spans_text(F.col("base")), contextual_pii.spans_text(F.col("spans"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"), 4, 2)
    model = language_id.learn(docs.where(~held))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_winnow.dedup_lines(docs).select("doc_id", "n_removed_lines", "n_removed_words", "text")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    docs = decontaminate.with_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op11_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_piece_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_prefix.encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256"), keep=("doc_id",))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation takes its head from the one whose id is the next lower multiple of five."""
    trie = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), lambda c: c - c % 5, lambda c: F.crc32(c.cast("string").cast("binary")) % 9)
    nodes = trie.nodes.join(trie.digests(), list(prefix_trie.KEY), "left")
    ends = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_host_reputation,
        op2_boosted_quality,
        op3_bpe_round_trip,
        op4_warc_round_trip,
        op5_contextual_pii,
        op6_ngram_join,
        op7_language_id,
        op8_line_dedup,
        op9_quality_rules,
        op10_decontaminate,
        op11_ball_search,
        op12_piece_prefix,
        op13_prefix_trie,
    )
}
