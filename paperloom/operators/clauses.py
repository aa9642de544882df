"""Clauses: plain-text split, shaping from sections, hierarchy, quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.headings import heading_remainder_kind, text_heading
from ..functions.lines import clean_ghost_tables, reflow_paragraphs
from ..functions.numbering import annotate_numbering, strip_numbering
from ..functions.text import content_hash, strip
from ..functions.zoning import analysis_target
from ..plans.scan import Step, following, int_chunk, last_before, ordered_scan, page_chunk, running_sum
from ..plans.scratch import cut
from .sections import cut_at_lines, resplit_pieces

CONTRACT = ["contract_id"]
READING = ["page_start", "section_index"]
LEVELS = 10


def split_clauses_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Clauses of a plain text: a heading line opens one.

    A heading without any text below it is dropped.  A document without a
    clause keeps its whole text as one clause that needs review.  The split
    happens inside the row.
    """
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n", "\n")
    parts = docs.withColumn("__cuts", cut_at_lines(body, lambda x, p: text_heading(x)))

    def clause(x, i):
        title = F.when(i > 0, strip(F.split(x, "\n")[0]))
        rest = F.when(i > 0, F.regexp_replace(x, r"^[^\n]*\n?", "")).otherwise(x)
        return F.struct(title.alias("title"), strip(rest).alias("body"))

    found = F.filter(F.transform("__cuts", clause), lambda c: c["body"] != "")
    shaped = F.transform(
        found,
        lambda c: F.struct(
            F.when(c["title"].isNull(), c["body"]).otherwise(F.concat(c["title"], F.lit("\n"), c["body"])).alias("text"),
            F.lit(False).alias("needs_review"),
        ),
    )
    whole = F.array(F.struct(strip(body).alias("text"), F.lit(True).alias("needs_review")))
    staged = parts.withColumn("__found", shaped)
    rows = F.when(F.size("__found") > 0, F.col("__found")).otherwise(whole)
    return staged.select("doc_id", F.posexplode(rows).alias("pos", "c")).select(
        "doc_id",
        F.concat(F.lit("clause-"), (F.col("pos") + 1).cast("string")).alias("clause"),
        "c.text",
        "c.needs_review",
    )


def with_intro_flag(sections: DataFrame) -> DataFrame:
    """Analysed and preamble sections with numbering hint and intro flag.

    Introductory are all preamble sections and, in every other zone, the
    sections before its first numbered one.
    """
    hint = F.col("zone_hint")
    wanted = sections.where(analysis_target(F.when(hint != "", hint)) | F.coalesce(hint == "preamble", F.lit(False)))
    hinted = annotate_numbering(wanted.withColumn("zone", F.coalesce("zone_hint", F.lit("contract_body"))), "heading")
    pos = F.struct(*READING)
    firsts = hinted.groupBy("contract_id", "zone").agg(
        F.min(pos).alias("zone_first"), F.min(F.when(F.col("hint").isNotNull(), pos)).alias("__num")
    )
    joined = hinted.join(firsts, ["contract_id", "zone"])
    return joined.withColumn(
        "is_intro", (F.col("zone") == "preamble") | F.coalesce(F.struct(*READING) < F.col("__num"), F.lit(False))
    ).drop("__num")


def _intro_text():
    h, b = F.coalesce("heading", F.lit("")), strip(F.coalesce("content", F.lit("")))
    return F.when((h != "") & (b != ""), F.concat(h, F.lit("\n"), b)).when(h != "", h).otherwise(b)


def _intro_number():
    return F.when(F.col("zone") == "preamble", "preamble-1").otherwise(F.concat("zone", F.lit("-intro")))


def merge_zone_intros(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One clause per zone introduction, and the sections that remain."""
    flagged = with_intro_flag(sections)
    intro = flagged.where(F.col("is_intro")).withColumn("__t", _intro_text())
    texts = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("__t") != "", F.struct(*READING, F.col("__t"))))), lambda x: x["__t"]
    )
    clauses = (
        intro.groupBy("contract_id", "zone", "zone_first")
        .agg(F.array_join(texts, "\n\n").alias("content"), F.min_by("page_start", F.struct(*READING)).alias("page_start"))
        .where(F.col("content") != "")
        .withColumn("clause_number", _intro_number())
    )
    return clauses, flagged.where(~F.col("is_intro"))


def with_parent_number(
    clauses: DataFrame, order: list[str] | None = None, chunk=None, more: dict[str, Step] | None = None
) -> DataFrame:
    """Add ``parent_clause_number`` from the numbering hint.

    Dotted numbers lose their last part; list items hang below the latest
    other number; the rest below the nearest earlier number of a lower level,
    unless that one is a schedule.  ``more`` adds running values to the pass.
    """
    order = order or READING
    chunk = page_chunk() if chunk is None else chunk
    h = F.col("hint")
    item = h["kind"].isin("alpha_paren", "roman_paren")
    here = F.struct(*order, h["level"].alias("lv"), h["normalized"].alias("num"))
    level = F.least(h["level"], F.lit(LEVELS - 1))
    steps = {"__num": last_before(F.when(h.isNotNull() & ~item, h["normalized"]))}
    steps |= {f"__l{k}": last_before(F.when(level == k, here)) for k in range(LEVELS)}
    scanned = ordered_scan(clauses, CONTRACT, order, {**steps, **(more or {})}, chunk)
    below = F.greatest(*[F.when(level > k, F.col(f"__l{k}")) for k in range(LEVELS)])
    nearest = F.when((h["level"] > 1) & (below["lv"] >= 1), below["num"])
    dotted = h["normalized"].rlike(r"^\d+(?:\.\d+)+$")
    parent = (
        F.when(h.isNull(), None)
        .when(item, F.col("__num"))
        .when(dotted, F.regexp_replace(h["normalized"], r"\.[^.]*$", ""))
        .otherwise(nearest)
    )
    return scanned.withColumn("parent_clause_number", parent).drop(*steps)


def shape_clauses(sections: DataFrame) -> DataFrame:
    """Sections -> clause records in their final order.

    Introductions come first, in the order in which their zones appear; the
    other sections follow in reading order, each as one clause or as the
    pieces of its second-pass split.

    All ordering is decided on a narrow table (numbers, flags, piece counts)
    that is cut off once; the texts are read beside it and joined by key.
    """
    body = strip(F.coalesce("content", F.lit("")))
    keys = ["contract_id", *READING]
    counted = sections.select(
        *keys,
        "heading",
        "zone_hint",
        F.coalesce(F.size(resplit_pieces(body)), F.lit(1)).alias("n"),
        ((body != "") | (F.coalesce("heading", F.lit("")) != "")).alias("filled"),
    )
    flags = cut(
        with_intro_flag(counted)
        .where(F.col("filled"))
        .select(*keys, "zone", "zone_first", "is_intro", "hint", "n")
    )
    intros = _intro_clauses(sections, flags.where(F.col("is_intro")))
    n_intro = (
        flags.where(F.col("is_intro"))
        .select("contract_id", "zone")
        .distinct()
        .groupBy("contract_id")
        .agg(F.count(F.lit(1)).alias("__intros"))
    )
    numbered = with_parent_number(flags.where(~F.col("is_intro")), more={"__upto": running_sum(F.col("n"))})
    starts = numbered.join(n_intro, "contract_id", "left").select(
        *keys,
        "hint",
        "parent_clause_number",
        (F.coalesce("__intros", F.lit(0)) + F.col("__upto") - F.col("n")).alias("__start"),
    )
    texts = sections.select(*keys, "heading", "zone_hint", body.alias("__body"))
    shaped = _section_clauses(texts.join(starts, keys)).unionByName(intros)
    cleaned = shaped.withColumn("content", clean_ghost_tables(F.col("content")))
    return reflow_paragraphs(cleaned, "content").withColumn("content_hash", content_hash(F.col("content")))


def _section_clauses(placed: DataFrame) -> DataFrame:
    """One row per section, or one per piece of a section that is split again."""
    whole = F.array(F.struct(F.lit(None).cast("string").alias("number"), F.col("__body").alias("text")))
    rows = placed.withColumn("__subs", F.coalesce(resplit_pieces(F.col("__body")), whole)).select(
        "*", F.posexplode("__subs").alias("__sub", "__p")
    )
    piece = F.col("__p.number").isNotNull()
    line = F.split(F.col("__p.text"), "\n")[0]
    staged = rows.withColumns({"__piece": piece, "__line": F.when(piece, line).otherwise(F.col("heading"))})
    staged = staged.withColumn(
        "__rem", F.when(F.col("__piece"), strip_numbering(F.col("__line"))).otherwise(F.col("hint.remainder"))
    ).withColumn("__kind", F.when(F.col("__rem").isNotNull(), heading_remainder_kind(F.col("__rem"))))
    piece, rem = F.col("__piece"), F.col("__rem")
    has_heading = F.coalesce(F.col("heading") != "", F.lit(False))
    kind = F.when(piece | has_heading, F.col("__kind"))
    title = F.when(rem != "", rem).otherwise(F.col("__line"))
    bare = strip(F.regexp_replace(F.regexp_replace(title, r"^\[", ""), r"\]$", ""))
    clean = F.when(title.startswith("["), bare).otherwise(title)
    place = F.col("__start") + F.col("__sub")
    fallback = F.concat(
        F.coalesce("zone_hint", F.lit("general")),
        F.when(has_heading, F.lit("-")).otherwise(F.lit("-auto-")),
        (place + 1).cast("string"),
    )
    text = F.col("__p.text")
    with_heading = strip(F.concat("heading", F.lit("\n"), text))
    return staged.select(
        "contract_id",
        place.alias("order_index"),
        F.coalesce(F.col("__p.number"), F.col("hint.normalized"), fallback).alias("clause_number"),
        F.when(piece, F.regexp_replace(F.col("__p.number"), r"\.[^.]*$", ""))
        .otherwise(F.col("parent_clause_number"))
        .alias("parent_clause_number"),
        F.when(piece, F.when(kind == "title", F.substring(title, 1, 120)))
        .otherwise(
            F.substring(
                F.when(kind == "body", None).when(kind == "title", clean).when(has_heading, F.col("heading")), 1, 200
            )
        )
        .alias("title"),
        F.when(~piece & (kind == "body"), with_heading).otherwise(text).alias("content"),
        (piece | ~has_heading).alias("is_auto_split"),
        F.when(piece, F.coalesce("zone_hint", F.lit("general_conditions"))).otherwise(F.col("zone_hint")).alias("zone_key"),
        "page_start",
        F.when(kind == "body", "numbered_untitled")
        .when(kind == "title", "numbered_titled")
        .otherwise("unnumbered")
        .alias("clause_structure"),
    )


def _intro_clauses(sections: DataFrame, intro: DataFrame) -> DataFrame:
    """Numbered introduction clauses from the flagged sections."""
    zones = intro.groupBy("contract_id", "zone").agg(F.min("zone_first").alias("__first"))
    order = ["__p", "__i"]
    keyed = zones.select("contract_id", "zone", F.col("__first.page_start").alias("__p"), F.col("__first.section_index").alias("__i"))
    placed = ordered_scan(keyed, CONTRACT, order, {"__n": running_sum(F.lit(1))}, page_chunk("__p"))
    texts = sections.select("contract_id", *READING, _intro_text().alias("__t"))
    joined = intro.select("contract_id", *READING, "zone").join(texts, ["contract_id", *READING])
    items = F.transform(F.array_sort(F.collect_list(F.struct(*READING, "__t"))), lambda x: x["__t"])
    clauses = joined.groupBy("contract_id", "zone").agg(
        F.array_join(items, "\n\n").alias("content"), F.min("page_start").alias("page_start")
    )
    return clauses.join(placed, ["contract_id", "zone"]).select(
        "contract_id",
        (F.col("__n") - 1).alias("order_index"),
        _intro_number().alias("clause_number"),
        F.lit(None).cast("string").alias("parent_clause_number"),
        F.lit(None).cast("string").alias("title"),
        "content",
        F.lit(False).alias("is_auto_split"),
        F.col("zone").alias("zone_key"),
        "page_start",
        F.lit("unnumbered").alias("clause_structure"),
    )


def quality_rules(clauses: DataFrame) -> DataFrame:
    """Contracts with too few, too many, too short or flagged clauses."""
    n = F.count(F.lit(1))
    return clauses.groupBy("contract_id").agg(
        (~n.between(1, 1500) | F.max(F.length(strip(F.col("text"))) < 100) | F.max("needs_review")).alias("needs_review")
    )


def document_review_flag(rules: DataFrame, scores: DataFrame, warnings: DataFrame) -> DataFrame:
    """Review is needed by rule, for a score below one half, or with warnings."""
    # a missing score says nothing; least and greatest would skip it and give 0
    s = scores.where("score is not null").select("contract_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias("__s"))
    w = warnings.select("contract_id").distinct().withColumn("__w", F.lit(True))
    joined = rules.join(s, "contract_id", "left").join(w, "contract_id", "left")
    return joined.select(
        "contract_id",
        (
            F.col("needs_review") | F.coalesce(F.col("__s") < 0.5, F.lit(False)) | F.col("__w").isNotNull()
        ).alias("needs_review"),
    )


def dominant_language(clauses: DataFrame, profiles: DataFrame) -> DataFrame:
    """Language of a contract from the character trigrams of all its clauses.

    Every clause ends with a line feed, and trigrams across clauses count
    too: its last two characters and the first two of the text behind it
    hold those.  So only ends of texts are put in order, and whole texts stay
    where they are.  Scores are sums over trigrams, so counts of parts of a
    contract are weighted as they come.
    """
    text = F.concat(F.lower(F.coalesce("text", F.lit(""))), F.lit("\n"))
    order = ["sort_order", "clause_id"]
    ends = cut(clauses.select("contract_id", *order, F.substring(text, 1, 2).alias("__h"), F.substring(text, -2, 2).alias("__e")), "ends")
    # the next two characters may come from two clauses when one is empty
    ahead = ordered_scan(ends, CONTRACT, order, {"__n1": following(F.col("__h"))}, int_chunk("sort_order"))
    ahead = ordered_scan(ahead, CONTRACT, order, {"__n2": following(F.col("__n1"))}, int_chunk("sort_order"))
    tail = F.substring(F.concat(F.coalesce("__n1", F.lit("")), F.coalesce("__n2", F.lit(""))), 1, 2)
    texts = clauses.select("contract_id", text.alias("__t")).unionByName(ahead.select("contract_id", F.concat("__e", tail).alias("__t")))
    scored = (
        gram_counts(texts, "contract_id", "__t")
        .join(profiles, "gram")
        .groupBy("contract_id", "lang")
        .agg(F.sum(F.col("n") * F.col("weight")).alias("__score"))
    )
    return scored.groupBy("contract_id").agg(F.max_by("lang", F.struct("__score", "lang")).alias("lang"))


#: Characters counted at once.
GRAM_CHARS = 2_000_000


def gram_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, n): overlapping character trigrams, counted inside a batch, so a key adds each of its trigrams once a batch.

    A trigram is the number of its three code points, 21 bits each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(t or "") for t in batch.column(1).to_pylist()])
            at = 0
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + GRAM_CHARS, "right")))
                yield from _grams_of(batch.slice(at, to - at), key)
                at = to

    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    return texts.select(key, text).mapInArrow(run, schema)


def _grams_of(batch: pa.RecordBatch, key: str) -> Iterator[pa.RecordBatch]:
    """A key and a trigram are one number to sort, of as few bits as the characters at hand need."""
    codes = batch.column(0).dictionary_encode(null_encoding="encode")
    texts = [t or "" for t in batch.column(1).to_pylist()]
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    place = np.zeros(0x110000, np.uint64)
    place[chars] = 1
    alphabet = np.flatnonzero(place)
    place[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    bits = max(len(alphabet) - 1, 1).bit_length()
    if 3 * bits + (len(codes.dictionary) - 1).bit_length() > 64:  # never so for one row
        half = batch.num_rows // 2
        yield from _grams_of(batch.slice(0, half), key)
        yield from _grams_of(batch.slice(half), key)
        return
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    whole = np.flatnonzero(row[2:] == row[:-2])
    code, owner = place[chars], codes.indices.to_numpy(zero_copy_only=False).astype(np.uint64)
    b, low = np.uint64(bits), np.uint64((1 << bits) - 1)
    gram = ((owner[row[whole]] << b | code[whole]) << b | code[whole + 1]) << b | code[whole + 2]
    gram.sort()
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
    n, gram = np.diff(np.r_[first, len(gram)]), gram[first]
    one, two, three = (alphabet[(gram >> np.uint64(i * bits) & low).astype(np.int64)] for i in (2, 1, 0))
    keys = codes.dictionary.take(pa.array((gram >> np.uint64(3 * bits)).astype(np.int64)))
    yield pa.RecordBatch.from_arrays([keys, pa.array(one << 42 | two << 21 | three), pa.array(n.astype(np.int64))], names=[key, "gram", "n"])


def language_profiles(texts: DataFrame) -> DataFrame:
    """Weights of all character trigrams of labelled texts."""
    pieces = gram_counts(texts.select("lang", F.lower("text").alias("text")), "lang", "text")
    counts = pieces.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("weight"))
