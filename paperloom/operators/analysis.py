"""Reference similarity, analysis queue, answer ingestion, run planning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..functions.vectors import unit, unit_dot
from ..plans.scan import int_chunk, ordered_scan, running_sum
from .filters import RISK_LEVELS, risk_level

# Reference clauses, in rank order.
REFERENCE_CLAUSES = [
    ("8.7", "Sub-Clause 8.7", "Delay Damages"),
    ("14.1", "Sub-Clause 14.1", "Contract Price"),
    ("17.1", "Sub-Clause 17.1", "Indemnities"),
    ("4.1", "Sub-Clause 4.1", "Contractor's General Obligations"),
    ("20.1", "Sub-Clause 20.1", "Claims"),
]

# Summary without text, model name of a missing answer, length of a long clause.
NO_SUMMARY = "(분석 없음)"
STUB_MODEL = "gemini-flash-stub"
LONG_CLAUSE = 2000

# Error texts and what they mean.
KEY_INVALID = ["API_KEY_INVALID", "401", "invalid API key", "API key not valid"]
QUOTA = ["429", "RESOURCE_EXHAUSTED", "resource_exhausted", "quota", "Quota exceeded", "limit: 0"]
RETRYABLE = ["503", "Service Unavailable", "high demand"]

BLOCK_ROWS = 512
SALTS = 64


def score_references(clauses: DataFrame, refs: DataFrame, k: int | None = None) -> DataFrame:
    """(clause_id, ref_id, ref_rank, score) by cosine similarity, best ``k`` per clause.

    Both sides are brought to unit length once.  References travel as arrays of at
    most ``BLOCK_ROWS`` vectors; a clause meets each array once, by a salt that
    spreads the clauses over all tasks, and keeps the best ``k`` inside the row.
    Whether the arrays are broadcast is left to their measured size.
    """
    packed = (
        refs.withColumns({"block": F.floor(F.col("ref_rank") / BLOCK_ROWS), "u": unit(F.col("vector"))})
        .groupBy("block")
        .agg(F.array_sort(F.collect_list(F.struct("ref_rank", "ref_id", "u"))).alias("refs"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    left = clauses.select("clause_id", unit(F.col("vector")).alias("u"), F.pmod(F.xxhash64("clause_id"), F.lit(SALTS)).cast("int").alias("salt"))
    scored = F.transform(
        "refs", lambda r: F.struct((-unit_dot(F.col("u"), r["u"])).alias("neg"), r["ref_rank"].alias("ref_rank"), r["ref_id"].alias("ref_id"))
    )
    best = F.array_sort(scored) if k is None else F.slice(F.array_sort(scored), 1, k)
    flat = left.join(packed, "salt").select("clause_id", F.explode(best).alias("s")).select(
        "clause_id", "s.ref_id", "s.ref_rank", (-F.col("s.neg")).alias("score")
    )
    return flat if k is None else top_references(flat, k).drop("rank")


#: Bytes of reference vectors that may go with every task; more of them are met by a join.
MOST_REF_BYTES = 64 << 20
#: References of one ball; scores are compared with nine places, so this much is added to every bound.
BALL_REFS, BOUND_SLACK = 64, 1e-8


@dataclass(frozen=True)
class Balls:
    """Unit vectors of references in balls: each ball's rows, centroid and radius."""

    vectors: np.ndarray
    ranks: np.ndarray
    ends: np.ndarray
    centroids: np.ndarray
    radii: np.ndarray

    @classmethod
    def build(cls, vectors: np.ndarray, ranks: np.ndarray) -> Balls:
        """Halves the rows between two far ones until ``BALL_REFS`` are left."""
        order, ends, todo = [], [], [np.arange(len(vectors))]
        while todo:
            rows = todo.pop()
            x = vectors[rows]
            if len(rows) <= BALL_REFS:
                order.append(rows)
                ends.append(len(rows))
                continue
            one = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            two = x[((x - one) ** 2).sum(axis=1).argmax()]
            side = np.argsort(x @ (one - two), kind="stable")
            todo += [rows[side[: len(rows) // 2]], rows[side[len(rows) // 2 :]]]
        at, ends = np.concatenate(order), np.cumsum(ends)
        vectors, ranks = vectors[at], ranks[at]
        parts = np.split(vectors, ends[:-1])
        centroids = np.array([p.mean(axis=0) for p in parts])
        radii = np.array([np.sqrt(((p - c) ** 2).sum(axis=1).max()) for p, c in zip(parts, centroids)])
        return cls(vectors, ranks, ends, centroids, radii)

    def top(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions of the ``k`` best references of each unit vector, their scores, and how many pairs were scored.

        The ball with the nearest centroid is scored first; after it only balls whose
        bound (centroid's score plus radius) reaches the k-th best score so far.
        """
        n, k = len(queries), min(k, len(self.vectors))
        near = queries @ self.centroids.T
        score, place = np.full((n, k), -np.inf), np.full((n, k), -1)
        pairs = 0
        starts = np.r_[0, self.ends[:-1]]
        first = (near + self.radii).argmax(axis=1)

        def offer(ball: int, rows: np.ndarray) -> None:
            nonlocal pairs
            lo, hi = starts[ball], self.ends[ball]
            pairs += len(rows) * int(hi - lo)
            new = np.round(queries[rows] @ self.vectors[lo:hi].T, 9)
            both = np.concatenate([score[rows], new], axis=1)
            at = np.concatenate([place[rows], np.broadcast_to(np.arange(lo, hi), new.shape)], axis=1)
            rank = np.where(at >= 0, self.ranks[at], np.iinfo(np.int64).max)
            best = np.lexsort((rank, -both), axis=1)[:, :k]
            score[rows], place[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(at, best, 1)

        for ball in np.unique(first):
            offer(ball, np.flatnonzero(first == ball))
        for ball in range(len(self.ends)):
            rows = np.flatnonzero((near[:, ball] + self.radii[ball] + BOUND_SLACK >= score[:, -1]) & (first != ball))
            if len(rows):
                offer(ball, rows)
        return place, score, pairs


def nearest_references(clauses: DataFrame, refs: DataFrame, k: int = 3) -> DataFrame:
    """(clause_id, ref_id, ref_rank, rank, score): the ``k`` best references of each clause by cosine similarity.

    The same rows as ``top_references(score_references(...))``, scores compared with nine places and
    ties in reference order, but without scoring all pairs: references lie in balls, and an Arrow
    batch of clauses skips the balls whose bound is too low.  References that take more than
    ``MOST_REF_BYTES`` are met by the join instead.  Clauses without a vector, or with one of zeros, are left out.
    """
    held = refs.where("vector is not null")
    total = held.agg(F.coalesce(F.sum(F.size("vector") * 8), F.lit(0))).first()[0]
    if total > MOST_REF_BYTES:
        return top_references(score_references(clauses.where("vector is not null"), held, k), k).select("clause_id", "ref_id", "ref_rank", "rank", "score")
    rows = held.select("ref_id", F.col("ref_rank").cast("long").alias("ref_rank"), "vector").toArrow()
    schema = T.StructType([clauses.schema["clause_id"], refs.schema["ref_id"]]).add("ref_rank", "long").add("rank", "integer").add("score", "double")
    if not rows.num_rows:
        return clauses.sparkSession.createDataFrame([], schema)
    unit_rows = _unit_rows(rows.column("vector"))
    kept = np.flatnonzero(np.abs(unit_rows).sum(axis=1) > 0)
    ids = rows.column("ref_id").combine_chunks()
    ranks = rows.column("ref_rank").to_numpy()
    order = np.argsort(ranks[kept], kind="stable")
    kept = kept[order]
    balls = Balls.build(unit_rows[kept], np.arange(len(kept)))
    shared = clauses.sparkSession.sparkContext.broadcast((balls, ids.take(pa.array(kept)), ranks[kept]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls, ids, ranks = shared.value
        for batch in batches:
            q = _unit_rows(batch.column(1))
            own = np.flatnonzero(np.abs(q).sum(axis=1) > 0)
            place, score, _ = balls.top(q[own], k)
            number = balls.ranks[place]  # of the reference in order of rank
            width = place.shape[1]
            at, flat = pa.array(np.repeat(own, width)), number.ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), ids.take(pa.array(flat)), pa.array(ranks[flat]), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(own))), pa.array(score.ravel())],
                names=["clause_id", "ref_id", "ref_rank", "rank", "score"],
            )

    return clauses.where("vector is not null").select("clause_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, schema)


def _unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length 1; a vector of zeros stays as it is."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def top_references(scores: DataFrame, k: int = 3) -> DataFrame:
    """Best ``k`` references per clause; ties keep the reference order."""
    w = W.partitionBy("clause_id").orderBy(F.desc("score"), "ref_rank")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fallback_references(clauses: DataFrame, refs: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` references for clauses without text or vector."""
    missing = clauses.where(F.col("vector").isNull() | (strip(F.coalesce("text", F.lit(""))) == "")).select("clause_id")
    first = refs.where(F.col("ref_rank") < k).select(
        "ref_id", "ref_rank", (F.lit(1.0) - F.col("ref_rank") * F.lit(0.1)).alias("score")
    )
    # k rows per clause, matched by rank; the other side has k rows at most
    slots = missing.withColumn("ref_rank", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return slots.join(F.broadcast(first), "ref_rank").select("clause_id", "ref_id", "ref_rank", "score")


def analysis_queue(clauses: DataFrame, top_refs: DataFrame) -> DataFrame:
    """Work rows for the external scorer: prompt, long-clause flag, re-check flag.

    A long clause goes out in pieces of ``LONG_CLAUSE`` characters, numbered from 0,
    so the scorer sees the whole text; every piece repeats the references.
    """
    line = F.concat(F.lit("- "), F.col("reference"), F.lit(": "), F.col("ref_text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"])
    block = top_refs.groupBy("clause_id").agg(F.array_join(lines, "\n").alias("__refs"))
    joined = clauses.join(block, "clause_id", "left")
    is_long = F.length("text") > LONG_CLAUSE
    last = F.greatest(F.lit(0), F.floor((F.coalesce(F.length("text"), F.lit(0)) - 1) / LONG_CLAUSE)).cast("long")
    joined = joined.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    body = F.substring(F.col("text"), (F.col("piece_no") * LONG_CLAUSE + 1).cast("int"), F.lit(LONG_CLAUSE))
    head = F.when(F.col("__refs").isNotNull(), F.concat(F.lit("Compare with:\n"), "__refs", F.lit("\n\n"))).otherwise("")
    return joined.select(
        "clause_id",
        "piece_no",
        F.concat(head, F.lit("Clause:\n"), body).alias("prompt"),
        is_long.alias("is_long"),
        F.coalesce(F.col("risk_level") == "high", F.lit(False)).alias("needs_recheck"),
    )


def ingest_answers(raw: DataFrame, rechecks: DataFrame) -> DataFrame:
    """Model answers -> analysis rows; malformed answers become stubs.

    A second opinion replaces the level ``high`` only when it differs and is
    more than 70 % confident.
    """
    a = F.from_json(
        "answer",
        "riskSummary variant, recommendations variant, fidicComparison variant, riskLevel variant",
        {"mode": "PERMISSIVE"},
    )
    b = F.from_json("answer", "riskLevel variant, confidence variant", {"mode": "PERMISSIVE"})

    def text(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    second = rechecks.select(
        "clause_id",
        text(b["riskLevel"]).alias("__level2"),
        F.coalesce(F.try_variant_get(b["confidence"], "$", "double"), F.lit(0.0)).alias("__conf2"),
    )
    comparison = F.coalesce(text(F.col("__a.fidicComparison")), F.to_json("__a.fidicComparison"))
    parsed = (
        raw.withColumn("__a", a)
        .withColumns(
            {
                "__level": text(F.col("__a.riskLevel")),
                "__sum": F.coalesce(text(F.col("__a.riskSummary")), F.lit("")),
                "__rec": F.coalesce(text(F.col("__a.recommendations")), F.lit("")),
                "__cmp": F.when(comparison != "null", comparison),
            }
        )
        .join(second, "clause_id", "left")
    )
    override = (
        (F.col("__level") == "high")
        & F.col("__level2").isin([r for r in RISK_LEVELS if r != "high"])
        & (F.col("__conf2") > 0.7)
    )
    level = F.when(override, F.col("__level2")).otherwise(F.col("__level"))
    answered = F.coalesce(F.try_parse_json("answer").isNotNull(), F.lit(False)) & F.col("__a").isNotNull()
    return parsed.select(
        "clause_id",
        risk_level(level, F.col("__sum")).alias("risk_level"),
        F.when(F.col("__sum") == "", NO_SUMMARY).otherwise(F.col("__sum")).alias("risk_summary"),
        F.col("__rec").alias("recommendations"),
        F.col("__cmp").alias("comparison"),
        F.when(answered, F.coalesce("model", F.lit(STUB_MODEL))).otherwise(STUB_MODEL).alias("model"),
    )


def classify_errors(log: DataFrame, message: str = "message") -> DataFrame:
    """Add ``error_class``: key_invalid, quota, retryable or other."""

    def any_of(words: list[str]) -> Column:
        test = F.lit(False)
        for w in words:
            test = test | F.col(message).contains(w)
        return F.coalesce(test, F.lit(False))

    return log.withColumn(
        "error_class",
        F.when(any_of(KEY_INVALID), "key_invalid")
        .when(any_of(QUOTA), "quota")
        .when(any_of(RETRYABLE), "retryable")
        .otherwise("other"),
    )


def reuse_analyses(
    clauses: DataFrame, analyses: DataFrame, now: Column, ttl: str = "24 hours"
) -> tuple[DataFrame, DataFrame]:
    """Clauses whose content was analysed within the TTL, and those to analyse.

    The newest analysis per hash is found first, so a text that occurs very
    often adds one row to the join, and AQE splits its clauses.
    """
    fresh = analyses.where(F.col("created_at") > now - F.expr(f"interval {ttl}"))
    newest = fresh.groupBy("content_hash").agg(F.max(F.struct("created_at", "analysis_id", "risk_level")).alias("a"))
    found = newest.select("content_hash", "a.analysis_id", "a.risk_level")
    hits = clauses.join(found, "content_hash")
    misses = clauses.join(found.select("content_hash"), "content_hash", "left_anti")
    return hits, misses


def route_model(tasks: DataFrame, routes: DataFrame, chain: DataFrame, quota: DataFrame) -> DataFrame:
    """Model of a task: its route while it has quota, else the first of its chain that has."""
    left = quota.select("model_key", "remaining")
    usable = chain.join(left, "model_key").where(F.col("remaining") > 0)
    first = usable.groupBy("chain").agg(F.min_by("model_key", "rank").alias("fallback_key"))
    routed = tasks.join(routes, "task_type", "left").join(left, "model_key", "left").join(first, "chain", "left")
    return routed.withColumn(
        "chosen_key", F.when(F.coalesce("remaining", F.lit(0)) > 0, F.col("model_key")).otherwise(F.col("fallback_key"))
    ).drop("remaining", "fallback_key")


def plan_analysis_run(pending: DataFrame, quota: DataFrame, budget_s: int = 270, step_s: int = 6) -> DataFrame:
    """Which pending clauses fit the time budget and the quota of a run."""
    numbered = ordered_scan(
        pending,
        ["contract_id"],
        ["sort_order", "clause_id"],
        {"__n": running_sum(F.lit(1))},
        int_chunk("sort_order"),
    ).join(quota.select("contract_id", "remaining"), "contract_id", "left")
    picked = (F.col("__n") * step_s <= budget_s) & (F.col("__n") <= F.coalesce("remaining", F.lit(0)))
    chosen = numbered.withColumn("selected", picked)
    status = chosen.groupBy("contract_id").agg(
        F.when(F.min("selected"), "ready").otherwise("partial").alias("run_status")
    )
    return chosen.drop("__n", "remaining").join(status, "contract_id")
