"""A scorer between the analysis queue and the answers.

Pieces of clauses go through a chain of scorers in Arrow batches.  A scorer is a
function from prompts to answers with a model of its own, which travels as a
broadcast.  What one scorer can't answer goes to the next; what none can answer stays
as a row with the error, so nothing is lost and nothing stops the job.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .analysis import KEY_INVALID
from .filters import RISK_LEVELS

#: Prompts that a scorer gets at once.
BATCH_PROMPTS = 256


@dataclass(frozen=True)
class Scorer:
    """``score(model, prompts)`` gives one JSON text a prompt; an exception in place of a text is that row's failure."""

    name: str
    score: Callable[[Any, list[str]], list[str | Exception]]
    model: Any = None


def _answers(scorer: Scorer, model: Any, prompts: list[str]) -> list[str | Exception]:
    """Answers of a batch; where the scorer fails as a whole, row by row."""
    try:
        out = scorer.score(model, prompts)
        if len(out) != len(prompts):
            raise ValueError(f"{len(out)} answers to {len(prompts)} prompts")
    except Exception as e:  # noqa: BLE001 - a failure is a row, whatever it is
        if len(prompts) == 1:
            return [e]
        return [x for p in prompts for x in _answers(scorer, model, [p])]
    checked: list[str | Exception] = []
    for x in out:
        try:
            checked.append(x if isinstance(x, Exception) else json.dumps(json.loads(x), ensure_ascii=False))
        except (TypeError, ValueError) as e:
            checked.append(ValueError(f"answer is not JSON: {e}"))
    return checked


def score_pieces(queue: DataFrame, chain: list[Scorer], prompt: str = "prompt", batch: int = BATCH_PROMPTS) -> DataFrame:
    """Adds ``answer`` (JSON), ``model`` (name of the scorer that gave it) and ``error`` to every row of ``queue``.

    The scorers are asked in order, each for the rows that the one before failed on; an
    invalid key ends the chain for a row.  Rows that none answered have a null
    answer and model and the last error, others a null error.  A null prompt is an empty one.
    Columns of these names in ``queue`` are replaced.
    """
    added = {"answer": T.StringType(), "model": T.StringType(), "error": T.StringType()}
    rows = queue.drop(*added)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, k) for n, k in added.items())])
    sc = queue.sparkSession.sparkContext
    models = [sc.broadcast(s.model) for s in chain]
    bare = [Scorer(s.name, s.score) for s in chain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                prompts = [p or "" for p in part.column(part.schema.get_field_index(prompt)).to_pylist()]
                out: list[tuple] = [(None, None, "no scorer")] * len(prompts)
                open_rows = list(range(len(prompts)))
                for scorer, model in zip(bare, models):
                    if not open_rows:
                        break
                    failed = []
                    for i, x in zip(open_rows, _answers(scorer, model.value, [prompts[i] for i in open_rows])):
                        if isinstance(x, Exception):
                            out[i] = (None, None, f"{scorer.name}: {x}")
                            if not any(w in str(x) for w in KEY_INVALID):
                                failed.append(i)
                        else:
                            out[i] = (x, scorer.name, None)
                    open_rows = failed
                columns = [pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 3
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *added])

    return rows.mapInArrow(run, schema)


def worst_answers(scored: DataFrame) -> DataFrame:
    """(clause_id, answer, model): of a clause's pieces the answer with the highest risk, of equal ones the first piece.

    A clause with a piece that nobody answered keeps the best of the others; one without
    any answer has nulls, which the ingestion turns into a stub.
    """
    level = F.lower(F.get_json_object("answer", "$.riskLevel"))
    place = F.lit(len(RISK_LEVELS))
    for i, name in enumerate(RISK_LEVELS):
        place = F.when(level == name, i).otherwise(place)
    ranked = F.struct(F.col("answer").isNull().alias("none"), place.alias("place"), "piece_no")
    best = scored.groupBy("clause_id").agg(F.min_by(F.struct("answer", "model"), ranked).alias("b"))
    return best.select("clause_id", "b.answer", "b.model")


# ---------------------------------------------------------------- a model of words

#: Buckets of words; the model is this many numbers however large the corpus is.
BUCKETS = 4096
#: Fixed: a word of the model.
WORD = r"[A-Za-z]{2,}"
#: Mean weight of a prompt's words (in thousandths) from which it is of medium and of high risk.
MEDIUM, HIGH = 0, 60


def bucket(word: Column) -> Column:
    return F.conv(F.substring(F.md5(F.lower(word).cast("binary")), 1, 3), 16, 10).cast("int")


def learn_word_model(texts: DataFrame, text: str = "text", risky: str = "risky") -> np.ndarray:
    """Log odds (in thousandths) of a bucket's words in risky texts against the others, counted by text.

    One aggregation over words; only ``BUCKETS`` pairs of counts reach the driver.
    """
    words = texts.where(F.col(risky).isNotNull()).select(F.col(risky).cast("int").alias("y"), F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({WORD})"), 1), bucket)).alias("w"))
    counts = words.select("y", F.explode("w").alias("w")).groupBy("w").agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no")).toArrow()
    yes, no = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts.column("w").to_numpy()
    yes[at], no[at] = counts.column("yes").to_numpy(), counts.column("no").to_numpy()
    return np.floor(1000 * np.log((yes + 1) / (no + 1))).astype(np.int64)


_find = re.compile(WORD).findall
_buckets: dict[str, int] = {}


def word_risk(model: np.ndarray, prompts: list[str]) -> list[str | Exception]:
    """Risk by the mean weight of a prompt's words; a prompt without words is a failure."""
    out: list[str | Exception] = []
    if len(_buckets) > 1_000_000:
        _buckets.clear()
    for p in prompts:
        words = _find(p)
        if not words:
            out.append(ValueError("no words"))
            continue
        for w in words:
            if w not in _buckets:
                _buckets[w] = int(hashlib.md5(w.lower().encode()).hexdigest()[:3], 16)
        mean = int(sum(int(model[_buckets[w]]) for w in words)) // len(words)
        level = "high" if mean >= HIGH else "medium" if mean >= MEDIUM else "low"
        out.append(json.dumps({"riskLevel": level, "riskSummary": f"mean weight {mean}", "recommendations": "", "fidicComparison": None}))
    return out


def short_prompts(limit: int, score: Callable[[Any, list[str]], list[str | Exception]]) -> Callable[[Any, list[str]], list[str | Exception]]:
    """A scorer that takes prompts up to ``limit`` characters and fails on longer ones."""

    def run(model: Any, prompts: list[str]) -> list[str | Exception]:
        fits = [p for p in prompts if len(p) <= limit]
        answers = iter(score(model, fits) if fits else [])
        return [next(answers) if len(p) <= limit else ValueError("RESOURCE_EXHAUSTED: prompt too long") for p in prompts]

    return run
