"""Language identification in two steps: the language family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import mix, pieces, row_key, text_bytes

#: Language families by language code; a language without one is in the family "other".
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg".split(),
    "uralic": "fi et hu se".split(),
    "turkic": "tr az kk uz tt".split(),
    "semitic": "ar he mt am".split(),
    "sinitic": "zh yue wuu".split(),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
#: Most labelled rows that training reads; of more, those with the least hash of their id; equal rows count once.
SAMPLE = 6_000
DIMS = 2048
EPOCHS, BATCH, REGULAR = 30, 32, 1e-5
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not (65 <= i <= 90 or 97 <= i <= 122)]] = 32  # what is no letter separates words
_LETTER = regex.compile(r"\p{L}").search


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams (1 to 3) of whole texts, square roots of counts at unit length; and which texts have a letter."""
    data, offsets = text_bytes(column)
    out = np.zeros((len(offsets) - 1, DIMS), np.float32)
    letters = np.zeros(len(out), bool)
    for lo, hi in pieces(offsets):
        part = offsets[lo : hi + 1] - offsets[lo]
        raw = data[offsets[lo] : offsets[hi]]
        x = _FOLD[raw].astype(np.uint32)
        code = (x + 1).copy()
        two = np.full(len(x), 0, np.uint32)
        three = np.full(len(x), 0, np.uint32)
        two[:-1] = 0x10000 | x[:-1] << 8 | x[1:]
        three[:-2] = 0x1000000 | x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        both = two[:-1] == 0x12020 if len(x) > 1 else np.zeros(0, bool)  # runs of separators count once
        cells = []
        for c in (code, two, three):
            h = mix(c.astype(np.uint64)) >> np.uint64(64 - 11)
            cells.append(h.astype(np.int64))
        skip = np.zeros(len(x), bool)
        skip[:-1] = both
        skip[part[1:][part[1:] > 0] - 1] = False  # the byte behind a row's last one is another row's
        for r in range(hi - lo):
            a, b = part[r], part[r + 1]
            ok = ~skip[a:b]
            count = np.zeros(DIMS)
            for k, c in enumerate(cells):
                end = max(a, b - k)
                count += np.bincount(c[a:end][ok[: end - a]], minlength=DIMS)
            v = np.sqrt(count)
            out[lo + r] = v / max(1e-9, np.linalg.norm(v))
            letters[lo + r] = bool(((x[a:b] >= 97) & (x[a:b] <= 122)).any()) or _LETTER(raw[a:b].tobytes().decode("utf-8", "replace")) is not None
    return out, letters


def linear_svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (hinge loss, averaged mini-batch subgradient steps); y is -1 or 1."""
    rng = np.random.default_rng(3)
    w, b, steps = np.zeros(x.shape[1]), 0.0, 0
    mean_w, mean_b = np.zeros_like(w), 0.0
    share = {s: 0.5 / max(1e-9, (y == s).mean()) for s in (-1.0, 1.0)}
    weight = np.where(y > 0, share[1.0], share[-1.0])
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            at = order[i : i + BATCH]
            steps += 1
            rate = 1 / (REGULAR * (steps + 1000))
            bad = y[at] * (x[at] @ w + b) < 1
            pull = (y[at] * weight[at] * bad) / len(at)
            w = (1 - rate * REGULAR) * w + min(rate, 20.0) * (pull @ x[at])
            b += min(rate, 20.0) * 0.1 * pull.sum()
            if epoch >= EPOCHS // 2:
                mean_w += w
                mean_b += b
    kept = max(1, steps - EPOCHS // 2 * -(-len(y) // BATCH))
    return mean_w / kept, mean_b / kept


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Languages:
    """Families with one-versus-rest weights, and weights of every pair of languages of a family."""

    families: list[str]
    members: dict[str, list[str]]
    family_w: np.ndarray  # families x dims
    family_b: np.ndarray
    pairs: dict[str, tuple[list[tuple[int, int]], np.ndarray, np.ndarray]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each row: share of the family times the language's share of pair votes."""
        if not self.families:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        margin = _sigmoid(2 * (x @ self.family_w.T + self.family_b))
        best = margin.argmax(axis=1)
        score = margin[np.arange(len(x)), best] / np.maximum(margin.sum(axis=1), 1e-9)
        out = np.empty(len(x), object)
        for i, name in enumerate(self.families):
            rows = np.flatnonzero(best == i)
            own = self.members[name]
            if len(own) == 1 or not len(rows):
                out[rows] = own[0]
                continue
            ends, w, b = self.pairs[name]
            p = _sigmoid(2 * (x[rows] @ w.T + b))
            votes = np.zeros((len(rows), len(own)))
            for k, (one, two) in enumerate(ends):
                votes[:, one] += p[:, k]
                votes[:, two] += 1 - p[:, k]
            pick = votes.argmax(axis=1)
            out[rows] = np.array(own, object)[pick]
            score[rows] *= votes[np.arange(len(rows)), pick] / (len(own) - 1)
        return out.tolist(), np.clip(score, 0, 1)


def fit(x: np.ndarray, lang: list[str]) -> Languages:
    """Both levels from features and language codes; one family or one language needs no SVM."""
    code = np.array(lang, object)
    family = np.array([_FAMILY.get(c, "other") for c in lang], object)
    names = sorted(set(family))
    members = {f: sorted(set(code[family == f])) for f in names}
    rest = [linear_svm(x, np.where(family == f, 1.0, -1.0)) if len(names) > 1 else (np.zeros(x.shape[1]), 0.0) for f in names]
    model = Languages(names, members, np.array([w for w, _ in rest]), np.array([b for _, b in rest]))
    for f in names:
        ends = list(combinations(range(len(members[f])), 2))
        fits = []
        for one, two in ends:
            at = np.flatnonzero((code == members[f][one]) | (code == members[f][two]))
            fits.append(linear_svm(x[at], np.where(code[at] == members[f][one], 1.0, -1.0)))
        if ends:
            model.pairs[f] = ends, np.array([w for w, _ in fits]), np.array([b for _, b in fits])
    return model


def learn(docs: DataFrame, sample: int = SAMPLE, text: str = "text") -> Languages:
    """A model from rows (doc_id, ``text``, lang); null ids and languages and texts without a letter teach nothing.

    At most ``sample`` different rows are used, however often an id or a row repeats.  Their
    features reach the driver, ``sample`` times ``DIMS`` half floats.
    """
    taught = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col(text).isNotNull()).select("doc_id", F.col(text).alias("text"), "lang")
    taught = taught.withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    ids = taught.select(F.xxhash64(F.col("doc_id").cast("string")).alias("h"), "key", "lang").distinct()
    chosen = ids.orderBy("h", "key", "lang").limit(sample).select("key", "lang")
    rows = taught.join(F.broadcast(chosen), ["key", "lang"]).groupBy("key", "lang").agg(F.first("text").alias("text")).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, letters = features(batch.column(0))
            data = [row.tobytes() for row in x.astype(np.float16)]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), batch.column(1)], names=["x", "lang"]).filter(pa.array(letters))

    got = rows.mapInArrow(run, "x binary, lang string").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, DIMS).astype(np.float32)
    lang = got.column("lang").to_pylist()
    order = np.lexsort((x.sum(axis=1), x[:, 1], np.array(lang, str))) if lang else []
    return fit(x[order], [lang[i] for i in order]) if len(lang) else Languages([], {}, np.zeros((0, DIMS)), np.zeros(0))


def predict(docs: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1) of every row's whole text; columns of these names are replaced.

    A null text, or one without a letter, is ``und`` with score 0.  Rows are judged
    by themselves, repeated ones alike; an empty table stays empty.
    """
    kept = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, letters = features(batch.column(batch.schema.get_field_index(text)))
            lang, score = shared.value.predict(x)
            lang = [a if ok else UNKNOWN for a, ok in zip(lang, letters)]
            added = [pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
