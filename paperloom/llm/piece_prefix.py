"""SentencePiece of the merge type by a table of last tokens.

The merges of a prefix of a text end with exactly one token.  Of all pieces that end
at a place (an automaton finds them in one pass over the text) it is the one that the
last token of the prefix before it allows: the merges of the two tokens' characters
give just these two tokens again.  So the table needs one entry a character, and the
ids are read from it backwards.  Merging itself is never run over a text.

No piece holds a space behind another character, nor a character that is no piece of
its own, so a text falls into chunks there, and equal chunks have equal ids.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import gather, text_parts

#: Fixed: the character that stands for a space inside pieces.
SPACE = "▁"
#: Fixed: kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Fixed: what an unknown piece decodes to.
UNKNOWN_TEXT = " ⁇ "
#: Chunks and token pairs remembered by a task; beyond it the memory starts anew (results stay the same).
MEMORY = 1_000_000
START, NONE = -1, -2


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at : at + size]
        at += size


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: text, score and kind of every id."""

    texts: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str) -> Pieces:
        """From a model file of the sentencepiece library; refuses what would need another method."""
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        texts, scores, kinds = [], [], []
        for number, raw in model:
            if number == 1:
                piece = dict(fields(raw))
                texts.append(piece[1].decode("utf-8"))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
        trainer = dict(fields(dict(model)[2]))
        normal = dict(fields(dict(model)[3]))
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24):
            raise ValueError("not a merge-type model with byte fallback")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("the model changes its texts")
        if {USER, UNUSED} & set(kinds):
            raise ValueError("user-defined or unused pieces")
        return cls(texts, scores, kinds, bool(normal.get(3, 1)))

    @property
    def end_id(self) -> int:
        return self.texts.index("</s>")


class Merges:
    """What merging does to few characters: the pair test."""

    def __init__(self, pieces: Pieces):
        self.text = {i: t for i, (t, k) in enumerate(zip(pieces.texts, pieces.kinds)) if k == NORMAL}
        self.id = {t: i for i, t in self.text.items()}
        order = sorted({pieces.scores[i] for i in self.text}, reverse=True)
        place = {s: r for r, s in enumerate(order)}
        self.rank = {i: place[pieces.scores[i]] for i in self.text}
        self.alphabet = {t for t in self.id if len(t) == 1}
        if not {c for t in self.id for c in t} <= self.alphabet:
            raise ValueError("a piece holds a character that is no piece")
        shared = {r for r, n in Counter(self.rank.values()).items() if n > 1}
        self.tied = {i for i, r in self.rank.items() if r in shared and len(self.text[i]) > 1}
        self.halves: dict[int, tuple[int, int]] = {}
        for i, t in self.text.items():
            if len(t) > 1:
                made = self.merge(t, self.halves, i)
                if made != [i]:
                    raise ValueError(f"piece {i} can't be merged")

    def merge(self, chars: str, halves: dict | None = None, whole: int | None = None) -> list[int]:
        """Ids of a few characters: the pair of the least rank first, of equal ones the leftmost."""
        ids = [self.id[c] for c in chars]
        texts = list(chars)
        while True:
            best = None
            for at in range(len(ids) - 1):
                made = self.id.get(texts[at] + texts[at + 1])
                if made is not None and (best is None or self.rank[made] < best[0]):
                    best = self.rank[made], at, made
            if best is None:
                return ids
            _, at, made = best
            if halves is not None and made == whole:
                halves[made] = ids[at], ids[at + 1]
            texts[at : at + 2] = [texts[at] + texts[at + 1]]
            ids[at : at + 2] = [made]

    def allowed(self, left: int, right: int) -> bool:
        """Whether the characters of two tokens merge to these two tokens.

        The merges that made them are undone from the last to the first; as long as
        nothing else happens, the two symbols at the border would have to merge
        before the merge that was undone.  Of equal ranks the leftmost merge comes
        first.  Pieces that share their rank with others are merged outright.
        """
        if left in self.tied or right in self.tied:
            return self.merge(self.text[left] + self.text[right]) == [left, right]
        text, rank, halves, ids = self.text, self.rank, self.halves, self.id
        a, b, next_rank, next_left = left, right, len(rank), False
        while True:
            made = ids.get(text[a] + text[b])
            # a merge that uses the left symbol's own left neighbour goes first at equal rank
            if made is not None and (rank[made] < next_rank or (rank[made] == next_rank and not next_left)):
                return False
            made_a, made_b = rank[a] if a in halves else -1, rank[b] if b in halves else -1
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                a, next_rank, next_left = halves[a][1], made_a, True
            else:
                b, next_rank, next_left = halves[b][0], made_b, False


class _Index(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Encodes texts with a memory of the chunks met so far."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.merges = pieces, Merges(pieces)
        automaton = ahocorasick.Automaton()
        for i, t in self.merges.text.items():
            automaton.add_word(t, (i, len(t)))
        automaton.make_automaton()
        self.matches = automaton.iter
        self.size = {i: len(t) for i, t in self.merges.text.items()}
        known = "".join(map(re.escape, sorted(self.merges.alphabet - {SPACE})))
        self.whole = any(SPACE in t.lstrip(SPACE) for t in self.merges.id)
        self.plain = "\n" not in self.merges.alphabet and " " not in self.merges.alphabet
        self.find = re.compile(f"[{known}{SPACE}]+|[^{known}{SPACE}]" if self.whole else f"{SPACE}*[{known}]+|{SPACE}+|[^{known}{SPACE}]").findall
        self.of_byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(pieces.texts, pieces.kinds)) if k == BYTE}
        raw = []
        for t, k in zip(pieces.texts, pieces.kinds):
            shown = {CONTROL: b"", UNKNOWN: UNKNOWN_TEXT.encode()}.get(k, t.replace(SPACE, " ").encode())
            raw.append(bytes([int(t[3:5], 16)]) if k == BYTE else shown)
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.token_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.leading = {i for i, t in self.merges.text.items() if t.startswith(SPACE)}
        self.silent = np.array([k == CONTROL for k in pieces.kinds])
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        """Pieces of a text that don't depend on each other; some may be empty."""
        first = SPACE if self.pieces.dummy_prefix else ""
        if self.whole or not self.plain or "  " in text or SPACE in text or text[:1] in ("", " "):
            return self.find(first + text.replace(" ", SPACE)) if text else []
        # each space begins a chunk and each line end is one: the usual text needs no pattern
        return (first + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")

    def last_tokens(self, chunk: str) -> list[int]:
        """The last token of every prefix, the empty one first; NONE behind a character that is no piece."""
        last = [START] + [NONE] * len(chunk)
        pairs, allowed = self.pairs, self.merges.allowed
        for end, (token, size) in self.matches(chunk):
            end += 1
            if last[end] != NONE:
                continue
            before = last[end - size]
            if before >= 0:
                fits = pairs.get((before, token))
                if fits is None:
                    if len(pairs) > MEMORY:
                        pairs.clear()
                    pairs[before, token] = fits = allowed(before, token)
                if not fits:
                    continue
            last[end] = token
        return last

    def ids_of(self, chunk: str) -> list[int]:
        """Ids of a chunk, recovered from the last to the first."""
        last, at, out = self.last_tokens(chunk), len(chunk), []
        while at:
            token = last[at]
            if token == NONE:
                out += [self.of_byte[b] for b in reversed(chunk[at - 1].encode("utf-8"))]
                at -= 1
            else:
                out.append(token)
                at -= self.size[token]
        out.reverse()
        return out

    def learn(self) -> None:
        known = len(self.count)
        if len(self.index) == known:
            return
        new = [self.ids_of(chunk) for chunk in islice(self.index, known, None)]
        count = np.fromiter(map(len, new), np.int64, len(new))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in new for i in x), np.int32, int(count.sum()))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another and without an end id, and the end of each text's ids."""
        if len(self.index) > MEMORY:
            self.clear()
        number = self.index.__getitem__  # a new chunk gets the next number
        parts, sizes = [], []
        for text in texts:
            found = self.chunks(text)
            parts.append(np.fromiter(map(number, found), np.int64, len(found)))
            sizes.append(len(found))
        self.learn()
        at = np.concatenate([np.zeros(0, np.int64), *parts])
        each = self.count[at]
        ends = np.concatenate([[0], np.cumsum(each)])[np.cumsum(sizes, dtype=np.int64)]
        return gather(self.flat, self.start[at], each), ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Text of each run of ids: the dummy prefix is taken off, bytes that are no UTF-8 are replaced."""
        at = self.token_at
        count = at[ids + 1] - at[ids]
        raw = gather(self.token_bytes, at[ids], count).tobytes()
        stops = np.concatenate([[0], np.cumsum(count)])[ends].tolist()
        out = []
        for lo, hi, a, b in zip([0, *ends.tolist()], ends.tolist(), [0, *stops], stops):
            while lo < hi and self.silent[ids[lo]]:
                lo += 1
            prefix = self.pieces.dummy_prefix and lo < hi and int(ids[lo]) in self.leading
            out.append(raw[a + prefix : b].decode("utf-8", "replace"))
        return out


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(number: int, pieces: Pieces) -> Encoder:
    """This worker's encoder of a broadcast vocabulary; its memory serves later tasks too."""
    if number not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[number] = Encoder(pieces)
    return _ENCODERS[number]


OUTPUT = {
    "n_tokens": (T.LongType(), pa.int64()),
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "decoded": (T.StringType(), pa.string()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def encode_and_decode(df: DataFrame, path: str, want: tuple[str, ...] = tuple(OUTPUT), text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds the columns ``want`` of every row's whole text, as the sentencepiece library does.

    ``ids`` end with the end id and have no begin id; ``decoded`` is the text made
    from them; ``ids_sha256`` is that of the decimal ids with single spaces between.
    A null text counts as empty: the end id alone, and an empty text.  Repeated rows
    each get their result, an empty table stays empty, other columns of ``df`` (all,
    or those named in ``keep``) pass through; one that bears the name of an added
    column is replaced.  A text is held in memory with one number a character of
    its longest chunk; nothing else grows with its length.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in want]
    slim = df.select(*kept, *([] if text in kept else [text]))
    schema = T.StructType([*(slim.schema[c] for c in kept), *(T.StructField(c, OUTPUT[c][0]) for c in want)])
    pieces = Pieces.load(path)
    end_id = pieces.end_id
    shared = df.sparkSession.sparkContext.broadcast(pieces)
    number = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(number, shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            done = 0
            for texts in text_parts([t or "" for t in column.to_pylist()]):
                ids, ends = encoder.encode(texts)
                ids = np.insert(ids, ends, end_id)
                ends = ends + 1 + np.arange(len(ends))
                out: dict[str, list | pa.Array] = {"n_tokens": np.diff(np.r_[0, ends]).tolist()}
                if "ids" in want:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int32)))
                if "ids_sha256" in want:
                    names, stops = list(map(str, ids.tolist())), ends.tolist()
                    out["ids_sha256"] = [hashlib.sha256(" ".join(names[a:b]).encode()).hexdigest() for a, b in zip([0, *stops], stops)]
                if "decoded" in want or "decoded_sha256" in want:
                    out["decoded"] = encoder.decode(ids, ends)
                    out["decoded_sha256"] = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in out["decoded"]]
                part = batch.slice(done, len(texts))
                done += len(texts)
                arrays = [part.column(part.schema.get_field_index(c)) for c in kept]
                made = [x if isinstance(x, pa.Array) else pa.array(x, OUTPUT[c][1]) for c, x in ((c, out[c]) for c in want)]
                yield pa.RecordBatch.from_arrays([*arrays, *made], names=[*kept, *want])

    return slim.mapInArrow(run, schema)
