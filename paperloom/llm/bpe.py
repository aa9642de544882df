"""Byte-level BPE: batched numpy merge rounds over the symbols of many words.

Symbols of all words that a batch adds lie in one flat array.  A round looks up
every changed pair by binary search among the sorted pair keys, takes the lowest
rank of each word, merges all its places at once and drops finished words.  The
result is the same as merging one pair at a time: where a merge could open a pair
of lower rank, only its leftmost place is merged in a round.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed: the words of byte-level BPE, as the vocabulary's pre-tokenizer defines them.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks remembered by a task; beyond it the memory starts anew (results stay the same).
MEMORY = 300_000
#: Characters encoded at once.
PIECE_CHARS = 1_000_000
NEVER = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@dataclass
class Merges:
    """A vocabulary as arrays; small enough (about a hundred bytes a merge) to go with every task."""

    keys: np.ndarray  # sorted: left << 32 | right
    ranks: np.ndarray
    made: np.ndarray  # the symbol that a key's merge makes
    single: np.ndarray  # by rank: merge one place at a time
    of_byte: np.ndarray
    token_bytes: np.ndarray  # bytes of all ids, one after another
    token_at: np.ndarray
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Merges:
        """From a byte-level BPE file of the tokenizers library."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ids = dict(model["vocab"]) | special
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left, right, made = (np.array([ids[x] for x in col], np.int64) for col in zip(*((a, b, a + b) for a, b in pairs), strict=True))
        keys, rank = left << 32 | right, np.arange(len(pairs), dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        order = order[np.r_[True, np.diff(keys[order]) != 0]]
        lowest = np.full(max(ids.values()) + 1, NEVER, np.int64)  # of the pairs that hold a symbol
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        to_byte = {c: b for b, c in enumerate(letters)}
        raw = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            raw[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        return cls(
            keys[order],
            rank[order],
            made[order].astype(np.int32),
            lowest[made] < rank,
            np.array([ids[c] for c in letters], np.int32),
            np.frombuffer(b"".join(raw), np.uint8),
            np.concatenate([[0], np.cumsum([len(x) for x in raw])]),
            special,
        )

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and resulting symbol of pairs; rank ``NEVER`` where they don't merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NEVER), self.made[at]


def merge_words(m: Merges, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words given as bytes, one after another, and the number of ids of each."""
    size = np.array([len(x) for x in raw], np.int64)
    sym = m.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
    word = np.repeat(np.arange(len(raw)), size)
    rank = np.full(len(sym), NEVER, np.int32)
    made = np.zeros(len(sym), np.int32)

    def refresh(at: np.ndarray) -> None:
        at = at[(at >= 0) & (at < len(sym) - 1)]
        rank[at], made[at] = m.look_up(sym[at], sym[at + 1])
        rank[at[word[at] != word[at + 1]]] = NEVER

    refresh(np.arange(len(sym)))
    done_word, done_sym = [], []
    while len(sym):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        count = np.diff(np.r_[first, len(sym)])
        best = np.minimum.reduceat(rank, first)
        if (over := best == NEVER).any():
            gone = np.repeat(over, count)
            done_word.append(word[gone])
            done_sym.append(sym[gone])
            keep = ~gone
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            best, count = best[~over], count[~over]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(best, count))
        new_run = np.r_[True, np.diff(at) != 1]
        begin = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begin) % 2 == 0]  # of overlapping places every other one
        if (one := m.single[rank[at]]).any():
            again = np.r_[False, word[at[1:]] == word[at[:-1]]]
            at = at[~(one & again)]
        sym[at] = made[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
        at = place[at]
        rank[at] = NEVER
        refresh(np.concatenate([at - 1, at]))
    order_word = np.concatenate([np.zeros(0, np.int64), *done_word])
    flat = np.concatenate([np.zeros(0, np.int32), *done_sym])[np.argsort(order_word, kind="stable")]
    return flat, np.bincount(order_word, minlength=len(raw))


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The slices ``flat[start:start+count]``, one after another."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - count), count) + np.arange(total)]


class _Index(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Encodes texts with a memory of the chunks met so far.

    A space before a visible character always begins a word of the pattern, so a
    text may be cut there, and equal chunks have equal ids wherever they stand.
    Keys of the memory: a chunk that follows a space as a string, one at the start
    of a text or after a special token as a tuple, a special token as its id.
    """

    def __init__(self, merges: Merges):
        self.m = merges
        self.find = regex.compile(WORD).findall
        names = sorted(merges.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.wide = re.compile(r" (?:\s|$)").search
        self.chunks = re.compile(r" (?=\S)").split
        self.clear()

    def clear(self) -> None:
        self.index, self.flat = _Index(), np.zeros(0, np.int32)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(self, text: str) -> list:
        """Keys of the chunks of a text."""
        if self.cut is not None and any(name in text for name in self.m.special):
            out: list = []
            for i, part in enumerate(self.cut.split(text)):
                out += [self.m.special[part]] if i % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list:
        out = self.chunks(text) if self.wide(text) else text.split(" ")
        out[0] = (out[0],)
        return out

    def words(self, key: str | tuple | int) -> list:
        if isinstance(key, str):
            return self.find(" " + key)
        return self.find(key[0]) if isinstance(key, tuple) else [key]

    def learn(self) -> None:
        known = len(self.count)
        if len(self.index) == known:
            return
        found = [self.words(key) for key in islice(self.index, known, None)]
        unique = _Index()
        at = np.fromiter(map(unique.__getitem__, chain.from_iterable(found)), np.int64)
        special = [i for i, w in enumerate(unique) if isinstance(w, int)]
        ids, count = merge_words(self.m, [b"" if isinstance(w, int) else w.encode("utf-8") for w in unique])
        if special:
            ids = np.insert(ids, np.cumsum(count)[special], [w for w in unique if isinstance(w, int)])
            count[special] = 1
        flat = gather(ids, (np.cumsum(count) - count)[at], count[at])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.concatenate([[0], np.cumsum(count[at])])[np.cumsum(sizes)]
        per_chunk = np.diff(ends, prepend=0)
        self.start = np.concatenate([self.start, len(self.flat) + ends - per_chunk])
        self.count = np.concatenate([self.count, per_chunk])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the end of each text's ids."""
        if len(self.index) > MEMORY:
            self.clear()
        number = self.index.__getitem__  # a new chunk gets the next number
        parts, sizes = [], []
        for text in texts:
            found = self.split(text)
            sizes.append(len(found))
            parts.append(np.fromiter(map(number, found), np.int64, len(found)))
        self.learn()
        at = np.concatenate([np.zeros(0, np.int64), *parts])
        per_chunk = self.count[at]
        ids = gather(self.flat, self.start[at], per_chunk)
        ends = np.concatenate([[0], np.cumsum(per_chunk)])[np.cumsum(sizes, dtype=np.int64)]
        return ids, ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of each text."""
        at = self.m.token_at
        count = at[ids + 1] - at[ids]
        raw = gather(self.m.token_bytes, at[ids], count).tobytes()
        stops = np.concatenate([[0], np.cumsum(count)])[ends].tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(number: int, merges: Merges) -> Encoder:
    """This worker's encoder of a broadcast vocabulary; its memory serves later tasks too."""
    if number not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[number] = Encoder(merges)
    return _ENCODERS[number]


def text_parts(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= PIECE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


OUTPUT = {
    "n_tokens": (T.LongType(), pa.int64()),
    "ids": (T.BinaryType(), pa.binary()),
    "decoded": (T.StringType(), pa.string()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def encode_and_decode(df: DataFrame, path: str, want: tuple[str, ...] = tuple(OUTPUT), text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds the columns ``want`` of every row's whole text.

    ``ids`` are little-endian unsigned 32-bit integers; ``decoded`` is the text
    made from them, invalid bytes replaced.  A null text counts as empty (no ids,
    empty text).  Repeated rows each get their result, an empty table stays
    empty, other columns of ``df`` (all, or those named in ``keep``) pass through;
    one that bears the name of an added column is replaced.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in want]
    slim = df.select(*kept, *([] if text in kept else [text]))
    schema = T.StructType([*(slim.schema[c] for c in kept), *(T.StructField(c, OUTPUT[c][0]) for c in want)])
    shared = df.sparkSession.sparkContext.broadcast(Merges.load(path))
    number = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(number, shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            done = 0
            for texts in text_parts([t or "" for t in column.to_pylist()]):
                ids, ends = encoder.encode(texts)
                flat = ids.astype("<u4").tobytes()
                stops = ends.tolist()
                each = [flat[4 * a : 4 * b] for a, b in zip([0, *stops], stops)]
                out: dict[str, list] = {"n_tokens": np.diff(np.r_[0, ends]).tolist(), "ids": each}
                if "ids_sha256" in want:
                    out["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in each]
                if "decoded" in want or "decoded_sha256" in want:
                    back = encoder.decode(ids, ends)
                    out["decoded"] = [x.decode("utf-8", "replace") for x in back]
                    out["decoded_sha256"] = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in out["decoded"]]
                part = batch.slice(done, len(texts))
                done += len(texts)
                arrays = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(out[c], OUTPUT[c][1]) for c in want)], names=[*kept, *want])

    return slim.mapInArrow(run, schema)
