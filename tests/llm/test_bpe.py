import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from paperloom.llm import bpe

from .conftest import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a" * 3000, "<|endoftext|>x <|endoftext|>", "  \n\n x\t\t y  ", "'s 'S don't  I'll", "日本語🎉🎉", "x\0<|endoftext|>\0y", " a  b ", "x\n \ny", "a   b", "1234567 ²³ ½", "a \x1cb"]


def test_merges_may_run_in_batches():
    m = bpe.Merges.load(PATH)
    assert not m.single.any() and (np.diff(m.keys) > 0).all()


def test_odd_texts_as_the_library():
    e, t = bpe.Encoder(bpe.Merges.load(PATH)), Tokenizer.from_file(PATH)
    ids, ends = e.encode(ODD)
    back = e.decode(ids, ends)
    for text, a, b, raw in zip(ODD, [0, *ends[:-1]], ends, back):
        assert ids[a:b].tolist() == t.encode(text, add_special_tokens=False).ids
        assert raw.decode() == text


def test_one_place_at_a_time():
    """A vocabulary in which merging all places at once would differ from one at a time."""
    keys = {(0, 1): (1, 3), (3, 2): (0, 4)}  # (left, right): (rank, made); the second merge ranks before the first
    order = sorted(keys)
    m = bpe.Merges(np.array([a << 32 | b for a, b in order]), np.array([keys[k][0] for k in order], np.int32), np.array([keys[k][1] for k in order], np.int32), np.array([False, True]), np.zeros(256, np.int32), np.zeros(0, np.uint8), np.zeros(6, np.int64))
    m.of_byte[[97, 98, 99]] = [0, 1, 2]
    ids, count = bpe.merge_words(m, [b"abcab", b"", b"c"])
    assert ids.tolist() == [4, 3, 2] and count.tolist() == [2, 0, 1]


def test_table(spark, odd, none):
    t = Tokenizer.from_file(PATH)
    for df in (documents(spark), odd):
        got = bpe.encode_and_decode(df, PATH).collect()
        assert len(got) == df.count()
        for r in got:
            ids = t.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids) and np.frombuffer(r["ids"], "<u4").tolist() == ids
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded"] == (r["text"] or "") and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.encode_and_decode(none, PATH).count() == 0
