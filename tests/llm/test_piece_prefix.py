import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import piece_prefix
from paperloom.llm.queries import QUERIES

from .conftest import documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER = piece_prefix.Encoder(piece_prefix.Pieces.load(PATH))
ODD = ["", " ", "a\0b", "▁x", "x▁ y", "▁ ▁", "<s>a</s>", "<0x41>", "\n\n", "\n x \n", "né漢字𝔘", "\r\n\t", "x" * 5000, "=-" * 40, "日本語🎉🎉", " a  b "]


def same(texts):
    ids, ends = ENCODER.encode(texts)
    for text, a, b, back in zip(texts, [0, *ends[:-1]], ends, ENCODER.decode(ids, ends), strict=True):
        want = LIBRARY.encode(text)
        assert ids[a:b].tolist() == want, text
        assert back == LIBRARY.decode(want), text


def test_odd_texts_as_the_library():
    same(ODD)


def test_runs_of_spaces():
    """Pieces of spaces share one score, so only their places decide; one length is missing."""
    same([" " * n + end for n in range(70) for end in ("", "a", "字", " b  c")])


def test_random_pieces_as_the_library():
    rng = random.Random(3)
    pieces = [t.replace("▁", " ") for t in ENCODER.merges.id]
    short = [t for t in pieces if len(t) <= 3]
    same(["".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) for _ in range(4000)])
    same(["".join(rng.choice(short) for _ in range(rng.randint(1, 20))) for _ in range(4000)])


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5))
def test_any_text_as_the_library(texts):
    same(texts)


def test_pair_test_is_merging():
    """The pair test against merging the characters of both tokens."""
    rng, m = random.Random(5), ENCODER.merges
    ids = [i for i, t in m.text.items() if len(t) <= 5]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(20_000)] + [(a, b) for a in m.tied for b in m.tied]
    assert all(m.allowed(a, b) == (m.merge(m.text[a] + m.text[b]) == [a, b]) for a, b in pairs)


def test_one_token_ends_each_prefix():
    """The table against the library on every prefix of a chunk."""
    chunk = "▁heretofore"
    last = ENCODER.last_tokens(chunk)
    for n in range(1, len(chunk) + 1):
        assert last[n] == LIBRARY.encode(chunk[1:n])[-1] if n > 1 else True


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(piece_prefix, "MEMORY", 3)
    e = piece_prefix.Encoder(ENCODER.pieces)
    for text in ODD * 2:
        ids, _ = e.encode([text])
        assert ids.tolist() == LIBRARY.encode(text)


def test_refuses_other_models(tmp_path):
    raw = open(PATH, "rb").read()
    at = raw.rindex(b"identity") - 2
    size = raw[at - 1]  # of the normalizer's settings
    path = tmp_path / "other.model"
    path.write_bytes(raw[: at - 1] + bytes([size + 3]) + raw[at : at + size] + b"\x12\x01x" + raw[at + size :])
    with pytest.raises(ValueError, match="changes its texts"):
        piece_prefix.Pieces.load(str(path))


def test_table(spark, odd, none):
    for df in (documents(spark), odd):
        got = piece_prefix.encode_and_decode(df.repartition(3), PATH).collect()
        assert len(got) == df.count()
        for r in got:
            ids = LIBRARY.encode(r["text"] or "", add_eos=True)
            assert r["ids"] == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded"] == LIBRARY.decode(ids) and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert piece_prefix.encode_and_decode(none, PATH).count() == 0


def test_query(spark):
    got = QUERIES["op12_piece_prefix"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    text = {r["doc_id"]: r["text"] or "" for r in documents(spark).collect()}
    for r in got.collect():
        ids = LIBRARY.encode(text[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
