import hashlib
import time

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from taxaflow.llm import piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [
    None, "", " ", "   ", "a", " a  b\n\tc ", "Hello world", "<s> </s> <unk> <0x0A>", "▁▁ x▁y", "é😀‍👩 \x00 z", "日本語のテキスト", "  \xa0", "the the the", "aaaa" * 500, " " * 3000, "▁" * 77,
    "x" * 20_000, "whole texts " * 3000, "ab\r\n" * 2000,
]


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_like_the_library(k):
    text = TEXTS[k] or ""
    own = piece_bpe.pieces(PATH)
    ids = LIBRARY.encode(text)
    assert own.encode(text) == ids
    assert own.decode(ids) == LIBRARY.decode(ids)
    n, joined, back = own.parts(text)
    assert (n, joined.decode(), back.decode()) == (len(ids), ",".join(map(str, ids)), LIBRARY.decode(ids))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\tabcdeinrst'é<>0x"), st.characters(exclude_categories=["Cs"]))))
def test_any_text(text):
    assert piece_bpe.pieces(PATH).encode(text) == LIBRARY.encode(text)


@pytest.mark.parametrize("short", [0, 5, 10**9])
def test_both_forms_of_the_agenda(monkeypatch, short):
    monkeypatch.setattr(piece_bpe, "SHORT", short)
    own = piece_bpe.Pieces(PATH)
    for text in TEXTS:
        if short < 100 or len(text or "") < 5000:
            assert own.encode(text or "") == LIBRARY.encode(text or "")


def test_one_segment_gives_the_same():
    own = piece_bpe.Pieces(PATH)
    own.segments = __import__("re").compile("(?s).+").findall
    for text in TEXTS:
        assert own.encode(text or "") == LIBRARY.encode(text or "")


def test_long_segment_is_no_special_case():
    own, began = piece_bpe.pieces(PATH), time.time()
    assert len(own.encode("ab" * 200_000)) == len(LIBRARY.encode("ab" * 200_000))
    assert time.time() - began < 30


def test_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, "   ", "x"), (3, "   ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((repr(i), len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))) for i, t, _ in rows for ids in [LIBRARY.encode(t or "")])
    got = piece_bpe.round_trip(df, PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((repr(r[0]), *r[1:]) for r in got.collect()) == want
    assert piece_bpe.round_trip(df.limit(0), PATH).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = piece_bpe.decode(piece_bpe.encode(df, PATH), PATH)
    assert sorted((r.doc_id, r.ids, r.decoded) for r in got.collect()) == [(1, LIBRARY.encode("a b"), "a b"), (2, [], "")]
    with pytest.raises(ValueError, match="already"):
        piece_bpe.encode(df, PATH, ids="TEXT")


def test_wrong_model():
    with pytest.raises(Exception):  # noqa: B017
        piece_bpe.Pieces(public_tokenizers.path("byte_bpe_50k.json"))


def test_the_check_finds_differences():
    own = piece_bpe.Pieces(PATH)
    own.rank = {k: -r for k, r in own.rank.items()}
    own.parts("Hello world")
    with pytest.raises(ValueError, match="library"):
        own.check()
