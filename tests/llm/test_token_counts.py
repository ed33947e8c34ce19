import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from taxaflow.llm import token_counts as tc

from .test_tokens import TEXTS

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MORE = ["don't'sx 'r 'rx 'l' '' 's\n's \n 's", "   a", "a   ", "\n\n a", "a \n b", "'", "''", "'l", "x'v", "'́s", " 'll", "1'2's", "=" * 3000, " \n" * 2000 + "x", "a<|endoftext|>", "<|endoftext|>", "<|endoftext|><|endoftext|> "]


def test_counts_equal_the_library():
    texts = [t or "" for t in TEXTS] + MORE
    own = tc.transducer(PATH)
    want = [len(LIBRARY.encode(t).ids) for t in texts]
    assert own.counts(texts) == want
    assert [own.counts([t])[0] for t in texts] == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aethrs  '\n\tlvd1é日.-!\xa0")), max_size=1500), max_size=4))
def test_any_text(texts):
    assert tc.transducer(PATH).counts(texts) == [len(LIBRARY.encode(t).ids) for t in texts]


def test_small_tables_give_the_same(monkeypatch):
    monkeypatch.setattr(tc, "STATES", 60)
    monkeypatch.setattr(tc, "SYMBOLS", 8)
    monkeypatch.setattr(tc, "PAIRS", 50)
    texts = [t or "" for t in TEXTS] + MORE
    own = tc.Transducer(PATH)
    for _ in range(2):
        assert own.counts(texts) == [len(LIBRARY.encode(t).ids) for t in texts]


def test_rows(spark):
    rows = [(i, t, True) for i, t in enumerate([*TEXTS, "word " * 1100])] + [(None, "a", False), (3, "a", False), (3, "a", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, over_limit boolean")
    got = tc.token_counts(df, PATH, 1024).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1], r[2])
    want = [(i, len((t or "").encode()), len(LIBRARY.encode(t or "").ids)) for i, t, _ in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got) and any(r.over_limit for r in got)
    assert tc.token_counts(df.limit(0), PATH, 1024).count() == 0


def test_long_runs_take_few_rounds():
    import random
    import time

    draw = random.Random(1)
    own = tc.transducer(PATH)
    texts = ["".join(draw.choices("etaoinshrdlu", k=200_000)), "a" * 100_000, "ab" * 50_000, "é日" * 20_000, "1" * 30_000, "=-" * 30_000, "x" * 511 + "'s" * 400, "\n" * 5000, "word " * 5000 + "z" * 4000]
    began = time.time()
    found = own.counts(texts)
    assert found == [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    print(own.rounds, time.time() - began)
    assert own.rounds < 60 and time.time() - began < 60
