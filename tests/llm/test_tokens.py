import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from taxaflow.llm import bpe, packing, simhash

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "a", "The  cat's  hat\n\n\nisn't 'Red'. ", "x" * 5000, "ab" * 3000 + " ", "<|endoftext|> yes <|endoftext|>", "\x1c\x1d a\x85b\xa0c  d",
    "naïve Ünïcode façade ſ ß İ Σας ΣΑΣ", "日本語テキスト 123 ٣٤٥ Ⅷ", "é ö Å", "\t\t\n x\r\n y\x0bz\x0c", "'ll're've 'd'D ''''s", "🙂🙂 👩‍👩‍👧 ‍", "1234567890 12.5% $$$ ###", "<|startoftext|>a",
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(reference):
    own = bpe.codec(RANKS, P.PATTERN)
    for text in TEXTS:
        ids = own.encode(text or "")
        assert ids == reference.encode_ordinary(text or ""), text
        assert own.decode(ids) == (text or "").encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(text):
    own = bpe.codec(RANKS, P.PATTERN)
    assert own.decode(own.encode(text)) == text.encode("utf-8", "surrogatepass")


def test_bpe_round_trip_rows(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", "y"), (1, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    got = bpe.round_trip(df, RANKS, P.PATTERN).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t, _ in rows}
    for r in got:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).where("doc_id = 4").first()
    assert bytes(back.decoded).decode() == TEXTS[4]


def test_words_equal_the_tokenizer():
    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [t or "" for t in TEXTS]
    for text, ids in zip(texts, packing.words(path).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing_is_gapless(spark):
    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = TEXTS + ["word and more " * k for k in range(1, 900, 7)]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, None, 1), (0, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack_documents(df, path, group_pieces=40).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts[1:], 1):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 2048))
        assert all(r.length == min(2048, len(ids) - r.start) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + 2048].tobytes()) for r in own)
    assert len(by_doc[0]) == 2 and len(by_doc[None]) == 1
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert sum(r.length for r in own) <= 2048
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_sum_of_squares_brute_force():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 21, 200)
    bins, offsets = packing.sum_of_squares(lengths, 20)
    gaps, at = [], {}
    for s, b, o in zip(lengths, bins, offsets, strict=True):
        def cost(g):
            return sum(sum(1 for x in g if x == k) ** 2 for k in range(1, 20))
        choices = [cost(gaps[:k] + [g - s] + gaps[k + 1 :]) for k, g in enumerate(gaps) if g >= s] + [cost([*gaps, 20 - s])]
        if b == len(gaps):
            gaps.append(20 - s)
        else:
            assert gaps[b] == 20 - o and gaps[b] >= s
            gaps[b] -= s
        assert cost(gaps) == min(choices)
    assert len(at) == 0


def brute_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_and_components(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "One", "one", "one two", "A b c d e f g", "a B C d e f\tg", "ÀB c d"]
    texts += [" ".join(base), " ".join([*base[:150], "new", *base[151:]]), " ".join([*base[:149], "old", *base[151:]])] * 2 + [" ".join(base[k:]) for k in range(1, 30)]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, "lonely words here"), (None, None), (7, "x y z q"), (7, "x y z q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", simhash.F.lit(1))
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_components(df).collect()]
    want = [(d, brute_simhash(t or "")) for d, t in rows]
    group = list(range(len(want)))
    for i in range(len(want)):
        for j in range(i):
            if bin(want[i][1] ^ want[j][1]).count("1") <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    ids = [min((want[j][0] for j in range(len(want)) if group[j] == group[i] and want[j][0] is not None), default=None) for i in range(len(want))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted([(*w, c) for w, c in zip(want, ids, strict=True)], key=key)
    assert len({g for g in group}) < len(want)
    kept = simhash.near_dedup(df, 2).collect()
    assert sorted((r.doc_id for r in kept), key=lambda x: -1 if x is None else x) == sorted(set(ids), key=lambda x: -1 if x is None else x)
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_near_dedup_keeps_a_text_whose_doc_id_repeats(spark):
    one, two = "the quick brown fox jumps over the lazy dog at dawn", "completely different words stand in this other little text here"
    df = spark.createDataFrame([(1, one, 5), (1, two, 6), (2, one, 7), (1, one, 5), (None, two + " now and then", 8), (None, None, 9)], "doc_id long, text string, __key int")
    kept = simhash.near_dedup(df).collect()
    assert df.columns == list(kept[0].asDict())
    assert {(r.doc_id, r.text) for r in kept} >= {(1, one), (1, two)} and sum(r.text == one for r in kept) == 1
