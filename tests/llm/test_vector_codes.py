import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taxaflow.llm import vector_codes as V


def brute(rows, parts=8, entries=16, rounds=6):
    """The contract's rules in plain Python numbers."""
    kept = [(i, [math.floor(4096 * c) for c in x], label) for i, x, label in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    kept.sort(key=lambda r: r[0])
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = lambda x: [x[p * w : (p + 1) * w] for p in range(parts)]
    books = [[list(cut(x)[p]) for _, x, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda a, book: min((far(a, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        got = [[[] for _ in b] for b in books]
        for _, x, _ in kept:
            for p, a in enumerate(cut(x)):
                got[p][near(a, books[p])[1]].append(a)
        books = [[[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for e, g in zip(b, gs, strict=True)] for b, gs in zip(books, got, strict=True)]
    out = []
    for i, x, label in kept:
        found = [near(a, books[p]) for p, a in enumerate(cut(x))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    sums = {}
    for r in out:
        sums[r[3]] = sums.get(r[3], 0) + r[2]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, code, error, sums[label], sha) for i, code, error, label in out]


SCHEMA = "vec_id long, embedding array<float>, label int, v string, code string"


def rows_of(n, dims, seed, scale=1.0):
    draw = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    return [(draw.randrange(1000) * 1000 + i, [f32(draw.gauss(0, scale)) for _ in range(dims)], draw.choice([None, 1, 2])) for i in range(n)]


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = V.vector_codes(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_like_brute_force(spark):
    rows = rows_of(300, 16, 1)
    rows += [(5_000_000 + i, rows[0][1], 7) for i in range(100)] + [(6_000_000, None, 1), (6_000_001, [None] + rows[0][1][1:], 1), (6_000_002, [float("nan")] * 16, 1), (6_000_003, [float("inf")] + [0.0] * 15, None)]
    check(spark, rows)


def test_few_equal_and_great_vectors(spark):
    check(spark, rows_of(5, 8, 2))
    check(spark, [(i, [1.0] * 8, None) for i in range(30)])
    check(spark, rows_of(40, 16, 3, scale=1e5))


def test_beyond_a_long(spark):
    rows = [(i, [(-1.0) ** i * 3e38 if i < 4 else float(i)] * 8, 1) for i in range(20)]
    got = V.vector_codes(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    assert len(got) == 20 and all(0 <= r.error <= r.label_error <= V.LONGEST for r in got)


def test_empty_and_odd_dimensions(spark):
    assert V.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert V.vector_codes(spark.createDataFrame([(1, None, 1, "", "")], SCHEMA)).count() == 0
    assert [r.vec_id for r in V.vector_codes(spark.createDataFrame([(1, [0.5] * 8, 1, "", ""), (2, [0.5] * 16, 1, "", "")], SCHEMA)).collect()] == [1]
    assert [(r.code, r.error) for r in V.vector_codes(spark.createDataFrame([(1, [], 1, "", "")], SCHEMA)).collect()] == [("00" * 8, 0)]
    with pytest.raises(ValueError, match="divide"):
        V.vector_codes(spark.createDataFrame([(1, [0.5] * 9, 1, "", "")], SCHEMA))


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 12), st.integers(1, 9), st.integers(0, 10**6), st.sampled_from([3, 4000, 10**11]))
def test_nearest(entries, width, seed, most):
    draw = np.random.default_rng(seed)
    x, book = draw.integers(-most, most, (20, width)), draw.integers(-most, most, (entries, width))
    codes, far = V.nearest(x, book)
    for row, k, d in zip(x.tolist(), codes, far, strict=True):
        want = min((sum((a - b) ** 2 for a, b in zip(row, e, strict=True)), j) for j, e in enumerate(book.tolist()))
        assert (int(d), int(k)) == want
