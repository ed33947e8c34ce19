import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from taxaflow.llm import lexical

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(i, Counter(terms(t))) for i, t, *_ in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text, *_ in items:
        scores = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:10])]
    return out


def make(n, seed, words=60):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["É", "日本", "İx", "Word"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(draw.randrange(10**6), " ".join(draw.choices(vocabulary, weights, k=draw.choice([1, 3, 20, 60]))) + draw.choice([".", "", "\n-"]), "x") for _ in range(n)]
    docs += [(None, "w1 w2 w3", "x"), (None, "w1 w2 w3", "x"), (7, None, "x"), (8, "", "x"), (9, "-- !", "x"), (10, "w0 " * 5000, "x")] + [(5000 + k, "w5 w6 copy", "x") for k in range(n // 3)] + [(11, "w7 same row", "x")] * 15
    items = [(k, " ".join(draw.choices(vocabulary, weights, k=draw.choice([1, 2, 8, 30]))), "x") for k in range(25)]
    return docs, items + [(100, None, "x"), (101, "nothing-known", "x"), (102, "copy", "x"), (3, "w3 W3 word", "x"), (103, "same", "x"), (None, "w2", "x")]


SCHEMA = "{} long, text string, rank string"


@pytest.mark.parametrize(("parts", "sets"), [(2, 1000), (12, 10)])
def test_like_brute_force(spark, monkeypatch, parts, sets):
    monkeypatch.setattr(lexical, "ITEMS", sets)
    docs, items = make(300, 1)
    df = spark.createDataFrame(docs, SCHEMA.format("doc_id")).repartition(parts)  # a block a part, so searches with and without seeds
    got = lexical.ranked_search(df, spark.createDataFrame(items, SCHEMA.format("item_id")))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items), key=key)


def test_empty(spark):
    docs, items = spark.createDataFrame([], SCHEMA.format("doc_id")), spark.createDataFrame([(1, "a", "x")], SCHEMA.format("item_id"))
    assert lexical.ranked_search(docs, items).count() == 0
    assert lexical.ranked_search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def test_small_clusters_stop_exactly():
    """Blocks in plain Python: many clusters, so that most searches end early."""
    docs, items = make(600, 5, words=400)
    held = [(i, Counter(lexical.terms_of(t or ""))) for i, t, _ in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    queries = [(k, {t.decode(): math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(lexical.terms_of(text or "")) if t in df}) for k, (_, text, _) in enumerate(items)]
    import pyarrow as pa

    before = lexical.bisect.__defaults__
    lexical.bisect.__defaults__ = (4, 5)
    try:
        rows = pa.Table.from_batches(list(lexical._block(0, [i for i, _ in held], [c for _, c in held], n, total)))
    finally:
        lexical.bisect.__defaults__ = before
    want = brute(docs, [(k, text) for k, (_, text, _) in enumerate(items)])
    found = lexical._search_block(rows, queries, {})
    assert [(k, i, s) for k, _, i, s in found] == [(k, i, s) for k, _, i, s in want]
    tenth = {k: s for k, rank, _, s in want if rank == 10}
    again = lexical._search_block(rows, queries, tenth)
    assert [(k, i, s) for k, _, i, s in again] == [(k, i, s) for k, _, i, s in want]


def test_bisection_brings_like_documents_together():
    draw = random.Random(3)
    topics = [[f"t{k}_{j}" for j in range(30)] for k in range(8)]
    kind = [draw.randrange(8) for _ in range(512)]
    counts = [Counter(draw.sample(topics[k], 12) + ["all"]) for k in kind]
    names = {t: k for k, t in enumerate(sorted({t for c in counts for t in c}))}
    doc = np.repeat(np.arange(512), [len(c) for c in counts])
    term = np.array([names[t] for c in counts for t in c])
    cluster = lexical.bisect(doc, term, 512)
    sizes = np.bincount(cluster)
    assert sizes.max() <= 64 and len(sizes) == 8
    pure = sum(Counter(k for k, c in zip(kind, cluster, strict=True) if c == x).most_common(1)[0][1] for x in range(8))
    assert pure > 0.6 * 512
    assert (lexical.bisect(np.zeros(0, int), np.zeros(0, int), 3) == 0).all()
