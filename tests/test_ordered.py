import json

import pytest
from pyspark.sql import functions as F

from taxaflow.operators import ordered


class Draws:
    """The 48-bit generator, one step after the other."""

    def __init__(self, seed):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, n):
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> (48 - n)

    def double(self):
        return ((self.bits(26) << 27) + self.bits(27)) * (1.0 / (1 << 53))


def one_by_one(items, capacity, seed):
    draws, kept = Draws(seed), []
    for seen, item in enumerate(items, 1):
        if len(kept) < capacity:
            kept.append(item)
        else:
            j = int(draws.double() * seen)
            if j < capacity:
                kept[j] = item
    return kept


@pytest.mark.parametrize(("n", "capacity", "seed", "parts"), [(1000, 10, 42, 1), (1000, 10, 43, 7), (5000, 250, 1, 5), (30, 50, 2, 3), (500, 1, -5, 4), (0, 5, 1, 1)])
def test_reservoir(spark, n, capacity, seed, parts):
    rows = [(3 * i - 700, "same name", "x") for i in range(n)]
    df = spark.createDataFrame(rows, "line long, name string, start string").repartition(parts)
    got = {r.slot: r.line for r in ordered.reservoir(df, capacity, "line", seed, width=64).collect()}
    assert got == dict(enumerate(one_by_one([r[0] for r in rows], capacity, seed)))


def test_reservoir_of_nothing(spark):
    assert ordered.reservoir(spark.range(5), 0, "id").count() == 0


def test_review_sample(spark):
    df = spark.range(400).withColumn("odd", F.col("id") % 10 == 0)
    got = sorted(r.id for r in ordered.review_sample(df, F.col("odd"), 30, 20, "id", seed=9).collect())
    assert got == sorted(one_by_one(range(0, 400, 10), 10, 9) + one_by_one([i for i in range(400) if i % 10], 20, 10))


def test_places_with_gaps_nulls_and_ties(spark):
    keys = [None, -5, 0, 0, 63, 64, 10**12, 10**12 + 1]
    df = spark.createDataFrame([(k, t) for t, k in enumerate(keys)], "k long, t int").repartition(3)
    got = {r.t: r.place for r in ordered.with_place(df, "k", ["t"], width=64).collect()}
    assert got == {t: t for t in range(len(keys))}


def test_compare_by_place(spark):
    lists = [["Abies alba", "Poa annua", "Picea abies", "Larix"], ["Abies  alba", "Picea abies", "Larix", "Ulmus", "Acer"]]
    a, b = (spark.createDataFrame([(10 * i, x, None if i == 2 else "L.") for i, x in enumerate(names)], "line long, name string, author string") for names in lists)
    rows = lambda **kw: {r.place: (r.change, r.paths) for r in ordered.compare_places(a, b, "line", ["name", "author"], **kw).collect()}
    assert rows() == {0: ("fields", ["name"]), 1: ("fields", ["name"]), 2: ("fields", ["name"]), 3: ("fields", ["name"]), 4: ("right only", [])}
    assert rows(ignore_whitespace=True) == {k: v for k, v in rows().items() if k}
    shown, counts = ordered.compare_report(ordered.compare_places(b, a, "line", ["name", "author"]), max_diffs=2)
    assert [r.place for r in shown.collect()] == [0, 1]
    assert {r.what: r.n for r in counts.collect()} == {"fields": 4, "name": 4, "left only": 1}


def test_batches(spark):
    df = spark.range(60).withColumn("index_of", F.lit("x"))
    got = {r["id"]: (r["batch"], r["index"]) for r in ordered.judge_batches(df, spark.range(0, 60, 3), "id", "id", size=7, width=8).collect()}
    waiting = [i for i in range(60) if i % 3]
    assert got == {i: (k // 7, k % 7) for k, i in enumerate(waiting)}


def test_verdicts(spark):
    good = {"index": 1, "verdict": "ok", "confidence": "low", "note": 'a } "quoted\\" brace { ] \n é'}
    whole = json.dumps({"verdicts": [good, {"index": 2}, {"index": 3, "verdict": "wrong", "confidence": "high", "fields": [{"a": {"b": 1}}]}]}, ensure_ascii=False)
    replies = [
        (0, whole), (1, "<think>\n{[}</think>" + whole + " and more }]{"), (2, whole[:-40]), (3, '{"verdicts": []}'), (4, "no array"), (5, None), (6, ""), (7, '{"verdicts": [{"index": 1,, }, ' + json.dumps(good) + "]}"),
    ]
    got = sorted((r["k"], r["index"], r["verdict"], r["note"]) for r in ordered.read_verdicts(spark.createDataFrame(replies, "k int, reply string")).collect())
    note = good["note"]
    assert got == [(0, 1, "ok", note), (0, 3, "wrong", None), (1, 1, "ok", note), (1, 3, "wrong", None), (2, 1, "ok", note), (7, 1, "ok", note)]
