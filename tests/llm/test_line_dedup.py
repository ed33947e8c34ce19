import random
import re

import pytest

from taxaflow.llm import line_dedup


def brute(rows, t):
    """Line numbers that go, by (doc, text); greedy in order."""
    kept, out = [], {}
    order = sorted({(d, x or "") for d, x in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    for d, text in order:
        for at, line in enumerate(text.split("\n")):
            words = frozenset(w for w in re.split("[\x20\x09-\x0d]+", line) if w)
            if words:
                if any(len(words & k) >= t * len(words | k) - 1e-9 for k in kept):
                    out.setdefault((d, text), []).append(at)
                else:
                    kept.append(words)
    return out


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = ["the", "of", "and", "to"]
    base = [[draw.choice(common if draw.random() < 0.3 else vocabulary) for _ in range(draw.choice([1, 2, 3, 4, 5, 6, 10, 20, 40]))] for _ in range(60)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(draw.randint(0, 8)):
            own = list(draw.choice(base))
            for _ in range(draw.randint(0, max(1, len(own) // 6))):
                k = draw.randrange(len(own))
                draw.choice([lambda: own.insert(k, draw.choice(vocabulary)), lambda: own.__setitem__(k, draw.choice(vocabulary)), lambda: len(own) > 1 and own.pop(k)])()
                k = 0
            lines.append(draw.choice(["", " "]) + draw.choice([" ", "  ", "\t"]).join(own))
        rows.append((d * 3, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed) + [(None, "lonely line of six words here\n\n \nx"), (500, None), (501, ""), (502, "x\nx\nx y"), (503, "big " + " ".join(f"b{i}" for i in range(3000)) + "\nother line"), (504, " ".join(f"b{i}" for i in range(2900)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("list", line_dedup.F.lit(1)).withColumn("node", line_dedup.F.lit("n"))
    want = brute(rows, 0.8)
    got = {(r.doc_id): r.text for r in line_dedup.line_dedup(df).collect()}
    assert len(got) == len(rows)
    for d, text in rows:
        lines = (text or "").split("\n")
        left = "\n".join(x for i, x in enumerate(lines) if i not in want.get((d, text or ""), ()))
        assert (got[d] or "") == left, (d, text)


def test_near_group_and_empty(spark):
    words = [f"v{i}" for i in range(30)]
    rows = [(i, " ".join([*words[:i], f"odd{i}", *words[i + 1 :]])) for i in range(30)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.line_dedup(df).collect())[:2] == [(0, rows[0][1]), (0, rows[0][1])]
    assert sum(bool(r.text) for r in line_dedup.line_dedup(df).collect()) == 2
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match=r"0\.75"):
        line_dedup.line_decisions(df, 0.7)


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    plan = line_dedup.line_dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_report(spark):
    df = spark.createDataFrame([(1, "a b\n\na b\nc"), (2, None), (None, "c"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed, r.removed_lines) for r in line_dedup.line_report(df).collect())
    assert got == [("1", 3, 2, "2,3"), ("2", 0, 0, ""), ("3", 1, 1, "0"), ("3", 1, 1, "0"), ("None", 1, 0, "")]
