import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline

from .test_line_dedup import brute as brute_lines
from .test_line_dedup import corpus
from .test_quality import brute_rules
from .test_tokens import brute_simhash


def test_equals_brute_force(spark, tmp_path):
    rows = [(d, t, "a" if d % 2 else "b", len(t)) for d, t in corpus(5)]
    long = " ".join(f"q{i}" for i in range(4000))
    rows += [(1000, long, None, 0), (1001, long + " end", None, 0), (1002, None, "a", None), (1003, "short one", "a", 9), (1004, "a b c d e " * 30, "b", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumn("lang", corpus_pipeline.common.F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    good = {r[0] for r in brute_rules([r[:3] for r in rows], 20, 0.1) if r[-1]}
    left = [(d, t) for d, t, _, _ in rows if d in good]
    gone = brute_lines(left, 0.8)
    left = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ()))) for d, t in left]
    prints = {d: brute_simhash(t) for d, t in left}
    root = {d: d for d in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in left if root[d] == d}
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.length <= 2048
    assert {d: (want.get(d), got.get(d)) for d in want | got if want.get(d) != got.get(d)} == {}
    assert 1000 in got and 5 < len(got) < len(rows)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").schema.simpleString() == docs.schema.simpleString()
