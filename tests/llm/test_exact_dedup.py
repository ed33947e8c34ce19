import numpy as np
import pyarrow as pa

from taxaflow.llm import exact_dedup


def test_block_sends_each_fingerprint_once():
    fp = np.array([7] * 1000 + [-5, 9, -5], dtype=np.int64)
    sent = exact_dedup.code_block(pa.table({"src": ["a"] * len(fp), "fp": fp}), 2).to_pylist()
    got = {}
    for r in sent:
        flags = np.unpackbits(np.frombuffer(r["twice"], dtype=np.uint8))[: r["n"]]
        base = np.uint64(r["owner"] << 63)
        got |= {int(v + base): bool(f) for v, f in zip(exact_dedup.golomb_decode(r["code"], r["n"], r["bits"]), flags, strict=True)}
    assert got == {7: True, 9: False, 2**64 - 5: True}


def test_suspects(spark):
    texts = ["hot"] * 500 + ["a b", "ab", "alone"] + [f"other {i}" for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for rows in (10, 10_000):
        prints = exact_dedup.fingerprints(df)
        found = exact_dedup.suspects(prints, rows).join(prints, "rid").select("doc_id").collect()
        assert sorted(r.doc_id for r in found) == list(range(502))
