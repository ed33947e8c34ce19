import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from taxaflow.llm import common, queries, sharding


def rows_of(n):
    rows = [(i, f"text of row {i} " * (i % 7), "x") for i in range(n)]
    rows += [(None, None, "x"), (None, "no id", "x"), (3, "same id", "x"), (n, "é日本😀" * 5, "x"), (n + 1, "long " * 50_000, "x"), (n + 2, "", "x")]
    return rows + [(9, "one row again and again", "x")] * (n // 2) + [(n + 10 + i, "one text", "x") for i in range(n // 4)]


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, Shard string")
    for name in ("bucket", "in_bucket", "slot", "start", "of_shard", "rows_of", "id"):
        df = df.withColumn(name, F.lit("x"))
    return common.cut(df.repartition(3), "in")


@pytest.mark.parametrize(("n", "bytes_"), [(400, 1 << 24), (400, 2000), (1, 10)])
def test_shards(spark, n, bytes_):
    rows = rows_of(n)
    df = table(spark, rows)
    got = sharding.write_shards(df, common.shared_path(spark, "shards"), bucket_bytes=bytes_)
    shard, bucket, place, slot = got.columns[-4:]
    assert got.columns[: len(df.columns)] == df.columns
    found = got.select("doc_id", "text", F.col(shard).alias("s"), F.col(bucket).alias("b"), F.col(slot).alias("n")).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(r[:2] for r in rows)
    law = {}
    for r in found:  # doc_id alone decides the shard
        assert law.setdefault(r.doc_id, r.s) == r.s
    for s in range(8):
        assert sorted(r.n for r in found if r.s == s) == list(range(sum(r.s == s for r in found)))
    if bytes_ == 2000:  # the repeated row is spread over its shard's buckets
        assert len({r.b for r in found if r.doc_id == 9}) > 1
        by = sorted(found, key=lambda r: (r.s, r.n))
        in_order = sum(a.doc_id is not None and b.doc_id is not None and a.doc_id < b.doc_id for a, b in zip(by, by[1:], strict=False))
        assert 0.2 < in_order / len(found) < 0.8


def test_key_law(spark):
    ids = spark.range(5000).select(F.col("id").alias("doc_id")).unionByName(spark.createDataFrame([(None,)], "doc_id long"))
    got = ids.select("doc_id", *(sharding.key_shard(F.col("doc_id"), k).alias(f"k{k}") for k in (7, 8, 9))).collect()
    for a, b in (("k7", "k8"), ("k8", "k9")):
        assert all(r[b] in (r[a], int(b[1]) - 1) for r in got)
        moved = sum(r[a] != r[b] for r in got)
        assert abs(moved - 5000 / int(b[1])) < 120
    assert max(Counter(r.k8 for r in got).values()) < 5000 / 8 * 1.2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    got = sharding.write_shards(df, common.shared_path(spark, "shards"))
    assert got.columns == ["doc_id", "text", "shard", "bucket", "in_bucket", "slot"] and got.count() == 0


def test_query(spark, tmp_path):
    rows = rows_of(50)
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op6_sharding(spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"key"} and all(r.grown_shard in (r.shard, 8) for r in got)
