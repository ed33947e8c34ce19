"""Sharding by a two-pass external shuffle, under a consistent key law.

Pass 1 scatters whole records uniformly into buckets that fit a task's memory, by seeded hashes of what
tells them apart and, so that one row repeated without end is spread too, of their place in the input. Pass 2
puts each bucket in a canonical order, Fisher-Yates shuffles it with a generator seeded by the bucket,
and writes it. A bucket's place in its shard is the sum of the counts before it, so slots have no gaps.
The input is a table as read (a stored one, see common.cut), whose rows come in the same order when read again.

The law is `key`: doc_id and the number of shards alone decide the shard, by the highest of one seeded
hash per shard. With one more shard a row moves only into the new one. Null doc_ids hash as a value of
their own; rows of equal doc_id share a shard; repeated rows are rows of their own, whose order among
themselves is any; null text has size 1. Texts of any length are one record; a bucket holds a longer one
than BUCKET_BYTES by itself or with few others. Extra columns are carried along, whatever their names: a new
column gets underscores before its name where there is one of that name. An empty table gives no rows.
"""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

SHARDS = 8
SEED = 20_240_917
#: Text bytes that a bucket should hold.
BUCKET_BYTES = 16 << 20
#: Places in the input that are told apart when rows are dealt.
SALT = 64
#: Bucket starts are broadcast up to so many.
BROADCAST_BUCKETS = 200_000


def key_shard(key: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard whose seeded hash of the key is the greatest."""
    best = F.greatest(*(F.struct(F.xxhash64(F.lit(seed), F.lit(k), F.coalesce(key.cast("string"), F.lit("null"))).alias("h"), F.lit(k).alias("k")) for k in range(shards)))
    return best["k"]


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text and one more."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_records(df: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df with shard, bucket, in_bucket (place after the shuffle) for every row; df has doc_id and text."""
    total = df.agg(F.sum(size_of(F.col("text"))).alias("b")).first()["b"] or 0
    buckets = max(1, -(-total // (bucket_bytes * shards)))
    shard, bucket, place = (common.fresh_name(df, c) for c in ("shard", "bucket", "in_bucket"))
    deal = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text"), F.pmod(F.monotonically_increasing_id(), F.lit(SALT))), F.lit(buckets)).cast("int")
    placed = df.withColumn(shard, key_shard(F.col("doc_id"), shards, seed)).withColumn(bucket, deal)
    doc_at, text_at = df.columns.index("doc_id"), df.columns.index("text")
    schema = T.StructType([*placed.schema.fields, T.StructField(place, T.LongType())])

    def shuffle(key: tuple, rows: pa.Table) -> pa.Table:
        n = rows.num_rows
        # In the order of doc_id and text, columns by number since names may differ in case alone.
        keys = pa.table({"id": rows.column(doc_at), "text": rows.column(text_at).cast(pa.large_binary())})
        order = rows.take(pc.sort_indices(keys, sort_keys=[("id", "ascending"), ("text", "ascending")]))
        draw = random.Random(f"{seed}/{key[0].as_py()}/{key[1].as_py()}")
        perm = list(range(n))
        for i in range(n - 1, 0, -1):
            j = draw.randrange(i + 1)
            perm[i], perm[j] = perm[j], perm[i]
        return order.take(pa.array(perm, pa.int64())).append_column(place, pa.array(range(n), pa.int64()))

    return placed.groupBy(shard, bucket).applyInArrow(shuffle, schema)


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the shuffled shards below path, one folder a shard, and read them back with their slots.

    Rewriting after a lost executor gives the same rows in the same places, but for rows of equal doc_id and text
    whose other columns differ, which may change places among themselves.
    """
    spark = df.sparkSession
    shuffled = shard_records(df, shards, seed, bucket_bytes)
    shard, bucket, place = shuffled.columns[-3:]
    shuffled.write.parquet(path)
    back = spark.read.schema(shuffled.schema).parquet(path)
    # Counts per bucket: one row for each bucket_bytes of text.
    of_shard, of_bucket, start, slot = (common.fresh_name(back, c) for c in ("of_shard", "of_bucket", "start", "slot"))
    counts = back.groupBy(F.col(shard).alias(of_shard), F.col(bucket).alias(of_bucket)).agg(F.count(F.lit(1)).alias("rows_of"))
    before = Window.partitionBy(of_shard).orderBy(of_bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(of_shard, of_bucket, F.coalesce(F.sum("rows_of").over(before), F.lit(0)).cast("long").alias(start))
    if starts.count() <= BROADCAST_BUCKETS:  # 24 bytes each; beyond that both sides are shuffled
        starts = F.broadcast(starts)
    on = (F.col(shard) == F.col(of_shard)) & (F.col(bucket) == F.col(of_bucket))
    return back.join(starts, on).select(*back.columns, (F.col(start) + F.col(place)).alias(slot))
