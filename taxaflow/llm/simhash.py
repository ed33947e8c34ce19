"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within radius bits have a common variant within half the radius of either (radius 2:
the fingerprint itself or one flipped bit). Every distinct fingerprint emits all its variants, the
variants are shuffled, and fingerprints that meet are verified and linked. Those that meet on one
variant all lie within half the radius of it, so a bucket holds 65 fingerprints at most (radius 2); each
is linked to the least one, which joins the same components as all pairs would.

Null text counts as empty; a text without words has fingerprint zero and is linked like any other.
Documents of one fingerprint are one class, so copies are never expanded to pairs. Ties go to the
smallest doc_id; a null doc_id is never a component's name unless all of its class are null. Repeated
rows give repeated results; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common
from .components import components

RADIUS = 2
WORDS = 3
#: Shingle hashes that are turned into bits at once.
CHUNK = 1 << 16


def simhash(text: str, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint: a bit is set if it is in over half of the shingles' XXH64 (seed 42)."""
    # bytes.lower and bytes.split know A-Z and exactly the six white spaces space and U+0009 to U+000D.
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    h = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return h(b" ".join(tokens), 42)
    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))
    hashes = np.fromiter((h(s, 42) for s in shingles), dtype=np.uint64, count=len(tokens) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, key (XXH64 of the text) and fp (the fingerprint as a signed long) for each row of df (doc_id, text)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.array([simhash(t or "", words) for t in part.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found.view(np.int64))], names=["doc_id", "key", "fp"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), F.col("text")).mapInArrow(batches, "doc_id long, key long, fp long")


def _key() -> Column:
    return F.xxhash64(common.text_of())


def variants(fp: Column, radius: int) -> Column:
    """All values within half the radius (rounded up) of fp, as an array."""
    masks = {0}
    for _ in range(-(-radius // 2)):
        masks |= {m ^ (1 << k) for m in masks for k in range(64)}
    signed = sorted(m - (1 << 64) if m >> 63 else m for m in masks)
    return F.array(*(fp.bitwiseXOR(F.lit(m)) for m in signed))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified pairs (a, b) of distinct fingerprints (column fp) that span the same components as all
    pairs at radius bits or fewer. radius is even, so that all who meet on a variant link with each other."""
    if radius % 2:
        raise ValueError("an even radius is needed: buckets are then cliques")
    ball = prints.select("fp", F.explode(variants(F.col("fp"), radius)).alias("variant"))
    # A bucket lies in a ball of half the radius, so its size is bounded whatever the data.
    met = ball.groupBy("variant").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    pairs = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_components(df: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, key (XXH64 of the text), fp, root (a name of the component) and component_id (smallest doc_id reachable)
    for every row of df (doc_id, text). Long texts are hashed whole, a chunk of shingles at a time."""
    prints = common.cut(fingerprints(df, words), "simhash")
    classes = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    # The table is small, but each of its rows emits all variants: spread it over all cores first.
    spread = classes.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism), "fp")
    found = components(links(spread, radius)).withColumnRenamed("component", "root")
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written, so that Spark may split a fingerprint that a large part of all rows share.
    ids = common.cut(rooted.join(named, "root").select("fp", "root", "component_id"), "components")
    return prints.join(ids, "fp").select("doc_id", "key", "fp", "root", "component_id")


def near_dedup(df: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """The rows of df that stay: of each component the one with the smallest doc_id, all columns kept.

    Where several texts of a component have that doc_id, that with the least hash stays, and of repeated rows one; a
    doc_id that stands for texts of several components stays once for each. Null counts as a doc_id that is only
    taken where the component has no other."""
    doc, key, nth = (common.fresh_name(df, n) for n in ("__doc", "__key", "__nth"))
    marked = simhash_components(df, radius, words)
    stay = marked.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("doc_id").alias(doc), F.min("key").alias(key)).drop("root")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (_key() == F.col(key))
    order = F.row_number().over(Window.partitionBy(F.col("doc_id"), _key()).orderBy(_key()))
    return df.join(stay, same, "left_semi").withColumn(nth, order).where(F.col(nth) == 1).select(*df.columns)
