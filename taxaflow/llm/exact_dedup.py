"""Exact dedup by a Golomb-coded fingerprint exchange.

Only fingerprints cross the network for documents that have no copy:

1. every row gets a 64-bit fingerprint of its normalised text; the fingerprints of a source partition
   are split by owner, sorted, and sent to each owner as one Golomb-Rice-coded block;
2. an owner merges the blocks it got and answers each with a bitmap that marks the fingerprints seen
   more than once;
3. the source partitions read their bitmaps and name the suspects;
4. only the suspects' texts are grouped, by the bytes themselves, and the groups are resolved.

Texts are equal when identical after deleting space and U+0009 to U+000D. Of equal texts the row with
the most code points in the original text stays, then the smallest doc_id (null doc_ids last), then,
for repeated rows, the first in the order of the stored row numbers. Null text counts as empty; empty
texts equal each other. An empty table gives an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fingerprints per owner; an owner holds that many 8-byte values at once.
OWNER_ROWS = 500_000
#: Source partitions are cut into blocks of so many rows, so that no block grows with a partition.
BLOCK_ROWS = 100_000
#: Suspect fingerprints are broadcast up to so many.
BROADCAST_ROWS = 1_000_000


def golomb_encode(values: np.ndarray, parameter_bits: int) -> bytes:
    """Golomb-Rice code of a sorted uint64 array: gaps with unary quotients and fixed remainders.

    >>> golomb_decode(golomb_encode(np.array([3, 3, 900], dtype=np.uint64), 4), 3, 4).tolist()
    [3, 3, 900]
    """
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(parameter_bits)).astype(np.int64)
    remainders = gaps & np.uint64((1 << parameter_bits) - 1)
    ends = np.cumsum(quotients + 1 + parameter_bits)
    bits = np.zeros(int(ends[-1]), dtype=np.uint8)
    stops = ends - parameter_bits - 1
    bits[stops] = 1
    for k in range(parameter_bits):
        bits[stops + 1 + k] = (remainders >> np.uint64(parameter_bits - 1 - k)) & np.uint64(1)
    return np.packbits(bits).tobytes()


def golomb_decode(code: bytes, n: int, parameter_bits: int) -> np.ndarray:
    """The n sorted values of golomb_encode."""
    if not n:
        return np.zeros(0, dtype=np.uint64)
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8))
    ones = np.flatnonzero(bits)
    stops = np.empty(n, dtype=np.int64)
    starts = np.empty(n, dtype=np.int64)
    at = 0
    for i in range(n):
        starts[i] = at
        stops[i] = ones[np.searchsorted(ones, at)]
        at = int(stops[i]) + 1 + parameter_bits
    remainders = np.zeros(n, dtype=np.uint64)
    for k in range(parameter_bits):
        remainders = (remainders << np.uint64(1)) | bits[stops + 1 + k].astype(np.uint64)
    quotients = (stops - starts).astype(np.uint64)
    return np.cumsum((quotients << np.uint64(parameter_bits)) | remainders, dtype=np.uint64)


def rice_bits(span_bits: int, n: int) -> int:
    """The remainder width near the mean gap, at which Golomb-Rice codes are shortest."""
    return max(0, min(56, span_bits - max(n, 1).bit_length()))


def _owner_split(values: np.ndarray, owners: int) -> np.ndarray:
    """Owner of each fingerprint: the top 32 bits scaled to the number of owners, so that order holds."""
    return ((values >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def fingerprints(df: DataFrame) -> DataFrame:
    """rid, doc_id, src, fp, n, sha per row, held in the shared folder so that later passes agree."""
    norm = F.regexp_replace(common.text_of(), f"{common.WS}+", "")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"), F.char_length(common.text_of()).cast("long").alias("n"))
    rid = F.monotonically_increasing_id()
    return common.cut(
        rows.select(
            rid.alias("rid"), "doc_id", F.concat_ws("-", F.spark_partition_id(), F.floor(rid.bitwiseAND(F.lit((1 << 33) - 1)) / BLOCK_ROWS)).alias("src"),
            F.xxhash64("norm").alias("fp"), "n", F.sha2(F.encode("norm", "utf-8"), 256).alias("sha"),
        ),
        "fingerprints",
    )


def code_block(block: pa.Table, owners: int) -> pa.Table:
    """For each owner the block's distinct fingerprints, coded, and a bit for each that the block holds twice."""
    values, counts = np.unique(block.column("fp").to_numpy().view(np.uint64), return_counts=True)
    owner = _owner_split(values, owners)
    out = {"owner": [], "src": [], "n": [], "bits": [], "code": [], "twice": []}
    src = block.column("src")[0].as_py()
    for o in np.unique(owner):
        own = values[owner == o]
        bits = rice_bits(64 - max(0, owners.bit_length() - 1), len(own))
        base = np.uint64(int(-(-(int(o) << 32) // owners)) << 32)
        row = (int(o), src, len(own), bits, golomb_encode(own - base, bits), np.packbits(counts[owner == o] > 1).tobytes())
        for k, v in zip(out, row, strict=True):
            out[k].append(v)
    return pa.table(out, schema=pa.schema([("owner", pa.int64()), ("src", pa.string()), ("n", pa.int64()), ("bits", pa.int32()), ("code", pa.binary()), ("twice", pa.binary())]))


def suspects(prints: DataFrame, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """The rids whose fingerprint occurs more than once, by the exchange of coded blocks and bitmaps."""
    owners = max(1, -(-prints.count() // owner_rows))

    def send(block: pa.Table) -> pa.Table:
        return code_block(block, owners)

    def answer(blocks: pa.Table) -> pa.Table:
        rows = blocks.to_pylist()
        held = [golomb_decode(r["code"], r["n"], r["bits"]) for r in rows]
        own_twice = [own[np.unpackbits(np.frombuffer(r["twice"], dtype=np.uint8))[: len(own)].astype(bool)] for r, own in zip(rows, held, strict=True)]
        seen, counts = np.unique(np.concatenate(held), return_counts=True)
        twice = np.concatenate([seen[counts > 1], *own_twice])
        out = {"src": [], "owner": [], "bitmap": []}
        for r, own in zip(rows, held, strict=True):
            marked = np.isin(own, twice)
            if marked.any():
                out["src"].append(r["src"])
                out["owner"].append(r["owner"])
                out["bitmap"].append(np.packbits(marked).tobytes())
        return pa.table(out, schema=pa.schema([("src", pa.string()), ("owner", pa.int64()), ("bitmap", pa.binary())]))

    def receive(block: pa.Table, bitmaps: pa.Table) -> pa.Table:
        values, place = np.unique(block.column("fp").to_numpy().view(np.uint64), return_inverse=True)
        owner = _owner_split(values, owners)
        marked = np.zeros(len(values), dtype=bool)
        for r in bitmaps.to_pylist():
            own = np.flatnonzero(owner == r["owner"])
            marked[own] = np.unpackbits(np.frombuffer(r["bitmap"], dtype=np.uint8))[: len(own)].astype(bool)
        return pa.table({"rid": block.column("rid").to_numpy()[marked[place]]}, schema=pa.schema([("rid", pa.int64())]))

    small = prints.select("src", "rid", "fp")
    codes = small.select("src", "fp").groupBy("src").applyInArrow(send, "owner long, src string, n long, bits int, code binary, twice binary")
    bitmaps = codes.groupBy("owner").applyInArrow(answer, "src string, owner long, bitmap binary")
    return small.groupBy("src").cogroup(bitmaps.groupBy("src")).applyInArrow(receive, "rid long")


def exact_dedup(df: DataFrame, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of df (doc_id, text).

    Groups of any size are resolved with map-side combined aggregates; no group is gathered in a task.
    """
    prints = fingerprints(df)
    marked = common.cut(suspects(prints, owner_rows), "suspects")
    doubtful = prints.join(marked, "rid", "left_semi")
    # Byte verification: suspects' texts are read again by their fingerprints and grouped by content.
    norm = F.regexp_replace(common.text_of(), f"{common.WS}+", "")
    texts = df.select(norm.alias("norm")).withColumn("fp", F.xxhash64("norm"))
    wanted = common.cut(doubtful.select("fp").distinct(), "wanted")
    if wanted.count() <= BROADCAST_ROWS:  # 8 bytes each; beyond that, both sides are shuffled
        wanted = F.broadcast(wanted)
    seen = texts.join(wanted, "fp", "left_semi").groupBy("norm").agg(F.count(F.lit(1)).alias("copies"))
    verified = seen.where("copies > 1").select(F.sha2(F.encode("norm", "utf-8"), 256).alias("sha"))
    best = F.max(F.struct(F.col("n"), F.col("doc_id").isNotNull().alias("has_id"), (-F.col("doc_id")).alias("minus_id"), (-F.col("rid")).alias("minus_rid")))
    groups = doubtful.groupBy("sha").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).join(verified, "sha", "left_semi")
    flat = groups.select("sha", "group_size", (-F.col("best.minus_id")).alias("keep_id"), (-F.col("best.minus_rid")).alias("keep_rid"))
    # Written, so that the join below gets exchanges of its own, whose hot partitions Spark can split.
    flat = common.cut(flat, "groups")
    copied = doubtful.join(flat, "sha").select("rid", "group_size", "keep_id", "keep_rid")
    return prints.join(copied, "rid", "left").select(
        "doc_id",
        F.when(F.col("keep_rid").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.coalesce("keep_rid", "rid") == F.col("rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
