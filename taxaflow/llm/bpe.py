"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes are a linked list. Each adjacent pair that has a merge rank waits in that rank's
bucket of positions; a two-level bitmap over the ranks gives the lowest waiting rank by find-first-set.
Entries whose pair has changed since are skipped when they come up. A pre-token of n bytes takes
O(n log n) time whatever its content, so a run of 100,000 equal letters is no special case.

Texts are encoded where they lie: no shuffle, one pass, memory bounded by a batch and a word cache.
Null text counts as empty and gives no ids. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose ids a worker keeps; then it starts anew.
CACHE_ENTRIES = 1_000_000
#: Longer pre-tokens aren't kept.
CACHE_BYTES = 64


class Codec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        #: Ranks of the pairs of single bytes, -1 for none.
        self.two = {(a, b): self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        # The pattern's white space is Unicode's White_Space property, spelled out.
        space = r"\t-\r \x85\xa0  -     　"
        inside = regex.sub(r"\[\^\\s", lambda _: "[^" + space, pattern)
        self.split = regex.compile(inside.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")).findall
        self.cache: dict[str, tuple[int, bytes, bytes]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.

        top has a bit for each word of 256 ranks in which pairs wait, bits a bit for each rank of a word,
        buckets a position or a heap of them for each rank; so the leftmost pair of the lowest rank comes first.
        """
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        ends = list(range(1, n + 1))  # of the part that starts at a position; also the next part's start
        before = list(range(-1, n - 1))
        waiting = list(map(self.two.__getitem__, zip(piece, piece[1:])))
        waiting.append(-1)
        top, bits, buckets = 0, {}, {}
        for i, rank in enumerate(waiting):
            if rank >= 0:
                if rank in buckets:
                    held = buckets[rank]
                    if type(held) is int:
                        buckets[rank] = [held, i]
                    else:
                        held.append(i)  # ascending, so a heap
                else:
                    buckets[rank] = i
                    word = rank >> 8
                    bits[word] = bits.get(word, 0) | 1 << (rank & 255)
                    top |= 1 << word
        while top:
            word = (top & -top).bit_length() - 1
            own = bits[word]
            rank = word << 8 | (own & -own).bit_length() - 1
            held = buckets[rank]
            if type(held) is not int and len(held) > 1:
                i = heapq.heappop(held)
            else:
                i = held if type(held) is int else held[0]
                del buckets[rank]
                own &= own - 1
                bits[word] = own
                if not own:
                    top &= top - 1
            if waiting[i] != rank:
                continue  # stale: the pair has changed since
            j = ends[i]
            end = ends[i] = ends[j]
            waiting[j] = -1
            if end < n:
                before[end] = i
                found = [(i, rank_of(piece[i : ends[end]], -1))]
            else:
                found = [(i, -1)]
            left = before[i]
            if left >= 0:
                found.append((left, rank_of(piece[left:end], -1)))
            for at, rank in found:
                if waiting[at] != rank:
                    waiting[at] = rank
                    if rank < 0:
                        continue
                    if rank in buckets:
                        held = buckets[rank]
                        if type(held) is int:
                            buckets[rank] = [held, at] if held < at else [at, held]
                        else:
                            heapq.heappush(held, at)
                    else:
                        buckets[rank] = at
                        word = rank >> 8
                        bits[word] = bits.get(word, 0) | 1 << (rank & 255)
                        top |= 1 << word
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : ends[i]]])
            i = ends[i]
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.split(text):
            ids += self.merge(piece.encode("utf-8", "surrogatepass"))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def rendered(self, piece: str) -> tuple[int, bytes, bytes]:
        """How many ids a pre-token has, the ids as text, and the bytes they decode to."""
        ids = self.merge(piece.encode("utf-8", "surrogatepass"))
        found = len(ids), " ".join(map(str, ids)).encode(), self.decode(ids)
        if len(piece) <= CACHE_BYTES:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[piece] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """n_tokens, SHA-256 of the decimal ids joined by a space, SHA-256 of the decoded bytes."""
        pieces = self.split(text)
        parts = list(map(self.cache.get, pieces))
        if None in parts:
            held, make = self.cache.get, self.rendered
            parts = [part or held(p) or make(p) for part, p in zip(parts, pieces, strict=True)]
        ids = hashlib.sha256(b" ".join([p[1] for p in parts])).hexdigest()
        return sum([p[0] for p in parts]), ids, hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"the rank file {path} must lie on every executor")
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column ids: array<int>, the encoding of its text column."""
    schema = df.select("*", F.lit(None).cast("array<int>").alias(ids)).schema
    at = df.columns.index(text)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in parts:
            found = pa.array([own.encode(t or "") for t in part.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, ids])

    return df.mapInArrow(batches, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a column decoded: binary, the bytes of its ids column (null: empty)."""
    schema = df.select("*", F.lit(None).cast("binary").alias(out)).schema
    at = df.columns.index(ids)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in parts:
            found = pa.array([own.decode(x or []) for x in part.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, out])

    return df.mapInArrow(batches, schema)


def round_trip(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of df (doc_id, text), without the ids'
    way through the JVM. Repeated rows give repeated results, null doc_ids stay null."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in parts:
            found = [own.digest(t or "") for t in part.column(1).to_pylist()]
            n, ids, back = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
