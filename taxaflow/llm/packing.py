"""Best-fit packing by the sum-of-squares rule.

Documents are tokenised where they lie and cut into pieces of at most a sequence's length (only longer
ones are cut). Pieces are dealt to groups of a few thousand, and in each group, longest first, a piece
goes where the sum over all residual gaps of the squared number of open bins becomes smallest: into an
open bin or a new one. Groups share no bins, so they are packed side by side on any number of machines;
what that costs is the last few bins of each group.

Null text counts as empty: a document of the separator alone. Repeated rows are packed as often as they
occur; a null doc_id stays null; extra columns are ignored; an empty table gives no sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
SEPARATOR = 0
#: Pieces packed together.
GROUP_PIECES = 4096
#: Words, and runs of words, whose ids a worker keeps; then it starts anew.
CACHE_ENTRIES = 1_200_000


class Words:
    """Ids as little-endian uint32 bytes, by words.

    The tokenizer splits a normalised text into words and merges within them, so runs without white
    space and the words in them are encoded once and kept. That shortcut is taken where its normalisation is
    plain lower-casing (Latin letters without combining marks, no number signs but 0 to 9); every other
    text goes through the tokenizer as a whole.
    """

    #: The tokenizer file's own splitting pattern, as it reads on such texts.
    SPLIT = r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\w\s]|_)+"
    ODD = "[^\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e\u20ac]|<[|]"

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ending[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.split = re.compile(self.SPLIT).findall
        self.odd = re.compile(self.ODD).search
        self.held: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, runs: list[str]) -> None:
        """Encode runs without white space. New words are encoded as one text: each ends with a token
        that ends a word, which tells them apart."""
        mixed = [r for r in runs if not r.isalpha()]
        parts = list(map(self.split, mixed))
        new = list(set(runs).difference(mixed).union(*parts).difference(self.held))
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            ids = self.whole([" ".join(some)])[0]
            ends = (4 * np.flatnonzero(self.ending[np.frombuffer(ids, dtype="<u4")]) + 4).tolist()
            if len(ends) == len(some):
                self.held.update(zip(some, (ids[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            else:
                self.held.update(zip(some, self.whole(some), strict=True))
        held = self.held.__getitem__
        self.held.update([(r, b"".join(map(held, own))) for r, own in zip(mixed, parts, strict=True)])

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.held) > CACHE_ENTRIES:
            self.held.clear()
        out: list[bytes] = [b""] * len(texts)
        odd = [i for i, t in enumerate(texts) if self.odd(t)]
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = ids
        runs = {i: texts[i].lower().split() for i in set(range(len(texts))).difference(odd)}
        self.learn(list(set().union(*runs.values()).difference(self.held)))
        held = self.held.__getitem__
        for i, own in runs.items():
            out[i] = b"".join(map(held, own))
        return out


@lru_cache(maxsize=1)
def words(path: str) -> Words:
    """One for each worker process."""
    return Words(path)


def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian uint32, if kept) of every piece."""
    last = np.array([SEPARATOR], dtype="<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words(tokenizer)
        for part in parts:
            for at in range(0, part.num_rows, 512):
                some = part.slice(at, 512)
                rows = []
                for doc, ids in zip(some.column(0).to_pylist(), own.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    ids += last
                    for k in range(0, len(ids), 4 * capacity):
                        cut = ids[k : k + 4 * capacity]
                        rows.append((doc, k // (4 * capacity), k // 4, len(cut) // 4, zlib.crc32(cut), cut))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: 5 + keep_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(batches, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the order given.

    Full bins count for nothing, so filling one lowers the sum by its old gap's share alone; of equal
    choices an open bin goes before a new one, and the smallest gap first.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, dtype=np.int64)
    never = np.int64(1) << 60
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        gap = capacity
        if s < capacity:
            there = count[s:capacity]
            change = 2 * (count[: capacity - s] - there) + 2
            change[0] = 1 - 2 * there[0]
            change[there == 0] = never
            best = int(change.argmin())
            if change[best] <= 2 * count[capacity - s] + 1:
                gap = s + best
        if gap == capacity:
            own = made
            made += 1
        else:
            own = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = own, capacity - gap
        if gap > s:
            open_bins[gap - s].append(own)
            count[gap - s] += 1
    return bins, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """parts (a table with length and whatever else) with sequence_id and offset. parts is read twice."""
    groups = max(1, -(-parts.count() // group_pieces))
    schema = parts.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("__group").sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece") if c in rows.column_names)])
        bins, offsets = sum_of_squares(rows.column("length").to_numpy(), capacity)
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = parts.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.groupBy("__group").applyInArrow(fill, schema)


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of df (doc_id, text)."""
    return pack(common.cut(pieces(df, tokenizer, capacity), "pieces"), capacity, group_pieces)
