"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda.

The symbols of a text are a linked list. Every adjacent pair whose union is a piece waits on an agenda, the
best score first and of equal scores the leftmost; entries whose symbols have changed since are skipped when
they come up. What stays is looked up, and a symbol without a piece of its own becomes its UTF-8 bytes.

Where no piece of the vocabulary holds a space mark after another character (found when it is loaded), no
merge crosses such a place, so a text falls into segments there that are encoded on their own and remembered.
Otherwise the whole text is one segment. A segment of n characters takes O(n log n) time whatever it holds.

Texts are encoded where they lie: no shuffle, memory bounded by an Arrow batch and the segment cache. Null
text counts as empty and gives no ids; repeated rows give repeated results; an empty table gives none; extra
columns are ignored by round_trip and carried along by encode and decode, where the new column must not
clash with one of theirs (a clash raises a ValueError).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark that stands for a space.
SPACE = "▁"
#: Segments whose ids a worker keeps; then it starts anew. Longer ones aren't kept.
CACHE_ENTRIES, CACHE_CHARS = 1_000_000, 48
#: Segments whose agenda is a list; longer ones have a heap.
SHORT = 24
#: New segments that go to the library in one call.
CHECK_SEGMENTS = 20_000


class Pieces:
    """Encoder and decoder for one model file; the library is held beside it for checks."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds, how = proto.ModelProto.SentencePiece, model.normalizer_spec
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError(f"{path} is no merge-type vocabulary with bytes to fall back on")
        if how.precompiled_charsmap or how.remove_extra_whitespaces or not how.escape_whitespaces or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path} normalises texts or has pieces of its user's, which this encoder doesn't know")
        self.prefix = SPACE if how.add_dummy_prefix else ""
        normal = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        #: Of each piece its rank on the agenda (equal scores, equal ranks) and its id.
        order = {s: k for k, s in enumerate(sorted({p.score for p in model.pieces}, reverse=True))}
        self.rank = {p: order[model.pieces[k].score] for p, k in normal.items()}
        self.ids = normal
        self.byte_ids = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.bytes_of = {k: p.encode().replace(SPACE.encode(), b" ") for p, k in normal.items()} | {k: bytes((b,)) for b, k in self.byte_ids.items()}
        whole = any(SPACE in p.lstrip(SPACE) for p in normal)
        self.segments = re.compile("(?s).+" if whole else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.text_of = [b"%d" % k for k in range(len(model.pieces))]
        self.cache: dict[str, tuple[int, bytes, bytes]] = {}
        self.unchecked: list[tuple[str, list[int]]] = []
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def merge_short(self, segment: str) -> list[int]:
        """The ids of a short segment; its agenda is a list in the order of places, whose first least entry is next."""
        rank_of, none = self.rank.get, len(self.ids)
        symbols = list(segment)
        agenda = [rank_of(pair, none) for pair in map(add, segment, segment[1:])]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            symbol = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank_of(symbol + symbols[i + 1], none)
            if i:
                agenda[i - 1] = rank_of(symbols[i - 1] + symbol, none)
        ids, known = [], self.ids.get
        for symbol in symbols:
            k = known(symbol)
            if k is None:
                ids += map(self.byte_ids.__getitem__, symbol.encode())
            else:
                ids.append(k)
        return ids

    def merge(self, segment: str) -> list[int]:
        """The ids of one segment."""
        rank_of, n = self.rank.get, len(segment)
        if n <= SHORT:
            return self.merge_short(segment)
        bits = n.bit_length()
        low = (1 << bits) - 1
        ends = list(range(1, n + 1))  # of the symbol that starts at a place, also the next one's start; 0 once merged away
        before = list(range(-1, n - 1))
        # An entry is one number: rank, first place and end of the union, in this order.
        agenda = [(r << bits | i) << bits | i + 2 for i, r in enumerate(map(rank_of, map(add, segment, segment[1:]))) if r is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i, end = entry >> bits & low, entry & low
            j = ends[i]
            if not j or j == n or ends[j] != end:
                continue  # stale: one of the two symbols has changed since
            ends[i], ends[j] = end, 0
            if end < n:
                before[end] = i
                r = rank_of(segment[i : ends[end]])
                if r is not None:
                    heappush(agenda, (r << bits | i) << bits | ends[end])
            left = before[i]
            if left >= 0:
                r = rank_of(segment[left:end])
                if r is not None:
                    heappush(agenda, (r << bits | left) << bits | end)
        ids, i, known = [], 0, self.ids.get
        while i < n:
            symbol = segment[i : ends[i]]
            k = known(symbol)
            if k is None:
                ids += map(self.byte_ids.__getitem__, symbol.encode())
            else:
                ids.append(k)
            i = ends[i]
        return ids

    def normal(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str) -> list[int]:
        return [k for s in self.segments(self.normal(text)) for k in self.merge(s)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ids of control pieces give nothing, the unknown piece its sign."""
        unknown = self.library.unk_id()
        plain = b"".join(self.bytes_of.get(k, b" \xe2\x81\x87 " if k == unknown else b"") for k in ids)
        return plain.decode("utf-8", "replace").removeprefix(" " if self.prefix else "")

    def rendered(self, segment: str) -> tuple[int, bytes, bytes]:
        """How many ids a segment has, the ids as text, and the bytes they decode to."""
        ids = self.merge(segment)
        found = len(ids), b",".join(map(self.text_of.__getitem__, ids)), b"".join(map(self.bytes_of.__getitem__, ids))
        self.unchecked.append((segment, ids))
        if len(segment) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[segment] = found
        return found

    def parts(self, text: str) -> tuple[int, bytes, bytes]:
        """How many ids a text has, the decimal ids joined by commas, and the decoded text in UTF-8."""
        segments = self.segments(self.normal(text))
        found = list(map(self.cache.get, segments))
        if None in found:
            held, make = self.cache.get, self.rendered
            found = [f or held(s) or make(s) for f, s in zip(found, segments, strict=True)]
        back = b"".join([f[2] for f in found])
        return sum([f[0] for f in found]), b",".join([f[1] for f in found]), back.removeprefix(b" ") if self.prefix else back

    def check(self) -> None:
        """Hold the ids of the segments merged since the last check against the library's; a difference is an error.

        The library puts its own mark before a text, so it is given each segment without the first one."""
        fresh = [(s[len(self.prefix) :], ids) for s, ids in self.unchecked if len(s) > len(self.prefix)]
        self.unchecked = []
        theirs = self.library.encode([s for s, _ in fresh], num_threads=1)
        for (segment, ids), other in zip(fresh, theirs, strict=True):
            if ids != other:
                raise ValueError(f"the library encodes {segment[:80]!r} as {other[:80]}, not as {ids[:80]}")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One encoder for each worker process; the model file must lie on every executor."""
    return Pieces(path)


def _added(df: DataFrame, column: str, kind: str) -> object:
    if column.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {column} already")
    return df.select("*", F.lit(None).cast(kind).alias(column)).schema


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column ids: array<int>, the encoding of its text column."""
    schema, at = _added(df, ids, "array<int>"), df.columns.index(text)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for part in parts:
            found = pa.array([own.encode(t or "") for t in part.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, ids])

    return df.mapInArrow(batches, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a column decoded, the text of its ids column (null: empty)."""
    schema, at = _added(df, out, "string"), df.columns.index(ids)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for part in parts:
            found = pa.array([own.decode(x or []) for x in part.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, out])

    return df.mapInArrow(batches, schema)


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of df (doc_id, text), without the ids' way
    through the JVM. The segments that a batch brought are checked against the library at its end."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for part in parts:
            n, ids, back = [], [], []
            for text in part.column(1).to_pylist():
                count, own_ids, plain = own.parts(text or "")
                n.append(count)
                ids.append(hashlib.sha256(own_ids).hexdigest())
                back.append(hashlib.sha256(plain).hexdigest())
                if len(own.unchecked) >= CHECK_SEGMENTS:
                    own.check()
            own.check()
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
