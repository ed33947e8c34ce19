"""Vector codes by product quantization in whole numbers, with a partial-distance search.

Components become integers, vectors are cut into equal parts, and each part position has a codebook. A round
assigns every part to its nearest entry and moves the entries to the means of what they got. The search goes
through a part's dimensions by falling variance of the codebook: all entries over the first ones, the most
promising entry to its end, the others on, masked out for good once their sum so far strictly exceeds the
best complete distance. Distances are integers, so results don't depend on how rows are dealt out.

The vectors are written once as integers. A round is one pass over them; each task adds up what it assigned
and sends one row a codebook entry and dimension, so the shuffle and the driver see codebooks, never vectors.

Dropped are null vectors and those with null, infinite or undefined components. Components of a magnitude
beyond 2**39 count as that; errors beyond a long count as the greatest long. All vectors have the dimension
of the one with the smallest vec_id; others are dropped as well. A dimension that the parts don't divide is a
ValueError. Null vec_ids are kept and start no codebook while others do; of equal vec_ids the smaller bytes
start first. Repeated rows count as often as they occur. Fewer vectors than entries give fewer entries; an
empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Dimensions that all entries are compared over before the first one is completed, and at a time thereafter.
FIRST, STEP = 3, 2
LONGEST = (1 << 63) - 1
#: Rows of the label sums that may be broadcast.
BROADCAST_ROWS = 200_000


def integers(df: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label and v, the components as little-endian integers of w bytes each; rows without a sound vector dropped."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            part = part.filter(pc.is_valid(part.column(2)))
            lists = part.column(2)
            flat = lists.flatten()
            x = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            sound = (bad[ends] == bad[starts]) if len(ends) else np.zeros(0, bool)
            with np.errstate(over="ignore", invalid="ignore"):
                v = np.clip(np.floor(scale * x), -float(1 << 51), float(1 << 51))
            whole = np.where(np.isfinite(v), v, 0).astype(np.int64)
            out, widths = [], []
            for a, b in zip(starts[sound], ends[sound], strict=True):
                own = whole[a:b]
                narrow = b == a or (own.min() >= -(1 << 31) and own.max() < 1 << 31)
                out.append(own.astype("<i4" if narrow else "<i8").tobytes())
                widths.append(4 if narrow else 8)
            keep = pa.array(sound)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), pa.array(out, pa.binary()), pa.array(widths, pa.int32())], names=["vec_id", "label", "v", "w"])

    label = "string" if "label" not in df.columns else df.schema["label"].dataType.simpleString()
    held = df.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if "label" in df.columns else F.lit(None).cast("string")).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    return held.mapInArrow(batches, f"vec_id long, label {label}, v binary, w int")


def _unpack(v: pa.Array, w: pa.Array) -> np.ndarray:
    """The vectors of a batch as rows of longs."""
    widths = w.to_numpy(zero_copy_only=False)
    rows = v.to_pylist()
    if len(rows) and (widths == 4).all():
        return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), len(rows[0]) // 4).astype(np.int64)
    return np.array([np.frombuffer(r, f"<i{k}").astype(np.int64) for r, k in zip(rows, widths, strict=True)], np.int64).reshape(len(rows), len(rows[0]) // int(widths[0]) if len(rows) else 0)


def _fits(x: np.ndarray, book: np.ndarray) -> bool:
    """Whether squared distances between rows and entries fit a long."""
    most = max(int(abs(a).max()) if a.size else 0 for a in (x, book))
    return (2 * most) ** 2 * max(1, book.shape[1]) <= LONGEST


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (of equally near ones the first) and its squared distance, for each row of x."""
    if not _fits(x, book):
        x, book = x.astype(object), book.astype(object)
    n, width = x.shape
    if not n or not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    spread = len(book) * (book * book).sum(0) - book.sum(0) ** 2 if book.dtype == object else book.astype(float).var(0)
    order = np.argsort(-spread.astype(float), kind="stable")
    x, book = x[:, order], book[:, order]
    some = x[:, None, :FIRST] - book[None, :, :FIRST]
    sums = (some * some).sum(2)
    first = sums.argmin(1) if sums.dtype != object else np.array([min(range(len(book)), key=r.__getitem__) for r in sums])
    rest = x[:, FIRST:] - book[first, FIRST:]
    best = sums[np.arange(n), first] + (rest * rest).sum(1)
    alive = (sums <= best[:, None]).astype(bool)
    alive[np.arange(n), first] = False
    row, entry = np.nonzero(alive)
    far = sums[row, entry]
    for k in range(FIRST, width, STEP):
        more = x[row, k : k + STEP] - book[entry, k : k + STEP]
        far = far + (more * more).sum(1)
        stay = (far <= best[row]).astype(bool)
        row, entry, far = row[stay], entry[stay], far[stay]
    # Of the complete distances the least, then the first entry.
    by = np.lexsort((entry, far, row))
    row, entry, far = row[by], entry[by], far[by]
    lead = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    row, entry, far = row[lead], entry[lead], far[lead]
    better = ((far < best[row]) | ((far == best[row]) & (entry < first[row]))).astype(bool)
    first[row[better]], best[row[better]] = entry[better], far[better]
    return first, best


def assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a column a part) and the squared distances over all parts."""
    width = books[0].shape[1]
    found = [nearest(x[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)]
    sums = sum(d.astype(object) for _, d in found) if any(d.dtype == object or (d.size and int(d.max()) > LONGEST // len(books)) for _, d in found) else sum(d for _, d in found)
    return np.stack([c for c, _ in found], 1), sums


def _totals(table: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> how many parts were assigned to it and their sums by dimension."""
    width = books[0].shape[1]

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for part in parts:
            x = _unpack(part.column(0), part.column(1))
            codes, _ = assign(x, books)
            small = _fits(x, x[:1]) and len(x) < 1 << 20
            for p, book in enumerate(books):
                own, code = x[:, p * width : (p + 1) * width], codes[:, p]
                counts[p] += np.bincount(code, minlength=len(book))
                for e in np.unique(code):
                    got = own[code == e]
                    sums[p][e] += got.sum(0).astype(object) if small else got.astype(object).sum(0)
        rows = [(p, e, d, int(counts[p][e]), int(sums[p][e][d])) for p, b in enumerate(books) for e in range(len(b)) if counts[p][e] for d in range(width)]
        if rows:
            columns = list(zip(*rows, strict=True))
            from decimal import Decimal

            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.int64()), pa.array([Decimal(s) for s in columns[4]], pa.decimal128(38, 0))], names=["p", "e", "d", "n", "s"])

    got = table.select("v", "w").mapInArrow(add, "p int, e int, d int, n long, s decimal(38,0)").groupBy("p", "e", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in got:  # parts x entries x dimensions of a part
        out.setdefault((r.p, r.e), (r.n, [0] * width))[1][r.d] = int(r.s)
    return out


def train(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks (a matrix of entries a part) after all rounds; none for an empty table."""
    seeds = table.orderBy(F.asc_nulls_last("vec_id"), "w", "v").limit(entries).collect()
    if not seeds:
        return []
    dims = len(seeds[0].v) // seeds[0].w
    if dims % parts:
        raise ValueError(f"{parts} parts don't divide {dims} dimensions")
    start = _unpack(pa.array([bytes(r.v) for r in seeds], pa.binary()), pa.array([r.w for r in seeds], pa.int32()))
    width = dims // parts
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        for (p, e), (n, sums) in _totals(table, books).items():
            books[p][e] = [s // n for s in sums]
    return books


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for b in books for c in b.ravel()).encode()).hexdigest()


def vector_codes(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each sound row of df (vec_id, embedding, label)."""
    table = common.cut(integers(df, scale=scale), "vectors")
    label = table.schema["label"].dataType.simpleString()
    first = table.orderBy(F.asc_nulls_last("vec_id"), "w", "v").select((F.length("v") / F.col("w")).cast("int").alias("d")).first()
    if first is None:
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    table = table.where(F.length("v") == first.d * F.col("w"))
    books = train(table, parts, entries, rounds)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            codes, errors = assign(_unpack(part.column(2), part.column(3)), books)
            text = [r.tobytes().hex() for r in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([min(int(e), LONGEST) for e in errors], pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = common.cut(table.mapInArrow(code, f"vec_id long, label {label}, code string, error long"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    if sums.count() <= BROADCAST_ROWS:  # a label and a long each; beyond that both sides are shuffled
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
