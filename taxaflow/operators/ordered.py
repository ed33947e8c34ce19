"""Operations that depend on the order of rows: gapless places, comparison by place, reservoirs, batches.

A place is the number of rows before a row in the order of an integer key. No global sort makes it: keys fall
into ranges of equal width, a range's rows are counted and numbered on their own, and the counts before it are
added. Equal keys go by the tie columns; a range holds at most so many keys, so no task gets an unbounded share
of distinct keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Keys of one range.
WIDTH = 1 << 16
#: Rows of one request to a judge.
BATCH = 25


def fresh(df: DataFrame, base: str) -> str:
    """base, with underscores before it where df has such a column."""
    while base.lower() in {c.lower() for c in df.columns}:
        base = f"_{base}"
    return base


def with_place(df: DataFrame, key: str, ties: list[str] | None = None, place: str = "place", width: int = WIDTH) -> DataFrame:
    """df with a gapless place (from 0) by the integer column key; null keys come first."""
    own, start, before = (fresh(df, c) for c in ("range", "start", "range_of"))
    ranged = df.withColumn(own, F.floor(F.col(key) / width))
    counts = ranged.groupBy(F.col(own).alias(before)).agg(F.count(F.lit(1)).alias("rows_of"))
    # A row for each range of keys, so small beside the rows themselves.
    starts = counts.select(before, F.coalesce(F.sum("rows_of").over(Window.orderBy(F.asc_nulls_first(before)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(start))
    order = Window.partitionBy(own).orderBy(F.asc_nulls_first(key), *(ties or []))
    number = F.row_number().over(order) - 1
    return ranged.withColumn(place, number).join(starts, F.col(own).eqNullSafe(F.col(before))).select(*df.columns, (F.col(start) + F.col(place)).cast("long").alias(place))


def compare_places(left: DataFrame, right: DataFrame, key: str, fields: list[str], ignore_whitespace: bool = False, ties: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """place, change and paths of each place at which two lists differ.

    change is 'left only' or 'right only' for the rows by which one list is longer, else 'fields'; paths are
    the fields that differ, without their white space if that is ignored."""
    value = lambda c: F.regexp_replace(F.col(c).cast("string"), r"(?U)\s+", "") if ignore_whitespace else F.col(c).cast("string")

    def placed(df: DataFrame, name: str) -> DataFrame:
        held = with_place(df.select(key, *(c for c in (ties or []) if c != key), *(value(f).alias(f"f_{f}") for f in fields)), key, ties, "at", width)
        return held.select("at", F.struct(*(F.col(f"f_{f}").alias(f) for f in fields)).alias(name))

    both = placed(left, "a").join(placed(right, "b"), "at", "full_outer")
    paths = F.array_compact(F.array(*(F.when(~F.col(f"a.`{f}`").eqNullSafe(F.col(f"b.`{f}`")), F.lit(f)) for f in fields)))
    change = F.when(F.col("b").isNull(), F.lit("left only")).when(F.col("a").isNull(), F.lit("right only")).when(F.size(paths) > 0, F.lit("fields"))
    none = F.array().cast("array<string>")
    return both.select(F.col("at").alias("place"), change.alias("change"), F.when(change == "fields", paths).otherwise(none).alias("paths")).where("change IS NOT NULL")


def compare_report(differences: DataFrame, max_diffs: int) -> tuple[DataFrame, DataFrame]:
    """The first max_diffs rows that differ in fields, and the counts: rows that differ, rows that one list has more, each field."""
    shown = differences.where("change = 'fields'").orderBy("place").limit(max_diffs)
    fields = differences.where("change = 'fields'").select(F.explode("paths").alias("what"))
    return shown, differences.select(F.col("change").alias("what")).unionByName(fields).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


# ---- Fixed values: the 48-bit linear congruential generator of the sampling. ----
_MULTIPLIER, _ADDEND, _BITS = 0x5DEECE66D, 0xB, 48


def _jump(steps: np.ndarray, seed: int) -> np.ndarray:
    """The generator's state after so many steps from its start, for each number of steps at once.

    Steps compose: with (a, c) for 2**k steps, those for 2**(k+1) are (a * a, a * c + c)."""
    mask = np.uint64((1 << _BITS) - 1)
    state = np.full(len(steps), (seed ^ _MULTIPLIER) & int(mask), np.uint64)
    a, c, left = _MULTIPLIER, _ADDEND, steps.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        state[odd] = (state[odd] * np.uint64(a) + np.uint64(c)) & mask
        a, c = a * a & int(mask), (a * c + c) & int(mask)
        left >>= np.uint64(1)
    return state


def slots(places: np.ndarray, capacity: int, seed: int) -> np.ndarray:
    """The slot of a reservoir that the row of each place goes to when it comes, -1 for none."""
    later = places >= capacity
    drawn = _jump(np.where(later, 2 * (places - capacity) + 1, 0), seed)
    nxt = (drawn * np.uint64(_MULTIPLIER) + np.uint64(_ADDEND)) & np.uint64((1 << _BITS) - 1)
    whole = ((drawn >> np.uint64(22)).astype(np.int64) << 27) + (nxt >> np.uint64(21)).astype(np.int64)
    at = (whole * (1.0 / (1 << 53)) * (places + 1)).astype(np.int64)
    return np.where(later, np.where(at < capacity, at, -1), places)


def reservoir(df: DataFrame, capacity: int, key: str, seed: int = 42, ties: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """The rows that Algorithm R keeps of df in the order of key, with their slot and place.

    A row's draw depends on its place only, through a jump of the generator, so each task replays its part;
    of the rows that go to one slot the last one stays. capacity 0 keeps none."""
    if capacity <= 0:
        return df.limit(0).withColumns({"place": F.lit(0).cast("long"), "slot": F.lit(0).cast("long")})

    @pandas_udf("long")
    def slot(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(slots(part.to_numpy(np.int64), capacity, seed))

    drawn = with_place(df, key, ties, "place", width).withColumn("slot", slot("place")).where("slot >= 0")
    kept = drawn.groupBy("slot").agg(F.max("place").alias("last"))
    return drawn.join(kept.withColumnRenamed("slot", "of"), (F.col("slot") == F.col("of")) & (F.col("place") == F.col("last"))).drop("of", "last")


def review_sample(df: DataFrame, interesting: Column, budget: int, normal: int, key: str, seed: int = 42, ties: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """budget rows: normal ordinary ones and for the rest interesting ones, each kind by a reservoir of its own."""
    odd = F.coalesce(interesting, F.lit(False))
    return reservoir(df.where(odd), max(0, budget - normal), key, seed, ties, width).unionByName(reservoir(df.where(~odd), normal, key, seed + 1, ties, width)).drop("slot", "place")


def judge_batches(df: DataFrame, verdicts: DataFrame, on: str, key: str, size: int = BATCH, ties: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """The rows of df without a verdict, with batch and index (both from 0) by their order."""
    waiting = with_place(df.join(verdicts.select(on), on, "left_anti").select(*df.columns), key, ties, "place", width)
    return waiting.withColumns({"batch": F.floor(F.col("place") / size), "index": F.pmod("place", F.lit(size)).cast("long")}).drop("place")


#: Pieces of a reply: strings, braces, the closing bracket, what lies between.
_PIECE = r'(?s)("(?:[^"\\]|\\.)*+(?:"|\z)|[{}\]]|[^"{}\]]+)'
VERDICT = "index long, verdict string, confidence string, note string"


def verdict_objects(reply: Column) -> Column:
    """The whole objects of the array after "verdicts" in a reply, as texts; null if there is no such array.

    Braces are counted outside strings. The scan ends where the array does, or with the last whole object of
    a reply that breaks off. What a model thought aloud is left out before."""
    spoken = F.regexp_replace(reply, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", " ")
    array = F.regexp_extract(spoken, r'(?s)^.*?"verdicts"[^\[]*\[(.*)\z', 1)
    begin = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"), F.array().cast("array<string>").alias("found"), F.lit(False).alias("done"))

    def step(st: Column, piece: Column) -> Column:
        depth = st["depth"] + F.when(piece == "{", 1).when((piece == "}") & (st["depth"] > 0), -1).otherwise(0)
        inside = F.when((st["depth"] > 0) | (piece == "{"), F.concat(st["text"], piece)).otherwise(F.lit(""))
        whole = (depth == 0) & (st["depth"] > 0)
        after = F.struct(
            depth.alias("depth"), F.when(whole, F.lit("")).otherwise(inside).alias("text"), F.when(whole, F.concat(st["found"], F.array(inside))).otherwise(st["found"]).alias("found"),
            ((piece == "]") & (st["depth"] == 0)).alias("done"),
        )
        return F.when(st["done"], st).otherwise(after)

    return F.when(F.regexp_like(spoken, F.lit(r'(?s)"verdicts"[^\[]*\[')), F.aggregate(F.regexp_extract_all(array, F.lit(_PIECE), 1), begin, step, lambda st: st["found"]))


def read_verdicts(df: DataFrame, reply: str = "reply") -> DataFrame:
    """df's other columns and a row for each sound verdict of its reply; objects without index, verdict or
    confidence, and objects that are no JSON, are skipped."""
    rest = [c for c in df.columns if c != reply]
    texts = df.select(*rest, F.explode(verdict_objects(F.col(reply))).alias("object"))
    read = texts.select(*rest, F.from_json("object", VERDICT + ", broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("v"))
    return read.where("v.broken IS NULL AND v.index >= 0 AND v.verdict IS NOT NULL AND v.confidence IS NOT NULL").select(*rest, "v.index", "v.verdict", "v.confidence", "v.note")
