"""Parsing streams. A parse depends on one row, so the batch transform runs on a stream as it is; what keeps
state (counts by time, dropping repeats) has a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.operators.parse import parse_names


def parse_stream(names: DataFrame, name: str = "name", **hints: str) -> DataFrame:
    """parse_names for a streaming DataFrame; append mode, no state."""
    return parse_names(names, name, **hints)


def drop_repeats(names: DataFrame, time: str, delay: str = "10 minutes", name: str = "name") -> DataFrame:
    """Names whose repeats within the delay are dropped before they are parsed."""
    return names.withWatermark(time, delay).dropDuplicatesWithinWatermark([name])


def counts_by_window(parsed: DataFrame, time: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Results by kind for windows of event time; late rows count until the watermark passes their window."""
    return parsed.withWatermark(time, delay).groupBy(F.window(time, window), "result").agg(F.count(F.lit(1)).alias("n"))
