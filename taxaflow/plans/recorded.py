"""A chain of projections written down once and laid over any number of tables.

Building the expressions of a long chain costs more than Spark's analysis of it, so what doesn't depend on the
table is kept for the life of the Spark application."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame

#: Columns are dropped at every so many projections; each drop is a projection that Spark analyses on its own.
DROP_EVERY = 8


class Steps:
    """Takes the calls that a table takes, withColumn, withColumns and drop, and makes them later."""

    def __init__(self) -> None:
        self.steps: list[dict[str, Column]] = []
        self.gone: list[list[str]] = []

    def withColumns(self, new: dict[str, Column]) -> Steps:  # noqa: N802
        self.steps.append(dict(new))
        self.gone.append([])
        return self

    def withColumn(self, name: str, value: Column) -> Steps:  # noqa: N802
        return self.withColumns({name: value})

    def drop(self, *names: str) -> Steps:
        self.gone[-1] += names
        return self

    def over(self, df: DataFrame) -> DataFrame:
        """df with the columns of all steps; a column that is made anew after it was dropped stays."""
        waiting: set[str] = set()
        for k, (new, gone) in enumerate(zip(self.steps, self.gone, strict=True)):
            df = df.withColumns(new)
            waiting = (waiting - set(new)) | set(gone)
            if waiting and (k % DROP_EVERY == DROP_EVERY - 1 or k == len(self.steps) - 1):
                df = df.drop(*waiting)
                waiting = set()
        return df


def recorded(write: Callable[..., Steps]) -> Callable[..., Steps]:
    """write, whose steps are kept by its arguments for each Spark application."""

    @lru_cache(maxsize=16)
    def kept(application: str, *args: object) -> Steps:
        return write(*args)

    return lambda *args: kept(SparkContext._active_spark_context.applicationId, *args)
