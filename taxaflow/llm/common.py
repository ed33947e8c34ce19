"""What the corpus operators share: tables, shared folders and stage boundaries."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    It is the session's spark.checkpoint.dir. Only where that is unset (local tests, one machine) a
    temporary folder is made and set as the checkpoint folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
        return root.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster sees")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='taxaflow-')}")
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared root."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut", compression: str = "snappy") -> DataFrame:
    """Cut the lineage with a table in the shared folder and read it back.

    A written table survives the loss of any executor, is compressed, and tells the planner its size.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared root once no later step reads it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once everything made from them is itself written."""
    for df in tables:
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of results that nothing refers to any more; it does so when the
    driver collects its garbage, which a driver with little to do puts off for long."""
    for _ in range(2):  # what Python lets go of first, then what that held in the JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)  # the cleaner works beside


def fresh_name(df: DataFrame, base: str) -> str:
    """base, or base with underscores before it if df has such a column (in any case) already."""
    held = {c.lower() for c in df.columns}
    while base.lower() in held:
        base = f"_{base}"
    return base
