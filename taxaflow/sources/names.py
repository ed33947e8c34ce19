"""Reading name lists and writing parse results."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from taxaflow.functions.text import trim_control

HEADER = "scientificName"


def name_of(line: Column) -> Column:
    """The name of a line: before the first tab, trimmed; null for blank, comment and header lines."""
    name = F.trim(F.substring_index(line, "\t", 1))
    skip = (trim_control(line) == "") | F.startswith(line, F.lit("#")) | (name == "") | (name == HEADER)
    return F.when(~skip, name)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """name for each line of the text files at path that holds one. Lines have no numbers: files are split
    and read side by side; use the "names" data source where numbers are needed."""
    return spark.read.text(path).select(name_of(F.col("value")).alias("name")).where("name IS NOT NULL")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """name, authorship, rank, code of a tab-separated file with a header that names them (case aside)."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    held = {c.lower(): c for c in raw.columns}
    wanted = {"name": ("name", "scientificname"), "authorship": ("authorship", "scientificnameauthorship"), "rank": ("rank", "taxonrank"), "code": ("code", "nomenclaturalcode")}
    pick = lambda keys: next((F.col(f"`{held[k]}`") for k in keys if k in held), F.lit(None).cast("string"))
    return raw.select(*(pick(keys).alias(c) for c, keys in wanted.items())).where("name IS NOT NULL")


class NamesDataSource(DataSource):
    """Lines of text files with their numbers: spark.read.format("names").load(path).

    Each file is one partition, since a line's number depends on all lines before it. Use it for lists that
    people number; large corpora are better read without numbers."""

    @classmethod
    def name(cls) -> str:
        return "names"

    def schema(self) -> str:
        return "file string, line long, name string"

    def reader(self, schema: object) -> DataSourceReader:
        return NamesReader(self.options["path"])


class NamesReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        if store.get_file_info(base).type == fs.FileType.Directory:
            files = sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.File)
        else:
            files = [base]
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [InputPartition(scheme + f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        path = partition.value
        store, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with store.open_input_stream(base) as stream:
            rest, number = b"", 0
            while chunk := stream.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                for raw in lines:
                    number += 1
                    if (name := self.name_in(raw)) is not None:
                        yield path, number, name
            if rest and (name := self.name_in(rest)) is not None:
                yield path, number + 1, name

    @staticmethod
    def name_in(raw: bytes) -> str | None:
        line = raw.decode("utf-8", "replace").rstrip("\r")
        if not line.strip() or line.startswith("#"):
            return None
        name = line.split("\t", 1)[0].strip()
        return name if name and name != HEADER else None


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamesDataSource)


def result_json(df: DataFrame, name: str = "name", line: str | None = None, canonical: str | None = None) -> Column:
    """The JSON envelope of a parse result; nulls are left out."""
    parts = ([F.col(line).alias("line")] if line else []) + [F.col(name).alias("input")] + ([F.col(canonical).alias("canonical")] if canonical else [])
    return F.to_json(F.struct(*parts, "parsed", "informal", F.col("error").alias("error")))


def write_results(df: DataFrame, path: str, fmt: str = "json", name: str = "name") -> None:
    """Write parse results as 'json' lines, 'parquet', or flat 'csv' or 'tsv'."""
    from taxaflow.operators.flat import flat_view

    if fmt == "json":
        df.select(result_json(df, name).alias("value")).write.text(path)
    elif fmt == "parquet":
        df.write.parquet(path)
    elif fmt in ("csv", "tsv"):
        flat_view(df, name).write.option("sep", "," if fmt == "csv" else "\t").option("header", True).csv(path)
    else:
        raise ValueError(f"no such format: {fmt}")
