"""WARC archives with a two-level capture index.

Records are gzip members of archive files in a shared folder. The index sorts reversed-host URL keys into
compressed blocks; a sparse directory holds the first key and the place of each block, one directory file
for each range of keys, and a small table holds the first key of each range. A lookup bisects the table,
the directory and the block, then reads one record by its byte range; nothing is broadcast or collected.

Of records with equal payloads (of at least min_bytes bytes) that with the largest page_id is a response;
the others are revisits that refer to it. Null html is an empty payload, a null URL an empty target, a
null page_id orders below all others. Repeated rows are captures of their own; those that repeat the
page_id of a response are responses too. Extra columns are ignored; an empty table gives an empty archive.
A task that runs again writes files under new names; the index knows those of the successful one only.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK_ENTRIES = 512
RANGE_ENTRIES = 200_000
ARCHIVE_BYTES = 1 << 30
CAPTURE_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None, page_id: int | None) -> str:
    """The sort key: host labels reversed, then path and query, then the page.

    >>> surt("https://www.Example.org:8080/a?b=c", 7)
    'org,example,www:8080)/a?b=c 00000000000000000007'
    """
    own = url or ""
    try:
        parts = urlsplit(own)
        host = (parts.hostname or "").split(".")
        port = f":{parts.port}" if parts.port else ""
        rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        key = f"{','.join(reversed(host))}{port}){rest}" if parts.hostname else own
    except ValueError:
        key = own
    # Signed ids keep their order when shifted; the key has neither spaces nor line ends.
    tail = "-" if page_id is None else f"{page_id:020d}"
    return f"{quote(key, safe='/:?#[]@!$&()*+,;=%~-._')} {tail}"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = CAPTURE_DATE) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, which tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=''.join(map(chr, range(33, 127))))}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n", 5, mtime=0)


def parse(member: bytes) -> dict:
    """A record's fields; payload is None for revisits."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")))
    number = lambda urn: None if urn == "<urn:page:None>" else int(urn[len("<urn:page:") : -1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html with refers_to: the page whose response a revisit repeats, null for responses."""
    payload = F.encode(common.text_of("html"), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("__sha", F.sha1(payload))
    sized = rows.where(F.octet_length(common.text_of("html")) >= min_bytes).select("page_id", "__sha")
    again = sized.groupBy("__sha").agg(F.max("page_id").alias("__last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("__sha", "__last")
    # Written, so that the join has exchanges of its own, whose hot partitions Spark can split.
    joined = rows.join(common.cut(again, "payloads"), "__sha", "left")
    refers = F.when(F.col("__last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__last")), F.col("__last"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archive(pages: DataFrame, root: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, block_entries: int = BLOCK_ENTRIES, range_entries: int = RANGE_ENTRIES) -> str:
    """Write pages (page_id, url, html) as archives and index below root; returns root."""
    spark = pages.sparkSession

    def store(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)
        fs.create_dir(f"{base}/archive", recursive=True)
        out, name, at = None, "", 0
        for part in parts:
            keys, files, offsets, lengths = [], [], [], []
            for page, url, html, refers in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if out is None or at > archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/archive/{name}", compression=None)
                member = record(page, url, (html or "").encode("utf-8", "surrogatepass"), refers, refers is not None)
                out.write(member)
                keys.append(surt(url, page))
                files.append(name)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    captures = common.cut(mark_revisits(pages, min_bytes).mapInArrow(store, "key string, file string, offset long, length long"), "captures")
    ranges = max(1, -(-captures.count() // range_entries))

    def index(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)
        fs.create_dir(f"{base}/index", recursive=True)
        name = uuid.uuid4().hex
        entries: list[tuple] = []
        directory: list[tuple] = []
        at = 0

        def flush(out: pa.NativeFile) -> None:
            nonlocal at
            block = zlib.compress("\n".join(map(json.dumps, entries)).encode())
            out.write(block)
            directory.append((entries[0][0], at, len(block)))
            at += len(block)
            entries.clear()

        with fs.open_output_stream(f"{base}/index/{name}.blocks", compression=None) as out:
            for part in parts:
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    entries.append(row)
                    if len(entries) == block_entries:
                        flush(out)
            if entries:
                flush(out)
        with fs.open_output_stream(f"{base}/index/{name}.directory", compression=None) as out:
            out.write("\n".join(map(json.dumps, directory)).encode())
        if directory:
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], names=["first_key", "name"])

    ordered = captures.repartitionByRange(ranges, "key").sortWithinPartitions("key")
    ordered.mapInArrow(index, "first_key string, name string").write.parquet(f"{root}/ranges")
    return root


class Reader:
    """Lookups in one archive, with the files of late use held open."""

    def __init__(self, root: str, held: int = 32) -> None:
        self.fs, self.base = filesystem(root)
        rows = ds.dataset(f"{self.base}/ranges", filesystem=self.fs, format="parquet").to_table().to_pylist()
        self.ranges = sorted((r["first_key"], r["name"]) for r in rows)
        self.firsts = [k for k, _ in self.ranges]
        self.held = held
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.directory: tuple[str, list] = ("", [])
        self.block: tuple[tuple, list] = ((), [])

    def bytes_at(self, path: str, offset: int, length: int) -> bytes:
        found = self.files.pop(path, None) or self.fs.open_input_file(f"{self.base}/{path}")
        self.files[path] = found
        if len(self.files) > self.held:
            self.files.popitem(last=False)[1].close()
        return found.read_at(length, offset)

    def blocks(self, name: str) -> list:
        if self.directory[0] != name:
            with self.fs.open_input_stream(f"{self.base}/index/{name}.directory", compression=None) as f:
                self.directory = name, [json.loads(x) for x in f.read().decode().split("\n") if x]
        return self.directory[1]

    def entries(self, name: str, k: int) -> list:
        if self.block[0] != (name, k):
            _, offset, length = self.blocks(name)[k]
            self.block = (name, k), [json.loads(x) for x in zlib.decompress(self.bytes_at(f"index/{name}.blocks", offset, length)).decode().split("\n")]
        return self.block[1]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of each capture of key."""
        at = bisect.bisect_right(self.firsts, key) - 1  # equal keys share a range
        if at < 0:
            return
        name = self.ranges[at][1]
        blocks = self.blocks(name)
        k = max(0, bisect.bisect_left(blocks, key, key=lambda b: b[0]) - 1)
        while k < len(blocks) and blocks[k][0] <= key:
            own = self.entries(name, k)
            for row in own[bisect.bisect_left(own, key, key=lambda e: e[0]) :]:
                if row[0] != key:
                    return
                yield row[1], row[2], row[3]
            k += 1

    def read(self, key: str) -> Iterator[dict]:
        for file, offset, length in list(self.find(key)):
            yield parse(self.bytes_at(f"archive/{file}", offset, length))


FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def keys_of(pages: DataFrame) -> DataFrame:
    """The distinct index keys of pages (page_id, url)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u, p) for p, u in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], pa.string())], names=["key"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(batches, "key string").distinct()


def read_captures(keys: DataFrame, root: str, payload: bool = False) -> DataFrame:
    """The records of each key (column key) in the archive below root, through its index.

    Keys are sorted first, so that neighbours share a directory and a block."""
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL(FIELDS + ", payload binary" * payload)
    names = schema.names
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for part in parts:
            for at in range(0, part.num_rows, 1000):
                reader = reader or Reader(root)
                found = [r for key in part.column(0).slice(at, 1000).to_pylist() for r in reader.read(key)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], k) for c, k in zip(names, kinds, strict=False)], names=names)

    spark: SparkSession = keys.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keys.select("key").repartitionByRange(width, "key").sortWithinPartitions("key").mapInArrow(batches, schema)
