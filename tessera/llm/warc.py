"""Deterministic sharded WARC writer and reader.

Records are put in order by page id, the order is cut into ranges of about ``range_bytes``
of payload, and each range's task compresses its records one by one, straight into files
that it closes by their compressed size. Ranges are cut by running sums over the whole
order, so which records a file holds depends on the records alone, not on partitions or
tasks. A task writes a file under a temporary name and renames it; the manifest, written
last by Spark's own committer, names the files that count. A task that is run again writes
the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes
from tessera.session import stored

#: Payload bytes of a range, which one task writes, and compressed bytes after which a file is closed.
#: A large cluster writes larger ones: one place for each range is held by the driver and every worker.
RANGE_BYTES, ROLL_BYTES = 64 << 20, 16 << 20
#: What a record weighs in a range besides its payload, and rows packed in one step.
RECORD_BYTES, STEP_ROWS = 512, 500
#: Records of equal payloads of so many bytes are written once; the others refer to it.
REVISIT_BYTES = 0
LEVEL = 6
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {payload_digest} {url}')}>"


def packed(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own; the same bytes whenever it is made."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    maker = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return maker.compress(f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + maker.flush()


def _target(page_id: int | None, url: str | None) -> str:
    return quote(url or f"urn:page:{page_id}", safe="!#$%&'()*+,/:;=?@[]~-._")


def page_record(
    page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, own: str, date: str, refers_to: int | None = None, first_url: str | None = None
) -> bytes:
    """A response, or with refers_to a revisit, which holds the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, url or "", own)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _target(page_id, url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{own}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to, first_url or "", own)),
            ("WARC-Refers-To-Target-URI", _target(refers_to, first_url)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    return packed(headers, block)


#: A place in the order: whether there is an id, the id, hashes of payload and url.
_PLACE = "S25"


def _payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, place. Places sort as bytes, rows without an id first."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")
    )
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    number = F.coalesce(F.col("page_id"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))
    known = F.when(F.col("page_id").isNull(), "00").otherwise("01")
    return rows.withColumn("place", F.unhex(F.concat(known, digits(number), digits(F.xxhash64("payload")), digits(F.xxhash64("url")))))


def _keys(pages: DataFrame) -> DataFrame:
    """page_id, url, place, n_bytes, key: payloads are equal when both their SHA-1 and SHA-256 are."""
    key = F.unhex(F.concat(F.sha1("payload"), F.sha2("payload", 256)))
    return _payloads(pages).select("page_id", "url", "place", F.octet_length("payload").alias("n_bytes"), key.alias("key"))


def revisits(keys: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """place, sha, first_id, first_url: the rows whose payload a smaller id has too.

    Null html is empty. Rows that repeat the smallest id of a group are responses too; rows
    without an id never refer. Only ids, urls and digests move.
    """
    rows = keys.where(F.col("page_id").isNotNull() & (F.col("n_bytes") >= least_bytes))
    groups = rows.groupBy("key").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last")).where("first.page_id < last")
    found = rows.join(groups, "key").where(F.col("page_id") > F.col("first.page_id"))
    return found.select("place", F.substring("key", 1, 20).alias("sha"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")).distinct()


def _bounds(keys: DataFrame, range_bytes: int) -> list[bytes]:
    """The first place of each range, by running sums of payload bytes over the whole order."""
    n = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    weight = (F.col("n_bytes") + RECORD_BYTES).cast("long").alias("weight")
    dealt = stored(keys.select("place", weight).repartitionByRange(n, "place").withColumn("part", F.spark_partition_id()), "warc-order")
    sizes = dealt.groupBy("part").agg(F.sum("weight").alias("bytes"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each of n parts
    starts = sizes.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("start"))
    before = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranges = dealt.join(F.broadcast(starts), "part").withColumn("range", F.floor(at / range_bytes))  # n rows
    return [bytes(r["first"]) for r in ranges.groupBy("range").agg(F.min("place").alias("first")).orderBy("range").collect()]


def _range_of(bounds: list[bytes]):
    """The range of a place: the last that begins at it or before. Equal places share one."""
    firsts = np.array(bounds, _PLACE)

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(firsts, np.frombuffer(b"".join(place), _PLACE), side="right") - 1)

    return range_of


def publish(fs: pafs.FileSystem, made: str, name: str, sha256: str) -> None:
    """Gives a finished file its name, also where an earlier attempt of the task did so, or another table was written there."""
    if fs.get_file_info(name).type != pafs.FileType.NotFound:
        known = hashlib.sha256()
        with fs.open_input_stream(name, compression=None) as stream:
            while chunk := stream.read(1 << 20):
                known.update(chunk)
        if known.hexdigest() == sha256:
            fs.delete_file(made)
            return
        fs.delete_file(name)
    fs.move(made, name)


class _Archive:
    """One range's files: members go in, a manifest row comes out of each file that is closed."""

    def __init__(self, folder: str, number: int, date: str, roll_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.number, self.date, self.roll_bytes = number, date, roll_bytes
        self.files, self.out = 0, None
        self.rows: list[dict] = []

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.number:06d}-{self.files:04d}.warc.gz"
            self.made = f"{self.root}/.{self.name}.{TaskContext.get().taskAttemptId()}.tmp"
            self.out, self.sha, self.records, self.size = self.fs.open_output_stream(self.made, compression=None), hashlib.sha256(), 0, 0
            headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name, "")), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self._write(packed(headers, b"format: WARC File Format 1.1\r\n"))
        self._write(member)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            publish(self.fs, self.made, f"{self.root}/{self.name}", self.sha.hexdigest())
            self.rows.append({"file": self.name, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()})
            self.files, self.out = self.files + 1, None


_MANIFEST = "file string, records long, bytes long, sha256 string"


def write_archives(
    pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, least_bytes: int = REVISIT_BYTES, date: str = "2024-01-01T00:00:00Z", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Writes ``folder``/part-NNNNNN-NNNN.warc.gz and returns the manifest: file, records, bytes, sha256.

    Order is by page_id, hashes of payload and url, so equal tables give equal files. Payloads
    move once, and each record is compressed once, behind that shuffle, as a response or as a
    revisit. An empty table gives an empty manifest. Rows that repeat an id are told apart by
    payload and url; rows equal in all three share a range. ``folder`` has to be a URI that
    all executors reach.
    """
    spark = pages.sparkSession
    keys = stored(_keys(pages), "warc-keys")
    bounds = _bounds(keys, range_bytes)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    marks = revisits(keys, least_bytes).select("place", F.lit(0).alias("kind"), none("long", "page_id"), none("string", "url"), none("binary", "payload"), "sha", "first_id", "first_url")
    rows = _payloads(pages).select("place", F.lit(1).alias("kind"), "page_id", "url", "payload", none("binary", "sha"), none("long", "first_id"), none("string", "first_url"))
    dealt = (
        rows.union(marks)
        .withColumn("range", _range_of(bounds)("place"))
        .repartitionById(max(1, len(bounds)), "range")
        .sortWithinPartitions("place", "kind", "url")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive: _Archive | None = None
        at, marked = None, {}
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(lo, STEP_ROWS)
                names = ("place", "kind", "page_id", "url", "sha", "first_id", "first_url", "range")
                columns = [part.column(part.schema.get_field_index(c)).to_pylist() for c in names]
                for place, kind, page, url, sha, first, first_url, number, payload in zip(*columns, as_bytes(part.column(4)), strict=True):
                    if place != at:
                        at, marked = place, {}
                    if kind == 0:
                        marked[sha] = (first, first_url)
                        continue
                    if archive is None or archive.number != number:
                        if archive is not None:
                            archive.close()
                            yield from _listed(archive)
                        archive = _Archive(folder, number, date, roll_bytes)
                    own = hashlib.sha1(payload).digest()
                    archive.add(page_record(page, url, payload, len(payload), base64.b32encode(own).decode(), date, *marked.get(own, ())))
        if archive is not None:
            archive.close()
            yield from _listed(archive)

    dealt.mapInArrow(write, _MANIFEST).write.mode("overwrite").json(f"{folder}/manifest")
    return read_manifest(spark, folder)


def _listed(archive: _Archive) -> Iterator[pa.RecordBatch]:
    if archive.rows:
        yield pa.RecordBatch.from_pylist(archive.rows)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).json(f"{folder}/manifest")


def _members(stream) -> Iterator[bytes]:
    """Uncompressed gzip members of a stream, one at a time."""
    maker, rest, parts = zlib.decompressobj(31), b"", []
    while chunk := rest or stream.read(1 << 20):
        parts.append(maker.decompress(chunk))
        rest = maker.unused_data
        if maker.eof:
            yield b"".join(parts)
            maker, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the last record is cut off")


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Response and revisit records of the files that the manifest names, with digests checked.

    page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest,
    refers_to. A file that is cut off, or a block or payload that doesn't match its digest,
    fails the read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in _members(stream):
                        headers, block = parsed(record)
                        kind = headers["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        own = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}" or kind == "response" and own != digest(payload):
                            raise ValueError(f"{name}: {headers['WARC-Record-ID']} doesn't match its digest")
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        page, ref = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), headers["WARC-Target-URI"], kind, payload if kind == "response" else None, n, own, ref and int(ref)))
                        held += len(block)
                        if held > 4 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows)

    files = read_manifest(spark, folder).select("file")
    files = files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    return files.mapInArrow(
        read, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
