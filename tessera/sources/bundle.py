"""Bundles of externally made chunks and vectors: a folder with a manifest, chunks, a vector index and raw vectors.

``chunks.ndjson`` and ``vectors.ndjson`` hold JSON lines, ``vectors.f32`` raw little-endian
float32 values one vector behind the other, ``manifest.json`` one JSON object; each may be one
file or a folder of files, which count in the order of their names. Raw files are read by
ranges of bytes and hashed in small steps, so a file may be of any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.snapshot import checked_files
from tessera.session import stored

CHUNKS, INDEX, PAYLOAD, MANIFEST = "chunks.ndjson", "vectors.ndjson", "vectors.f32", "manifest.json"
#: Bytes of raw vectors that one row of a read plan stands for, and that a worker holds at once.
RANGE_BYTES = 32 << 20
_CHUNK = "external_id string, collection string, path string, document string, title string, text string, start int, end int, sequence int, total_chunks int, modified_at timestamp, vector_id long"
_SUMS = "name string, sha256 string, bytes long"


@dataclass
class Bundle:
    chunks: DataFrame
    vectors: DataFrame  # vector_id, document, sequence, fingerprint, offset, length, text_sha, vector
    dims: int


def write(chunks: DataFrame, vectors: DataFrame, path: str, model: str) -> None:
    """Writes a bundle; vectors: vector_id, vector. Offsets follow the order of ids, by ranges."""
    spark = chunks.sparkSession
    index = chunks.select("vector_id", "document", "sequence", F.sha2("text", 256).alias("text_sha"))
    parts = stored(vectors.repartitionByRange("vector_id").select("vector_id", "vector", F.spark_partition_id().alias("part")), "bundle-vectors")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("vector_id")) - 1 + F.col("start")
    dims = (vectors.select(F.size("vector")).first() or [0])[0]
    placed = parts.join(F.broadcast(starts), "part").select("vector_id", "vector", "part", (place * 4 * dims).cast("long").alias("offset"))
    placed.join(index, "vector_id", "left").select(
        "vector_id", "document", "sequence", "text_sha", F.lit(model).alias("fingerprint"), "offset", F.lit(4 * dims).alias("length")
    ).write.json(f"{path}/{INDEX}")
    chunks.write.json(f"{path}/{CHUNKS}")

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One file for each part, under a temporary name until it is whole."""
        out = name = None
        for batch in batches:
            for part, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    fs, root = pafs.FileSystem.from_uri(f"{path}/{PAYLOAD}")
                    fs.create_dir(root, recursive=True)
                    name = f"{root}/part-{part:06d}"
                    made = f"{root}/.part-{part:06d}.{TaskContext.get().taskAttemptId()}"
                    out = fs.open_output_stream(made, compression=None)
                out.write(np.asarray(vector, "<f4").tobytes())
        if out is not None:
            out.close()
            if fs.get_file_info(name).type != pafs.FileType.NotFound:
                fs.delete_file(name)  # an attempt before wrote the same
            fs.move(made, name)
            yield pa.RecordBatch.from_pydict({"name": [name]})

    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    dealt = placed.select(F.col("part").cast("int").alias("part"), "vector", "offset").repartitionById(n, "part").sortWithinPartitions("offset")
    total = dealt.select("part", "vector").mapInArrow(raw, "name string").count(), parts.count()
    facts = spark.range(1).select(F.lit(dims).alias("dimensions"), F.lit(model).alias("model"), F.lit(total[1]).alias("vector_count"))
    facts.write.json(f"{path}/{MANIFEST}")
    file_sums(spark, path).write.json(f"{path}/checksums.json")


def _files(path: str, what: str) -> list[tuple[str, int]]:
    """(path below the bundle, bytes) of each file, in the order of names: a listing, not a read."""
    fs, root = pafs.FileSystem.from_uri(f"{path}/{what}")
    top = fs.get_file_info(root)
    if top.type == pafs.FileType.NotFound:
        return []
    infos = [top] if top.is_file else fs.get_file_info(pafs.FileSelector(root))
    kept = [i for i in infos if i.is_file and not i.base_name.startswith(("_", "."))]
    return sorted((i.path[len(root) - len(what) :], i.size) for i in kept)


def file_sums(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256, bytes of each file of the bundle, hashed in small steps, a task for a few files."""
    names = [(name,) for what in (CHUNKS, INDEX, PAYLOAD, MANIFEST) for name, _ in _files(path, what)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                sha, size = hashlib.sha256(), 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    while data := stream.read(1 << 20):
                        sha.update(data)
                        size += len(data)
                yield pa.RecordBatch.from_pydict({"name": [name], "sha256": [sha.hexdigest()], "bytes": [size]})

    return spark.createDataFrame(names, "name string").repartition(max(1, len(names))).mapInArrow(sums, _SUMS)


def file_problems(spark: SparkSession, path: str) -> DataFrame:
    """name, problem of each file that the bundle's checksums declare: missing, bytes, sha256, or none."""
    return checked_files(file_sums(spark, path), spark.read.schema(_SUMS).json(f"{path}/checksums.json"))


def raw_vectors(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """offset, vector of the raw float32 records, by ranges of bytes, which tasks share out."""
    step = max(1, RANGE_BYTES // (4 * dims)) * 4 * dims
    plan, start = [], 0
    for name, size in _files(path, PAYLOAD):
        if size % (4 * dims):
            raise ValueError(f"{name} holds a broken vector")
        plan += [(name, at, min(step, size - at), start + at) for at in range(0, size, step)]
        start += size

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['name']}") as file:
                    values = np.frombuffer(file.read_at(row["length"], row["at"]), "<f4")
                n = len(values) // dims
                ends = pa.array(np.arange(n + 1) * dims, pa.int32())
                places = pa.array(row["start"] + np.arange(n) * 4 * dims, pa.int64())
                yield pa.RecordBatch.from_arrays([places, pa.ListArray.from_arrays(ends, pa.array(values))], names=["offset", "vector"])

    ranges = spark.createDataFrame(plan, "name string, at long, length long, start long")
    return ranges.repartition(max(1, len(plan))).mapInArrow(read, "offset long, vector array<float>")


def read(spark: SparkSession, path: str) -> Bundle:
    dims = spark.read.schema("dimensions int, model string, vector_count long").json(f"{path}/{MANIFEST}").first()["dimensions"]
    index = spark.read.schema("vector_id long, document string, sequence int, text_sha string, fingerprint string, offset long, length int").json(f"{path}/{INDEX}")
    return Bundle(spark.read.schema(_CHUNK).json(f"{path}/{CHUNKS}"), index.join(raw_vectors(spark, path, dims), "offset", "left"), dims)
