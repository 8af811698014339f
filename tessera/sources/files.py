"""Small files and folders on any file system that Spark can reach, from the driver."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


def _context(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm, at, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf)


def exists(spark: SparkSession, path: str) -> bool:
    _, at, files = _context(spark, path)
    return files.util().exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    _, at, files = _context(spark, path)
    if not files.util().exists(at):
        return []
    return sorted(s.getPath().getName() for s in files.util().listStatus(at))


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the files that lie in a folder; 0 where there is no folder."""
    _, at, files = _context(spark, path)
    if not files.util().exists(at):
        return 0
    return sum(s.getLen() for s in files.util().listStatus(at) if s.isFile())


def name_blocks(spark: SparkSession, path: str, size: int = 10_000) -> Iterator[list[str]]:
    """Names in a folder, so many at a time, listed as they are asked for; none where there is no folder."""
    _, at, files = _context(spark, path)
    if not files.util().exists(at):
        return
    block, left = [], files.listStatus(at)
    while left.hasNext():
        block.append(left.next().getPath().getName())
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or a folder with all that is in it, if it is there."""
    _, at, files = _context(spark, path)
    if files.util().exists(at):
        files.delete(at, True)


def write_json(spark: SparkSession, path: str, value: dict, replace: bool) -> bool:
    """Writes the value aside and renames it to its place in one step.

    With replace readers see the old file or the new one; without it the file stays if it is there, and False comes back.
    """
    jvm, at, files = _context(spark, path)
    fs = jvm.org.apache.hadoop.fs
    aside = fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    how = jvm.java.util.EnumSet.of(fs.CreateFlag.CREATE)
    with_parents = spark.sparkContext._gateway.new_array(fs.Options.CreateOpts, 1)
    with_parents[0] = fs.Options.CreateOpts.createParent()
    out = files.create(aside, how, with_parents)
    out.write(json.dumps(value).encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE if replace else fs.Options.Rename.NONE
    if not replace and files.util().exists(at):
        files.delete(aside, False)
        return False
    try:
        files.rename(aside, at, options)
    except Exception:
        files.delete(aside, False)
        if replace or not files.util().exists(at):
            raise
        return False  # another writer was first
    return True


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The file's value, or None where there is none."""
    if not exists(spark, path):
        return None
    return json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
