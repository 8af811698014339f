"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import files

#: Spark's setting for it.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


@contextmanager
def shuffles_removed(*sessions: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when the query ends, not when the driver happens to collect its garbage.

    For queries whose results are written or collected once: what is left of a shuffle is not there for a second run.
    """
    before = [(s, s.conf.get(REMOVE_SHUFFLES, None)) for s in sessions]
    for s in sessions:
        s.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        for s, value in reversed(before):
            s.conf.unset(REMOVE_SHUFFLES) if value is None else s.conf.set(REMOVE_SHUFFLES, value)


def share_code(spark: SparkSession) -> None:
    """Lets Python workers import this package from the folder it lies in, wherever Spark was started.

    On a cluster the package comes with --py-files, and a path that isn't there does no harm.
    """
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    On a local master an unset folder is made here; on a cluster it has to be
    configured, because no machine-local folder would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors. What was shuffled for it goes."""
    path = fresh_path(df.sparkSession, what)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(old: DataFrame, new: DataFrame, what: str) -> DataFrame:
    """stored(), for the next round of an iteration: once it is written, the folder of the round before, which nothing else reads, goes."""
    out = stored(new, what)
    for path in old.inputFiles()[:1]:
        folder = path.rsplit("/", 1)[0]
        if folder.rsplit("/", 1)[-1].startswith(f"{what}-"):
            files.remove(old.sparkSession, folder)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
