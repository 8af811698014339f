"""Run outputs, trends, latest-only results, audit rows and artifacts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import files


def write_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Replaces the partition of one run and leaves the others as they are."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_latest(rows: DataFrame, path: str, version: str) -> None:
    """Makes rows the only version.

    They are written to a folder of their own; then the pointer, a small file, is written aside and renamed over
    the old one, so that a reader finds the old version or the new one at any time; then the versions that were complete
    before are removed. A writer that dies leaves the old version in place, and an unfinished folder that the next one removes.
    """
    spark = rows.sparkSession
    before = files.names(spark, f"{path}/versions")
    folder = f"{version}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/versions/{folder}")
    files.write_json(spark, f"{path}/latest.json", {"version": version, "folder": folder}, replace=True)
    for old in before:
        files.remove(spark, f"{path}/versions/{old}")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The version that the pointer names now."""
    return spark.read.parquet(f"{path}/versions/{latest_version(spark, path)['folder']}")


def latest_version(spark: SparkSession, path: str) -> dict:
    """The pointer: version and folder."""
    found = files.read_json(spark, f"{path}/latest.json")
    if found is None:
        raise FileNotFoundError(f"no version was written to {path}")
    return found


#: Rows of a report that one audit row takes; the evidence calls give 50 topics at most, with up to 50 records each.
AUDIT_ROWS = 2500


def audit(result: DataFrame, path: str, recipe: str, params: dict[str, str], most: int = AUDIT_ROWS) -> None:
    """Appends one row for an evidence call: its parameters and its result as JSON.

    The result is a report and becomes one value, so one of more than ``most`` rows is an error,
    told after reading no more than these, and nothing is appended. An empty one is ``[]``.
    """
    names = sorted(result.columns)
    told = F.raise_error(F.lit(f"an audited result has at most {most} rows"))
    rows = result.limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct(*names)).alias("held"))
    as_json = F.when(F.col("n") > most, told.cast("string")).otherwise(F.to_json(F.array_sort("held")))
    options = F.to_json(F.create_map(*(F.lit(x) for k in sorted(params) for x in (k, params[k])))) if params else F.lit("{}")
    rows.select(F.lit(recipe).alias("recipe"), options.alias("params"), as_json.alias("result")).write.mode("append").parquet(path)


def write_artifact(topics: DataFrame, data: DataFrame, header: DataFrame, path: str) -> None:
    """Three folders of JSON lines: topics, data (gzip), header, the last written last; nulls are written out."""
    for rows, name, packing in ((data, "data", "gzip"), (topics, "topics", "none"), (header, "header", "none")):
        rows.write.mode("overwrite").option("compression", packing).option("ignoreNullFields", "false").json(f"{path}/{name}")
