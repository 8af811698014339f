"""The run ledger as tables: appends, resolution, lineage and removal."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import stored
from tessera.sources import files

#: The version of the trend mathematics that runs are made with now.
TREND_VERSION = 2
RUN = "id long, view_id long, type string, status string, params string, input_refs string, stats map<string,long>, phases map<string,double>, error string, created_at timestamp, completed_at timestamp"


class Recorder:
    """The ledger's row of a run while it runs: phases are timed, and rows counted as they are written anyway.

    ``with Recorder(...) as run:`` appends the row at the end, succeeded, or failed with the error, which goes on.
    """

    def __init__(self, spark: SparkSession, path: str, id: int, view_id: int, kind: str, params: dict | None = None, inputs: dict | None = None):
        self.spark, self.path = spark, path
        self.head = (id, view_id, kind)
        self.params, self.inputs = json.dumps(params or {}, sort_keys=True), json.dumps(inputs or {}, sort_keys=True)
        self.phases: dict[str, float] = {}
        self.watching: list[tuple[str, Observation]] = []

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        """Adds what the block takes to the phase's seconds."""
        began = time.monotonic()
        try:
            yield
        finally:
            self.phases[name] = self.phases.get(name, 0.0) + time.monotonic() - began

    def watched(self, rows: DataFrame, name: str, **counts: Column) -> DataFrame:
        """The rows, whose number and other aggregates are taken along by the next action on them: no pass of their own."""
        seen = Observation()
        self.watching.append((name, seen))
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.cast("long").alias(k) for k, c in counts.items()))

    def __enter__(self) -> Recorder:
        self.began = datetime.now(timezone.utc)
        return self

    def __exit__(self, kind, error, trace) -> None:
        # what a failed run observed may never come
        stats = {} if error else {f"{name}.{k}": v for name, seen in self.watching for k, v in seen.get.items() if v is not None}
        status = "failed" if error else "succeeded"
        row = (*self.head, status, self.params, self.inputs, stats, self.phases, str(error)[:500] if error else None, self.began, datetime.now(timezone.utc))
        append(self.spark.createDataFrame([row], RUN), self.path)


def delete_view(spark: SparkSession, path: str, outputs: list[str], view_id: int, protected: tuple[int, ...] = ()) -> DataFrame:
    """Removes a view's runs from the ledger and these runs' partitions (run_id=) from the outputs; the ledger that is left.

    Outputs go first: a removal that is cut off is made whole by the next. Protected views can't go. The file system is
    asked for what is there and not once for each run, as most runs have no partition in most outputs.
    """
    if view_id in protected:
        raise ValueError(f"view {view_id} can't be removed")
    runs = spark.read.parquet(path)
    gone = runs.where(F.col("view_id") == view_id).select(F.concat(F.lit("run_id="), F.col("id").cast("string")).alias("folder"))
    for output in outputs:
        for names in files.name_blocks(spark, output):
            there = spark.createDataFrame([(x,) for x in names if x.startswith("run_id=")], "folder string")
            for (folder,) in there.join(gone, "folder", "left_semi").collect():  # names of one block
                files.remove(spark, f"{output}/{folder}")
    left = stored(without_views(runs, spark.createDataFrame([(view_id,)], "view_id long")), "ledger")
    left.write.mode("overwrite").parquet(path)
    return left



def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def listed(runs: DataFrame, kind: str, status: str) -> DataFrame:
    return runs.where((F.col("type") == kind) & (F.col("status") == status)).orderBy("created_at", "id")


def latest(runs: DataFrame) -> DataFrame:
    """The latest succeeded run of each view and type."""
    order = Window.partitionBy("view_id", "type").orderBy(F.desc("completed_at"), F.desc("created_at"), F.desc("id"))
    return runs.where("status = 'succeeded'").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def resolved(views: DataFrame, runs: DataFrame, kind: str) -> DataFrame:
    """view_id, run_id (requested, else the default), usable: succeeded, of the type and of the view."""
    wanted = views.select("view_id", F.coalesce("requested_run", "default_run").alias("run_id"))
    good = runs.where((F.col("status") == "succeeded") & (F.col("type") == kind)).select(F.col("id").alias("run_id"), "view_id", F.lit(True).alias("_ok"))
    return wanted.join(good, ["run_id", "view_id"], "left").select("view_id", "run_id", F.coalesce("_ok", F.lit(False)).alias("usable"))


def _input(runs: DataFrame) -> DataFrame:
    return runs.withColumn("_input", F.get_json_object("input_refs", "$.run_id").cast("long"))


def lineage(runs: DataFrame) -> DataFrame:
    """run_id, input_id, input_type: one step back; join it with itself for more."""
    inputs = runs.select(F.col("id").alias("input_id"), F.col("type").alias("input_type"))
    return _input(runs).join(inputs, F.col("_input") == F.col("input_id")).select(F.col("id").alias("run_id"), "input_id", "input_type")


def matching(runs: DataFrame, defaults: DataFrame) -> DataFrame:
    """run_id, matches: whether a run was made from its view's default run."""
    return _input(runs).join(defaults, "view_id", "left").select(F.col("id").alias("run_id"), (F.col("_input") == F.col("default_run")).alias("matches"))


def without_views(runs: DataFrame, gone: DataFrame) -> DataFrame:
    """Runs that stay when views go; what is named all_records can't go and has no row in ``gone``."""
    return runs.join(gone, "view_id", "left_anti")


def referenced(rows: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Rows that something still refers to."""
    return rows.join(references.select(key), key, "left_semi")


def warnings(runs: DataFrame, version: int = TREND_VERSION) -> DataFrame:
    """view_id, warnings: default runs that are missing, trend and label runs of another cluster run, trends of an older version.

    The version stands in a trend run's stats as mathVersion; without it it is 1.
    """
    best = _input(latest(runs))
    c = best.where("type = 'cluster'").select("view_id", F.col("id").alias("_c"))
    older = F.coalesce(F.get_json_object("stats", "$.mathVersion").cast("int"), F.lit(1))
    t = best.where("type = 'trend'").select("view_id", F.col("id").alias("_t"), F.col("_input").alias("_ref"), older.alias("_version"))
    n = best.where("type = 'label'").select("view_id", F.col("id").alias("_n"), F.col("_input").alias("_named"))
    rows = runs.select("view_id").distinct().join(c, "view_id", "left").join(t, "view_id", "left").join(n, "view_id", "left")
    found = F.array(
        F.when(F.col("_c").isNull(), "no cluster run"),
        F.when(F.col("_n").isNull(), "no labels"),
        F.when(F.col("_named") != F.col("_c"), "label run is of another cluster run"),
        F.when(F.col("_t").isNull(), "no trend run"),
        F.when(F.col("_ref") != F.col("_c"), "trend run is of another cluster run"),
        F.when(F.col("_version") < version, F.format_string(f"trend run is of version %d, not {version}", "_version")),
    )
    return rows.select("view_id", F.array_join(found, ";").alias("warnings"))
