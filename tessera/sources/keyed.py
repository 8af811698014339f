"""A table of one row per key that streams upsert into, as files that any session can go on with.

Rows lie in a fixed number of buckets by a hash of their key. A commit writes the buckets that
it touches to new folders and leaves the others where they are; then a version file, a
list of the buckets' folders, is renamed into place under the next number. The highest number is
the table. A commit that another writer was faster than fails before it changes anything.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import shuffles_removed
from tessera.sources import files

#: Bytes that one task writes of a bucket, old rows counted as they lie in files and new ones as JSON.
TASK_BYTES = 64 << 20
#: Column of the task that writes a row.
PLACE = "_place"


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    key: str
    schema: T.StructType
    buckets: int = 64

    def state(self) -> dict:
        """version, buckets (their number), batches (the last one of each stream), folders (by bucket) of the newest version."""
        found = [x for x in files.names(self.spark, f"{self.path}/versions") if not x.startswith(".")]
        if not found:
            return {"version": 0, "buckets": self.buckets, "batches": {}, "folders": {}}
        return files.read_json(self.spark, f"{self.path}/versions/{found[-1]}")

    def _read(self, state: dict, only: list[int] | None = None) -> DataFrame:
        folders = sorted(f for b, f in state["folders"].items() if only is None or int(b) in only)
        rows = self.spark.read.schema(self.schema)
        return rows.parquet(*(f"{self.path}/data/{f}" for f in folders)) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The newest version's rows."""
        return self._read(self.state())

    def upsert(self, rows: DataFrame, merge: Callable[..., DataFrame], stream: str = "", batch: int | None = None, placed: bool = False) -> bool:
        """Merges rows into the buckets that their keys are in; merge gets these buckets' rows and the new ones.

        A batch of a stream that was committed before changes nothing, and False comes back. Rows without a key are refused.
        With placed, merge gets a function besides that deals rows out to the tasks which write them, and names a row's task
        in a column PLACE; what it returns lies as these rows do, so it is not dealt out again.
        """
        with shuffles_removed(self.spark, rows.sparkSession):
            return self._upsert(rows, merge, stream, batch, placed)

    def _upsert(self, rows: DataFrame, merge: Callable[..., DataFrame], stream: str, batch: int | None, placed: bool) -> bool:
        state = self.state()
        if batch is not None and state["batches"].get(stream, -1) >= batch:
            return False
        at = F.pmod(F.xxhash64(F.col(self.key)), F.lit(state["buckets"])).cast("int")
        bucket, bytes_ = F.when(F.col(self.key).isNull(), -1).otherwise(at), F.octet_length(F.to_json(F.struct("*")))
        touched = {r["b"]: r["n"] for r in rows.groupBy(bucket.alias("b")).agg(F.sum(bytes_).alias("n")).collect()}  # at most one for each bucket
        if -1 in touched:
            raise ValueError(f"rows without {self.key}")
        folders = dict(state["folders"])
        if touched:
            folder = f"{state['version'] + 1:012d}-{uuid.uuid4().hex}"
            # a bucket's rows are few files: a task, and so a file, for each slice of a bucket, and no task has two
            first, slices, n = [0] * state["buckets"], [1] * state["buckets"], 0
            for b, fresh in sorted(touched.items()):
                old = files.size(self.spark, f"{self.path}/data/{folders[str(b)]}") if str(b) in folders else 0
                first[b], slices[b] = n, max(1, -(-(old + fresh) // TASK_BYTES))
                n += slices[b]
            place = F.get(F.lit(first), at) + F.pmod(F.xxhash64(F.col(self.key), F.lit("slice")), F.get(F.lit(slices), at))
            deal = lambda some: some.withColumn(PLACE, place.cast("int")).repartitionById(n, F.col(PLACE))
            current = self._read(state, list(touched))
            made = merge(current, rows, deal) if placed else deal(merge(current, rows))
            made = made.select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields))
            made.withColumn("bucket", at).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
            folders |= {str(b): f"{folder}/bucket={b}" for b in touched}
        batches = state["batches"] | ({stream: batch} if batch is not None else {})
        new = {"version": state["version"] + 1, "buckets": state["buckets"], "batches": batches, "folders": folders}
        if not files.write_json(self.spark, f"{self.path}/versions/{new['version']:012d}.json", new, replace=False):
            raise RuntimeError(f"version {new['version']} of {self.path} was written by another writer")
        return True

    def forget(self, keep: int = 1) -> None:
        """Removes versions before the last ``keep`` and the folders that they alone name; data that no version names yet stays, so other writers may go on."""
        versions = [x for x in files.names(self.spark, f"{self.path}/versions") if not x.startswith(".")]
        folders = lambda names: {f for v in names for f in files.read_json(self.spark, f"{self.path}/versions/{v}")["folders"].values()}
        old = versions[:-keep]
        if not old:
            return
        gone = folders(old) - folders(versions[-keep:])
        for f in sorted(gone):
            files.remove(self.spark, f"{self.path}/data/{f}")
        for top in sorted({f.split("/")[0] for f in gone}):
            if not any(x.startswith("bucket=") for x in files.names(self.spark, f"{self.path}/data/{top}")):
                files.remove(self.spark, f"{self.path}/data/{top}")
        for v in old:  # last: a call that was cut off is taken up by the next
            files.remove(self.spark, f"{self.path}/versions/{v}")

    def collect_garbage(self, keep: int = 1) -> None:
        """Removes versions before the last ``keep`` and all data that the others don't name. Not beside a commit."""
        versions = [x for x in files.names(self.spark, f"{self.path}/versions") if not x.startswith(".")]
        kept = [files.read_json(self.spark, f"{self.path}/versions/{v}") for v in versions[-keep:]]
        named = {f for v in kept for f in v["folders"].values()}
        for v in versions[:-keep]:
            files.remove(self.spark, f"{self.path}/versions/{v}")
        for top in files.names(self.spark, f"{self.path}/data"):
            inside = files.names(self.spark, f"{self.path}/data/{top}")
            if not any(f"{top}/{x}" in named for x in inside):
                files.remove(self.spark, f"{self.path}/data/{top}")
            else:
                for x in inside:
                    if x.startswith("bucket=") and f"{top}/{x}" not in named:
                        files.remove(self.spark, f"{self.path}/data/{top}/{x}")
