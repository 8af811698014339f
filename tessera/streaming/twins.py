"""Streaming twins of ingest, bucket counts, exact dedup and embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import utc_day
from tessera.operators import ingest, providers
from tessera.sources.keyed import PLACE, KeyedTable

#: Epoch days are counted from a Thursday; weeks that begin on Monday start four days on.
_STARTS = {"day": "0 days", "week": "4 days"}
_SIZES = {"day": "1 day", "week": "7 days"}


def upsert_stream(lines: DataFrame, table: KeyedTable, checkpoint: str, stream: str = "records", versions: int = 2) -> StreamingQuery:
    """Validates JSON lines and upserts each micro-batch into the table; a batch that is delivered again changes nothing more.

    All that the stream has to know is in the table's version files and the checkpoint, so a stream that is started
    anew, in another session too, goes on where the last one ended. The table's last ``versions`` stay: who reads the one
    before the newest has a micro-batch's time to end.
    """

    def merge(current: DataFrame, fresh: DataFrame, deal: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return ingest.upserted(current, fresh, F.current_timestamp(), dealt=(deal, PLACE)).drop("change")

    def batch(rows: DataFrame, number: int) -> None:
        good = ingest.accepted(ingest.validated(rows.select("value")))
        fresh = good.drop("value", "normalized_json").withColumn("batch_index", F.monotonically_increasing_id())
        table.upsert(fresh, merge, stream, number, placed=True)
        table.forget(versions)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bucket_counts(members: DataFrame, unit: str, delay: str) -> DataFrame:
    """bucket, cluster_id, count, total: tumbling counts of each topic, and of its bucket over all topics and noise.

    Two aggregations in one stream: topics are counted first, and the counts of a bucket, one row for each topic, are
    gathered when its window closes. Rows later than the delay are dropped, from both. Noise has its own rows.
    """
    window = F.window("ts", _SIZES[unit], _SIZES[unit], _STARTS[unit])
    counted = members.withWatermark("ts", delay).groupBy(window.alias("w"), "cluster_id").agg(F.count(F.lit(1)).alias("count"))
    whole = F.window(F.window_time("w"), _SIZES[unit], _SIZES[unit], _STARTS[unit])
    gathered = counted.groupBy(whole.alias("w")).agg(F.sum("count").alias("total"), F.collect_list(F.struct("cluster_id", "count")).alias("topics"))
    return gathered.select(utc_day(F.col("w.start")).alias("bucket"), F.inline("topics"), "total").select("bucket", "cluster_id", "count", "total")


def distinct_texts(records: DataFrame, delay: str) -> DataFrame:
    """Records whose text's hash was not seen within the delay."""
    return records.withColumn("text_hash", F.sha2("customer_text", 256)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["text_hash"])


def embed_stream(records: DataFrame, text_col: str, cache_path: str, schema: str, provider, checkpoint: str) -> StreamingQuery:
    """Asks the provider for new texts only; each batch's vectors go to a folder of its number, so a batch that runs again overwrites its own."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        cache = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(cache_path)
        old = cache.where(~F.col("_metadata.file_path").contains(f"/batch={number}/"))
        _, fresh = providers.embedded(rows, F.col(text_col), old, provider)
        fresh.write.mode("overwrite").parquet(f"{cache_path}/batch={number}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is, into Parquet, and reads the result."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def json_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """JSON lines of a folder, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
