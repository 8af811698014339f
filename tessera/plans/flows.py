"""Queries that write and read back, and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import ingest
from tessera.operators import trend
from tessera.plans import scripted
from tessera.plans.book import query
from tessera.plans.fixture import RECORDS, members, records, with_ctes
from tessera.plans.intake import VECTORS, _BAD, json_lines
from tessera.plans.trends import BASE, points_sql
from tessera.session import fresh_path, shuffles_removed, table
from tessera.sources import files, sinks
from tessera.sources.keyed import KeyedTable
from tessera.streaming import twins

#: Files that a stream's fixture is written to at a time, by ranges of time.
_FILES = 4


@query("s04_run_output", with_ctes(BASE, select="SELECT 'r1' AS run_id, count(*) AS n FROM members UNION ALL SELECT 'r2', count(*) FROM members WHERE NOT is_noise"))
def s04(spark, sf_dir) -> DataFrame:
    path, m = fresh_path(spark, "runs"), members(spark, sf_dir)
    for run, rows in (("r1", m.where("is_noise")), ("r2", m.where("not is_noise")), ("r1", m)):
        sinks.write_run(rows, path, run)
    return spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("s05_trend_sink", with_ctes(BASE, points_sql(), select="SELECT cluster_id, CAST(bucket AS VARCHAR) AS bucket, count FROM points"))
def s05(spark, sf_dir) -> DataFrame:
    path = fresh_path(spark, "trend")
    series = trend.points(members(spark, sf_dir), "day").select("cluster_id", F.col("bucket").cast("string").alias("bucket"), "count")
    for _ in range(2):  # the second write changes nothing
        sinks.write_run(series, path, "t1")
    return spark.read.parquet(path).where("run_id = 't1'").drop("run_id")


@query("s06_latest_only", with_ctes(BASE, select="SELECT cluster_id, count(*) AS n FROM members GROUP BY 1"))
def s06(spark, sf_dir) -> DataFrame:
    path = fresh_path(spark, "latest")
    sizes = members(spark, sf_dir).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_latest(sizes.where("cluster_id = -1"), path, "v1")
    sinks.write_latest(sizes, path, "v2")
    return sinks.read_latest(spark, path)


@query("s07_audit", with_ctes(BASE, select="SELECT 'sizes' AS recipe, '{\"top_k\":\"5\"}' AS params, cluster_id, n FROM (SELECT CAST(cluster_id AS BIGINT) AS cluster_id, count(*) AS n FROM members GROUP BY 1 ORDER BY n DESC, cluster_id LIMIT 5)"))
def s07(spark, sf_dir) -> DataFrame:
    path = fresh_path(spark, "audit")
    top = members(spark, sf_dir).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster_id").limit(5)
    sinks.audit(top, path, "sizes", {"top_k": "5"})
    return spark.read.parquet(path).select("recipe", "params", F.inline(F.from_json("result", "array<struct<cluster_id: long, n: long>>")))


@query("k01_stream_ingest", with_ctes(RECORDS, select=f"SELECT r.record_id AS record_key, sha256(trim(customer_text, ' ')) AS text_hash, source_type FROM records r JOIN ({_BAD}) b ON b.record_id = r.record_id WHERE len(bad) = 0"))
def k01(spark, sf_dir) -> DataFrame:
    """By three streams, one after the other, each of two micro-batches of several files; the last one brings rows again."""
    lines, out, check = (fresh_path(spark, x) for x in ("lines", "upserts", "check"))
    fields = ingest.accepted(ingest.validated(spark.createDataFrame([], "value string"))).drop("value", "normalized_json").schema.fields
    schema = T.StructType([*fields, T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()), T.StructField("is_active", T.BooleanType())])
    target = KeyedTable(spark, out, "record_key", schema, 16)
    most = max(1, table(spark, sf_dir, "events").count() // (2 * _FILES))  # small tables are several files too; larger ones are as many as the join has tasks
    seen = 0
    for odd in (0, 1, 1):  # each stream goes on where the one before ended
        with shuffles_removed(spark):
            json_lines(spark, sf_dir).where(f"event_id % 2 = {odd}").select("value").write.mode("append").option("maxRecordsPerFile", most).option("compression", "gzip").text(lines)
        there = sum(name.startswith("part-") for name in files.names(spark, lines))
        stream = spark.readStream.option("maxFilesPerTrigger", max(1, (there - seen + 1) // 2)).text(lines)
        twins.upsert_stream(stream, target, check, versions=1).awaitTermination()  # nobody else reads
        seen = there
    return target.read().select("record_key", F.sha2("customer_text", 256).alias("text_hash"), "source_type")


def _event_stream(spark, sf_dir) -> DataFrame:
    """Events as a stream of files in the order of their times; a micro-batch takes several."""
    path = fresh_path(spark, "events")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id", (F.col("user_id") % 13 - 1).alias("cluster_id"))
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    quarter = (last - first) / 4
    for i in range(4):  # one after the other, as files come in
        after = F.col("ts") >= F.lit(first + i * quarter) if i else F.lit(True)
        before = F.col("ts") < F.lit(first + (i + 1) * quarter) if i < 3 else F.lit(True)
        rows.where(after & before).repartitionByRange(_FILES, "ts").write.mode("append").json(path)
    return twins.json_stream(spark, path, "event_id long, ts timestamp, event_type string, user_id long, cluster_id long", _FILES)


@query("k02_stream_counts", with_ctes(RECORDS, select="""SELECT bucket, cluster_id, count, CAST(sum(count) OVER (PARTITION BY bucket) AS BIGINT) AS total FROM (
  SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS bucket, user_id % 13 - 1 AS cluster_id, count(*) AS count FROM records WHERE CAST(date_trunc('week', ts) AS DATE) + INTERVAL 7 day <= (SELECT max(ts) - INTERVAL 2 day FROM records) GROUP BY 1, 2)"""))
def k02(spark, sf_dir) -> DataFrame:
    counts = twins.bucket_counts(_event_stream(spark, sf_dir), "week", "2 days")
    found = twins.drained(counts, fresh_path(spark, "counts"), fresh_path(spark, "check"))
    return found.select(F.col("bucket").cast("string").alias("bucket"), "cluster_id", "count", "total")


@query("k03_stream_dedup", "SELECT DISTINCT sha256(event_type || ' ' || user_id) AS text_hash FROM events")
def k03(spark, sf_dir) -> DataFrame:
    rows = _event_stream(spark, sf_dir).withColumn("customer_text", F.concat_ws(" ", "event_type", F.col("user_id").cast("string")))
    found = twins.drained(twins.distinct_texts(rows, "60 days"), fresh_path(spark, "texts"), fresh_path(spark, "check"))
    return found.select("text_hash")


@query("k04_stream_embed", "SELECT DISTINCT sha256(event_type || ' ' || user_id) AS text_hash, 8 AS dims FROM events")
def k04(spark, sf_dir) -> DataFrame:
    rows = _event_stream(spark, sf_dir).select(F.col("event_id").alias("record_id"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("text"))
    cache = fresh_path(spark, "vectors")
    spark.createDataFrame([], VECTORS).write.parquet(f"{cache}/batch=none")
    twins.embed_stream(rows, "text", cache, VECTORS, scripted.SeededEmbedder(8), fresh_path(spark, "check")).awaitTermination()
    return spark.read.schema(VECTORS).option("recursiveFileLookup", "true").parquet(cache).select("text_hash", F.size("vector").alias("dims"))
