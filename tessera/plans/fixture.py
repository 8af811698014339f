"""Records, memberships and their companions, derived from the given tables.

Each DataFrame has a twin in SQL, so that queries can be checked row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

RECORDS = """records AS (
  SELECT lpad(CAST(e.event_id AS VARCHAR), 8, '0') AS record_id, e.event_id, e.user_id, e.event_type AS source_type,
         coalesce(d.source, 'none') AS source_name, coalesce(d.text, e.event_type) AS customer_text, d.lang AS product,
         e.value AS rating,
         CASE e.event_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' WHEN 2 THEN 'negative' END AS sentiment,
         CASE WHEN e.event_id % 10 <> 0 THEN [e.event_type, concat('u', e.user_id % 5)] END AS tags,
         e.props AS metadata, e.ts, epoch_us(e.ts) // 1000 AS timestamp_ms, e.ts AS created_at, e.event_id % 50 <> 0 AS is_active
  FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id
)"""

_CLUSTER = "user_id % 13 - 1"
#: Topic 7 begins on the 16th day, topic 3 ends on the 20th.
_DRIFT = f"CASE WHEN {_CLUSTER} = 7 AND ts < TIMESTAMP '2024-01-16' THEN -1 WHEN {_CLUSTER} = 3 AND ts >= TIMESTAMP '2024-01-20' THEN -1 ELSE {_CLUSTER} END"


def members_sql(drift: bool = False) -> str:
    return f"""members AS (
  SELECT record_id, event_id, ts, source_type, source_name, cluster_id, cluster_id = -1 AS is_noise, probability, outlier_score FROM (
    SELECT *, {_DRIFT if drift else _CLUSTER} AS cluster_id, CAST(event_id * 37 % 101 AS DOUBLE) / 100 AS probability,
           CAST(event_id * 53 % 101 AS DOUBLE) / 100 AS outlier_score FROM records))"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    turn = F.col("event_id") % 4
    return e.join(d, e["event_id"] == d["doc_id"], "left").select(
        F.lpad(F.col("event_id").cast("string"), 8, "0").alias("record_id"),
        "event_id",
        "user_id",
        F.col("event_type").alias("source_type"),
        F.coalesce("source", F.lit("none")).alias("source_name"),
        F.coalesce("text", "event_type").alias("customer_text"),
        F.col("lang").alias("product"),
        F.col("value").alias("rating"),
        F.when(turn == 0, "positive").when(turn == 1, "neutral").when(turn == 2, "negative").alias("sentiment"),
        F.when(F.col("event_id") % 10 != 0, F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")))).alias("tags"),
        F.col("props").alias("metadata"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        F.col("ts").cast("timestamp").alias("created_at"),
        (F.col("event_id") % 50 != 0).alias("is_active"),
    )


def members(spark: SparkSession, sf_dir: str, drift: bool = False) -> DataFrame:
    r = records(spark, sf_dir)
    cluster = F.expr(_DRIFT if drift else _CLUSTER)
    return r.select(
        "record_id",
        "event_id",
        "ts",
        "source_type",
        "source_name",
        cluster.alias("cluster_id"),
        (cluster == -1).alias("is_noise"),
        ((F.col("event_id") * 37 % 101).cast("double") / 100).alias("probability"),
        ((F.col("event_id") * 53 % 101).cast("double") / 100).alias("outlier_score"),
    )


#: Two label runs for each topic; the later one counts.
LABELS = """labels_of AS (
  SELECT c.cluster_id, v.k AS label_id, concat('Topic ', c.cluster_id, CASE WHEN v.k = 1 THEN ' draft' ELSE '' END) AS label,
         concat('About topic ', c.cluster_id) AS summary, TIMESTAMP '2024-02-01' + to_days(CAST(v.k AS INT)) AS created_at
  FROM (SELECT DISTINCT cluster_id FROM members WHERE NOT is_noise AND cluster_id % 4 <> 2) c, (SELECT unnest([1, 2]) AS k) v
)"""


def labels_of(clusters: DataFrame) -> DataFrame:
    rows = clusters.where("not is_noise and cluster_id % 4 <> 2").select("cluster_id").distinct()
    rows = rows.withColumn("label_id", F.explode(F.array(F.lit(1), F.lit(2))))
    name = F.concat(F.lit("Topic "), F.col("cluster_id").cast("string"), F.when(F.col("label_id") == 1, " draft").otherwise(""))
    return rows.select(
        "cluster_id",
        "label_id",
        name.alias("label"),
        F.concat(F.lit("About topic "), F.col("cluster_id").cast("string")).alias("summary"),
        F.expr("timestamp'2024-02-01' + make_interval(0, 0, 0, label_id)").alias("created_at"),
    )


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
