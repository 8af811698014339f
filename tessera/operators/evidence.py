"""Evidence on topics and the artifact: what a reader is shown, as rows that a query composes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import topics as tp
from tessera.operators import trend


def trends(points: DataFrame) -> DataFrame:
    """cluster_id, series (bucket, count), spike, spike_bucket: the best bucket by spike, count, the latest; 0 and null where no spike is above 0."""
    best = F.max_by(F.struct("bucket", "spike"), F.struct("spike", "count", "bucket"))
    rows = points.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "count"))).alias("series"), best.alias("_b"))
    return rows.select("cluster_id", "series", F.greatest("_b.spike", F.lit(0.0)).alias("spike"), F.when(F.col("_b.spike") > 0, F.col("_b.bucket")).alias("spike_bucket"))


def topic_evidence(members: DataFrame, records: DataFrame, labels: DataFrame, points: DataFrame, k: int = 10, provenance: DataFrame | None = None, facet: DataFrame | None = None) -> DataFrame:
    """One row per topic: its summary, latest label, first k representatives, trend, facets.

    representatives: rank, record_id, source_name, title, text, ts, import_id (null without provenance: record_id, import_id).
    facet: cluster_id, value, count, as topics.facets() gives them; facets is null without it.
    """
    sums = tp.summaries(members, k)
    some = sums.select("cluster_id", F.posexplode("representatives").alias("_p", "record_id"))
    told = some.join(records.select("record_id", "source_name", F.col("product").alias("title"), F.col("customer_text").alias("text"), "ts"), "record_id")
    if provenance is None:
        told = told.withColumn("import_id", F.lit(None).cast("string"))
    else:
        told = told.join(provenance.select("record_id", "import_id"), "record_id", "left")
    shown = F.struct((F.col("_p") + 1).alias("rank"), "record_id", "source_name", "title", "text", "ts", "import_id")
    shown = told.groupBy("cluster_id").agg(F.array_sort(F.collect_list(shown)).alias("representatives"))
    rows = sums.drop("representatives").join(shown, "cluster_id", "left").join(trends(points), "cluster_id", "left")
    rows = rows.join(tp.latest_labels(labels).select("cluster_id", "label", F.col("summary").alias("label_summary")), "cluster_id", "left")
    if facet is None:
        return rows.withColumn("facets", F.lit(None).cast("map<string,bigint>"))
    counted = facet.groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "count")))).alias("facets"))
    return rows.join(counted, "cluster_id", "left")


def question_evidence(candidates: DataFrame, evidence: DataFrame, least: float = 0.2) -> DataFrame:
    """The candidates (cluster_id, similarity) with matched, and the match's evidence beside it; the others are runners-up.

    The best candidate, of equals the smallest id, is the match if it is similar enough; else none is, and there is no evidence.
    """
    best = candidates.agg(F.max_by("cluster_id", F.struct("similarity", -F.col("cluster_id"))).alias("_best"))  # one row
    rows = candidates.crossJoin(F.broadcast(best)).withColumn("matched", (F.col("cluster_id") == F.col("_best")) & (F.col("similarity") >= least))
    return rows.drop("_best").join(evidence.withColumn("matched", F.lit(True)), ["cluster_id", "matched"], "left")


def artifact_topics(members: DataFrame, labels: DataFrame, window: DataFrame) -> DataFrame:
    """cluster_id, label, label_summary, size, mean_probability, source_mix, representatives, spike, spike_bucket.

    window: the points that the spike may lie in; of equal ones the earliest bucket counts.
    """
    best = trend.best_points(window, latest=False)
    spikes = best.select("cluster_id", F.greatest("spike", F.lit(0.0)).alias("spike"), F.when(F.col("spike") > 0, F.col("bucket")).alias("spike_bucket"))
    named = tp.latest_labels(labels).select("cluster_id", "label", F.col("summary").alias("label_summary"))
    return tp.summaries(members).join(named, "cluster_id", "left").join(spikes, "cluster_id", "left")


def _four(name: str) -> Column:
    return F.round(name, 4).alias(name)


def artifact_rows(records: DataFrame, members: DataFrame, layout: DataFrame, provenance: DataFrame) -> DataFrame:
    """The map's rows: records that have a place (record_id, x, y) and a topic, texts cut, numbers rounded, with the import that each came by, if any."""
    placed = layout.select("record_id", "x", "y").join(members.select("record_id", "cluster_id", "probability", "outlier_score", "is_noise"), "record_id")
    rows = placed.join(records, "record_id").join(provenance.select("record_id", "import_id"), "record_id", "left")
    return rows.select(
        "record_id", "source_type", "source_name", "product", "sentiment", "rating", "tags", "timestamp_ms", tp.shortened(F.col("customer_text")).alias("text"),
        _four("x"), _four("y"), "cluster_id", _four("probability"), _four("outlier_score"), "is_noise", "import_id",
    )


def artifact_refs(runs: DataFrame, cluster_run: int, members: DataFrame) -> DataFrame:
    """One row: the runs that the artifact stands on, its noise, and whether summaries stand for texts.

    The embed run is the cluster run's input, trend, layout and label runs are the latest succeeded ones made from it; null where there is none.
    """
    made = F.get_json_object("input_refs", "$.run_id").cast("long") == cluster_run
    own = F.col("id") == cluster_run
    among = runs.where(own | (made & (F.col("status") == "succeeded")))
    refs = among.agg(
        F.max(F.when(own, F.get_json_object("input_refs", "$.run_id").cast("long"))).alias("embed_run"),
        *(F.max_by(F.when(F.col("type") == kind, F.col("id")), F.when(made & (F.col("type") == kind), F.struct("completed_at", "id"))).alias(f"{kind}_run") for kind in ("trend", "layout", "label")),
    )
    summarize = runs.where("type = 'summarize'").select(F.col("id").alias("embed_input"), F.lit("summary").alias("representation"))
    source = runs.select(F.col("id").alias("embed_run"), F.get_json_object("input_refs", "$.run_id").cast("long").alias("embed_input"))
    refs = refs.join(source, "embed_run", "left").join(summarize, "embed_input", "left").drop("embed_input")
    noise = members.agg(F.count_if("is_noise").alias("noise_count"), F.coalesce(F.try_divide(F.count_if("is_noise"), F.count(F.lit(1))), F.lit(0.0)).alias("noise_ratio"))
    return refs.withColumn("representation", F.coalesce("representation", F.lit("raw"))).withColumn("cluster_run", F.lit(cluster_run).cast("long")).crossJoin(noise)  # one row each
