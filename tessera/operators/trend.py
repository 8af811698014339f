"""Zero-filled topic series, rolling baselines, spikes and the sections ranked from them.

Noise counts in the span of buckets and in their totals, never as a topic. A series has
one row for each bucket, so windows over it stay small whatever the number of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import utc_day

#: Buckets that a baseline looks back, and the first series position that can spike.
BASELINE, FIRST_SPIKE = 8, 3
#: Records in the window that make a topic new, and mean count that makes one missed.
NEW_COUNT, VANISHED_MEAN = 5, 1.0


def bucket_start(ts: Column, unit: str) -> Column:
    """First day of the UTC day, ISO week or month, whatever the session's time zone."""
    return F.trunc(utc_day(ts), unit) if unit != "day" else utc_day(ts)


def topic_rows(members: DataFrame) -> DataFrame:
    return members.where("not is_noise and cluster_id <> -1")


def bounds(members: DataFrame, unit: str) -> DataFrame:
    at = bucket_start(F.col("ts"), unit)
    return members.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))


def _steps(unit: str) -> Column:
    return F.expr(f"sequence(lo, hi, interval 1 {unit})")


def spine(members: DataFrame, unit: str) -> DataFrame:
    """bucket, pos: every bucket from the first to the last record, noise included."""
    found = bounds(members, unit).where("lo is not null")
    return found.select(F.posexplode(_steps(unit)).alias("pos", "bucket")).select("bucket", F.col("pos").cast("long").alias("pos"))


def counts(members: DataFrame, unit: str) -> DataFrame:
    rows = topic_rows(members).select("cluster_id", bucket_start(F.col("ts"), unit).alias("bucket"))
    return rows.groupBy("cluster_id", "bucket").agg(F.count(F.lit(1)).alias("count"))


def totals(members: DataFrame, unit: str) -> DataFrame:
    return members.groupBy(bucket_start(F.col("ts"), unit).alias("bucket")).agg(F.count(F.lit(1)).alias("total"))


def filled(members: DataFrame, unit: str) -> DataFrame:
    """cluster_id, bucket, pos, count, total: one row for each topic and bucket."""
    topics = topic_rows(members).select("cluster_id").distinct()
    grid = topics.crossJoin(bounds(members, unit)).select("cluster_id", F.posexplode(_steps(unit)).alias("pos", "bucket"))
    return (
        grid.join(counts(members, unit), ["cluster_id", "bucket"], "left")
        .join(totals(members, unit), "bucket", "left")
        .select(
            "cluster_id",
            "bucket",
            F.col("pos").cast("long").alias("pos"),
            F.coalesce("count", F.lit(0)).cast("long").alias("count"),
            F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        )
    )


def points(members: DataFrame, unit: str) -> DataFrame:
    """filled() with share, mean, std and spike."""
    before = Window.partitionBy("cluster_id").orderBy("bucket").rowsBetween(-BASELINE, -1)
    share = F.when(F.col("total") > 0, F.col("count") / F.col("total")).otherwise(0.0)
    spike = (F.col("count") - F.col("mean")) / F.greatest("std", F.sqrt("mean"), F.lit(1.0))
    return (
        filled(members, unit)
        .withColumn("share", share)
        .withColumn("mean", F.coalesce(F.avg("count").over(before), F.lit(0.0)))
        .withColumn("std", F.coalesce(F.stddev_pop("count").over(before), F.lit(0.0)))
        .withColumn("spike", F.when(F.col("pos") >= FIRST_SPIKE, spike).otherwise(0.0))
    )


def windowed(series: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """points() with in_window, in_previous (the buckets a baseline back from the window) and has_previous."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("bucket") >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (F.col("bucket") <= F.lit(end).cast("date"))
    first = series.where(inside).agg(F.min("pos").alias("_first"))
    return (
        series.crossJoin(first)
        .where("_first is not null")
        .withColumn("in_window", inside)
        .withColumn("in_previous", (F.col("pos") < F.col("_first")) & (F.col("pos") >= F.col("_first") - BASELINE))
        .withColumn("has_previous", F.col("_first") > 0)
        .drop("_first")
    )


def best_points(series: DataFrame, latest: bool = True) -> DataFrame:
    """The topic's row with the greatest (spike, count); of equals the latest bucket, or the earliest."""
    when = F.col("bucket") if latest else -F.datediff("bucket", F.lit("1970-01-01").cast("date"))
    row = F.max_by(F.struct("bucket", "count", "spike"), F.struct("spike", "count", when))
    return series.groupBy("cluster_id").agg(row.alias("_p")).select("cluster_id", "_p.bucket", "_p.count", "_p.spike")


def surprising(w: DataFrame) -> DataFrame:
    """cluster_id, spike, bucket, count."""
    return best_points(w.where("in_window")).where("spike > 0").select("cluster_id", "spike", "bucket", "count")


def new_topics(w: DataFrame) -> DataFrame:
    """cluster_id, first_bucket, count: first seen in the window, not in the first bucket of all."""
    hit = F.col("count") > 0
    found = w.groupBy("cluster_id").agg(
        F.min(F.when(hit, F.col("bucket"))).alias("first_bucket"),
        F.min(F.when(hit, F.col("pos"))).alias("_pos"),
        F.max_by("in_window", F.when(hit, -F.col("pos"))).alias("_in"),
        F.sum(F.when(F.col("in_window"), F.col("count")).otherwise(0)).alias("count"),
    )
    return found.where(f"_in and _pos > 0 and count >= {NEW_COUNT}").select("cluster_id", "first_bucket", "count")


def vanishing(w: DataFrame) -> DataFrame:
    """cluster_id, baseline_mean: nothing in the window, enough before it."""
    found = w.where("has_previous").groupBy("cluster_id").agg(
        F.sum(F.when(F.col("in_window"), F.col("count")).otherwise(0)).alias("_n"),
        F.avg(F.when(F.col("in_previous"), F.col("count"))).alias("baseline_mean"),
    )
    return found.where(f"_n = 0 and baseline_mean >= {VANISHED_MEAN}").select("cluster_id", "baseline_mean")


def share_changes(w: DataFrame) -> DataFrame:
    """cluster_id, delta_share, window_share, previous_share; means over buckets."""
    found = w.where("has_previous").groupBy("cluster_id").agg(
        F.avg(F.when(F.col("in_window"), F.col("share"))).alias("window_share"),
        F.avg(F.when(F.col("in_previous"), F.col("share"))).alias("previous_share"),
    )
    return found.select("cluster_id", (F.col("window_share") - F.col("previous_share")).alias("delta_share"), "window_share", "previous_share")


def rising(w: DataFrame) -> DataFrame:
    return share_changes(w).where("delta_share > 0")


def falling(w: DataFrame) -> DataFrame:
    return share_changes(w).where("delta_share < 0")


def compare_periods(series: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Counts and mean shares of two date ranges, with their differences; an empty range has 0."""
    inside = [F.col("bucket").between(F.lit(x).cast("date"), F.lit(y).cast("date")) for x, y in (a, b)]
    found = series.groupBy("cluster_id").agg(
        *(F.sum(F.when(i, F.col("count")).otherwise(0)).alias(f"count_{k}") for i, k in zip(inside, "ab", strict=True)),
        *(F.coalesce(F.avg(F.when(i, F.col("share"))), F.lit(0.0)).alias(f"share_{k}") for i, k in zip(inside, "ab", strict=True)),
    )
    return found.withColumn("delta_count", F.col("count_b") - F.col("count_a")).withColumn("delta_share", F.col("share_b") - F.col("share_a"))


def overlapping(series: DataFrame, unit: str, start: str, end: str) -> DataFrame:
    """Rows whose bucket, as a half-open interval, meets the days from start to end."""
    stop = {"day": F.date_add("bucket", 1), "week": F.date_add("bucket", 7), "month": F.add_months("bucket", 1).cast("date")}[unit]
    return series.where((F.col("bucket") < F.date_add(F.lit(end).cast("date"), 1)) & (stop > F.lit(start).cast("date")))


def tidy(series: DataFrame, extent: DataFrame, unit: str) -> DataFrame:
    """Series without leading zeros, unless all are zero, and whether first and last buckets are partial.

    extent: one row with first_ts and last_ts of the records.
    """
    seen = F.min(F.when(F.col("count") > 0, F.col("pos"))).over(Window.partitionBy("cluster_id"))
    stop = F.expr(f"bucket + interval 1 {unit}").cast("timestamp")
    return (
        series.withColumn("_seen", seen)
        .where("_seen is null or pos >= _seen")
        .crossJoin(extent)
        .withColumn("partial", (F.col("bucket").cast("timestamp") < F.col("first_ts")) | (stop > F.col("last_ts")))
        .drop("_seen", "first_ts", "last_ts")
    )


def peaks(series: DataFrame) -> DataFrame:
    """The topic's bucket of the greatest count; the earliest of equals."""
    first = -F.datediff("bucket", F.lit("1970-01-01").cast("date"))
    row = F.max_by(F.struct("bucket", "count"), F.struct(F.col("count"), first))
    return series.groupBy("cluster_id").agg(row.alias("_p")).select("cluster_id", "_p.bucket", "_p.count")


def presets(extent: DataFrame) -> DataFrame:
    """Ranges of 7, 30 and 90 days that end with the data, not before its first day."""
    days = F.explode(F.array(*(F.lit(n) for n in (7, 30, 90)))).alias("days")
    return extent.select(days, "lo", "hi").select(
        F.concat(F.col("days").cast("string"), F.lit("d")).alias("preset"),
        F.greatest("lo", F.expr("date_sub(hi, days - 1)")).alias("start"),
        F.col("hi").alias("end"),
    )
