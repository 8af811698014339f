"""Golden values of the time series."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import ingest, trend

MEMBERS = "cluster_id long, is_noise boolean, ts timestamp"


def weekly(spark, counts, cluster=1, start=datetime(2025, 1, 6)):
    rows = [(cluster, False, start + timedelta(weeks=w, minutes=i)) for w, n in enumerate(counts) for i in range(n)]
    return spark.createDataFrame(rows, MEMBERS)


def test_spike_after_growth(spark):
    got = trend.points(weekly(spark, [50, 60, 70, 90]), "week").orderBy("bucket").collect()
    assert [r["spike"] for r in got] == pytest.approx([0, 0, 0, 3.674234614174767])


def test_late_burst(spark):
    noise = spark.createDataFrame([(-1, True, datetime(2025, 1, 6))], MEMBERS)
    rows = weekly(spark, [69], start=datetime(2025, 2, 10)).union(noise)
    got = trend.points(rows, "week").orderBy("bucket").collect()
    assert [r["count"] for r in got] == [0, 0, 0, 0, 0, 69]
    assert got[-1]["spike"] == pytest.approx(69.0)


def test_new_topic_and_shares(spark):
    first = spark.createDataFrame([(0, False, datetime(2025, 1, 6))] * 5, MEMBERS)
    rows = first.union(weekly(spark, [5, 5], 1, datetime(2025, 1, 13)))
    new = trend.new_topics(trend.windowed(trend.points(rows, "week"), "2025-01-13", None)).collect()
    assert [(r["cluster_id"], str(r["first_bucket"]), r["count"]) for r in new] == [(1, "2025-01-13", 10)]


def test_week_begins_on_monday(spark):
    row = spark.createDataFrame([(1, False, datetime(2025, 1, 1, 12))], MEMBERS)
    assert [str(r["bucket"]) for r in trend.spine(row, "week").collect()] == ["2024-12-30"]


def test_no_rows(spark):
    none = spark.createDataFrame([], MEMBERS)
    assert trend.points(none, "day").count() == 0
    assert trend.surprising(trend.windowed(trend.points(none, "day"))).count() == 0


def test_empty_window_has_no_sections(spark):
    w = trend.windowed(trend.points(weekly(spark, [5, 6]), "week"), "2030-01-01", "2030-02-01")
    assert w.count() == 0 and trend.rising(w).count() == 0


def test_utc_whatever_the_session_says(spark):
    """Buckets, parsed and printed times of an instant that New York has on another day."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([("2024-01-02T02:00:00Z",), ("2024-01-02T02:00",), ("20240102",), ("2024-01-01T23:59:59.999999Z",), ("2024-07-01T05:06:07.250+05:00",)], "t string")
        ts = ingest.parsed_timestamp(F.col("t"))
        week, month, day = (trend.bucket_start(ts, unit).cast("string") for unit in ("week", "month", "day"))
        got = rows.select(day, week, month, ingest.timestamp_text(ts), F.unix_millis(ts)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [tuple(r) for r in got] == [
        ("2024-01-02", "2024-01-01", "2024-01-01", "2024-01-02T02:00:00Z", 1704160800000),
        ("2024-01-02", "2024-01-01", "2024-01-01", "2024-01-02T02:00:00Z", 1704160800000),
        ("2024-01-02", "2024-01-01", "2024-01-01", "2024-01-02T00:00:00Z", 1704153600000),
        ("2024-01-01", "2024-01-01", "2024-01-01", "2024-01-01T23:59:59.999Z", 1704153599999),
        ("2024-07-01", "2024-07-01", "2024-07-01", "2024-07-01T00:06:07.250Z", 1719792367250),
    ]
