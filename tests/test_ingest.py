"""Validation rules, timestamps, upserts and snapshot differences."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import ingest, scope
from tessera.operators import snapshot as sn
from tessera.plans import intake
from tessera.session import table

GOOD = {"recordId": "r1", "sourceType": "t", "sourceName": "n", "sourceRecordId": "s", "customerText": "  hi ", "timestamp": "2025-01-02T03:04:05Z"}


def fields(spark, *values):
    lines = spark.createDataFrame([(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "i int, value string")
    return {r["i"]: [e["field"] for e in r["errors"]] for r in ingest.validated(lines).collect()}


def test_rules(spark):
    got = fields(
        spark,
        GOOD,
        GOOD | {"recordId": None},
        GOOD | {"customerText": " \n "},
        GOOD | {"timestamp": 5},
        GOOD | {"timestamp": "2025-13-01"},
        GOOD | {"rating": True},
        GOOD | {"rating": 4.5, "tags": ["a"], "metadata": {"k": 1}},
        GOOD | {"tags": ["a", 1], "metadata": [1], "title": 3, "zzz": 1, "aaa": 2},
        "[1]",
        "not json",
        GOOD | {"tags": [], "title": None},
        {},
    )
    assert got[0] == got[6] == got[10] == []
    assert got[1] == ["recordId"] and got[2] == ["customerText"] and got[3] == got[4] == ["timestamp"] and got[5] == ["rating"]
    assert got[7] == ["aaa", "zzz", "title", "tags", "metadata"]
    assert got[8] == got[9] == [""]
    assert got[11] == ["recordId", "sourceType", "sourceName", "sourceRecordId", "customerText", "timestamp"]


def test_kept_text(spark):
    lines = spark.createDataFrame([(json.dumps(GOOD | {"title": " T ", "metadata": {"b": 1, "a": "x"}}),)], "value string")
    row = ingest.validated(lines).first()
    assert (row["customer_text"], row["title"], row["metadata"]) == ("hi", " T ", '{"a":"x","b":1}')


@pytest.mark.parametrize(
    "text", ["2025-01-02", "2025-01-02T03:04", "2025-01-02T03:04:05.678901+02:00", "20250102T030405", "2025-01-02 03:04:05-0530", "2025-01-02T03:04:05,5Z", "2025-01-02T03Z", "2025-01-02T03:04-05", "2025", "2025-01", "x", "", "2025-02-30", "2025-01-02T25:00"]
)
def test_timestamps_as_python(spark, text):
    try:
        want = datetime.fromisoformat(text.replace("Z", "+00:00"))
        want = int((want if want.tzinfo else want.replace(tzinfo=UTC)).timestamp() * 1000)
    except ValueError:
        want = None
    got = spark.createDataFrame([(text,)], "t string").select(F.unix_millis(ingest.parsed_timestamp(F.col("t")))).first()[0]
    assert got == want


def test_reject_and_skip(spark):
    rows = ingest.validated(spark.createDataFrame([(json.dumps(GOOD),), ("{}",)], "value string"))
    assert ingest.admitted(rows, "skip").count() == 1
    with pytest.raises(ValueError):
        ingest.admitted(rows, "reject")


def test_skipped_and_admitted_rows_are_counted_in_one_pass(spark, sf):
    rows = ingest.validated(spark.createDataFrame([(json.dumps(GOOD),), ("{}",), ("no json",), (None,)], "value string"))
    counts = {r["valid"]: r["n"] for r in ingest.admission_counts(rows).collect()}
    assert counts == {True: ingest.admitted(rows, "skip").count(), False: ingest.rejected(rows).count()} == {True: 1, False: 3}
    plan = intake.i03(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # lines are made and read once


def test_steps_of_a_timestamp_are_in_its_plan_once(spark):
    plan = spark.range(1).select(ingest.parsed_timestamp(F.col("id").cast("string")).alias("ts"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") <= 15


def test_upsert_last_wins(spark):
    current = spark.createDataFrame([("a", 1, 10, 10, False)], "record_key string, v int, created_at int, updated_at int, is_active boolean")
    batch = spark.createDataFrame([("a", 2, 0), ("b", 3, 1), ("b", 4, 2)], "record_key string, v int, batch_index int")
    got = {r["record_key"]: (r["v"], r["created_at"], r["updated_at"], r["is_active"]) for r in ingest.upserted(current, batch, F.lit(20)).collect()}
    assert got == {"a": (2, 10, 20, True), "b": (4, 20, 20, True)}
    assert tuple(ingest.upsert_counts(current, batch).first()) == (1, 2)


def test_metadata_types(spark):
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(['{"k":5}', '{"k":"5"}', '{"k":5.0}', '{"k":true}', "{}", None, "bad"])], "i int, metadata string")
    ids = lambda v: [r["i"] for r in rows.where(scope.metadata_equals("metadata", "k", v)).orderBy("i").collect()]
    assert ids(5) == [0, 2] and ids("5") == [1] and ids(True) == [3] and ids(None) == []
    with pytest.raises(ValueError):
        scope.predicate({"nope": 1})


def test_snapshot_golden(spark):
    first = [(str(i), "v1", True) for i in range(10)]
    history = spark.createDataFrame(first, "external_id string, version_hash string, is_current boolean").select(
        "*", F.col("external_id").alias("record_id"), F.lit("i1").alias("introduced_by"), F.lit(None).cast("timestamp").alias("superseded_at")
    )
    second = [(str(i), "v1", True) for i in range(7)] + [("7", "v2", True), ("n", "v1", True)]
    snap = spark.createDataFrame(second, "external_id string, version_hash string, active boolean")
    counts = sn.change_counts(sn.difference(history, snap)).first().asDict()
    assert counts == {"added": 1, "changed": 1, "unchanged": 7, "deleted": 2, "inactive": 0, "active": 9}
    after = sn.applied(history, sn.difference(history, snap), "d", "i2", F.current_timestamp())
    current = after.where("is_current").groupBy("external_id").count()
    assert current.count() == 9 and current.where("count > 1").isEmpty()
    back = spark.createDataFrame([("7", "v1", True)], snap.schema)
    revived = sn.difference(after, back).where("external_id = '7'").first()["change"]
    assert revived == "changed"


def test_json_lines_carry_whole_texts(spark, sf, tmp_path):
    tail = "x" * 5000 + ' "quoted" \\ back\nline\r\n\ttab \u0001\u2028\u00e9\U0001f600 end'
    table(spark, sf, "documents").withColumn("text", F.concat("text", F.lit(tail))).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, sf, "events").write.parquet(f"{tmp_path}/events.parquet")
    intake.json_lines(spark, str(tmp_path)).select("value").write.text(f"{tmp_path}/lines")
    read = ingest.validated(ingest.read_lines(spark, f"{tmp_path}/lines")).select(F.col("record_key").alias("record_id"), F.col("customer_text").alias("got"))
    both = intake.records(spark, str(tmp_path)).where("event_id % 17 <> 0").join(read, "record_id", "left")
    assert both.where(F.endswith("customer_text", F.lit(tail))).count() > 0
    assert both.where(~F.col("got").eqNullSafe(F.trim("customer_text"))).isEmpty()
