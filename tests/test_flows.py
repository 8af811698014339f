"""Sinks, keyed tables and streams that are interrupted, delivered again or late."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import ingest
from tessera.operators import topics as tp
from tessera.session import REMOVE_SHUFFLES, stored
from tessera.sources import files, sinks
from tessera.sources.keyed import KeyedTable
from tessera.streaming import twins


def test_audit_takes_reports_only(spark, tmp_path):
    path = f"file://{tmp_path}/audit"
    sinks.audit(spark.range(3), path, "three", {"top_k": "3"}, most=3)
    sinks.audit(spark.range(0), path, "none", {})
    with pytest.raises(Exception, match="at most 3 rows"):
        sinks.audit(spark.range(4), path, "four", {}, most=3)
    rows = {r["recipe"]: (r["params"], json.loads(r["result"])) for r in spark.read.parquet(path).collect()}
    assert rows == {"three": ('{"top_k":"3"}', [{"id": 0}, {"id": 1}, {"id": 2}]), "none": ("{}", [])}


def test_latest_replaces_in_one_step(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/latest"
    with pytest.raises(FileNotFoundError):
        sinks.read_latest(spark, path)
    sinks.write_latest(spark.range(3), path, "v1")
    assert sinks.read_latest(spark, path).count() == 3
    seen = []
    run = files.write_json

    def watched(spark, at, value, replace):
        seen.append(sinks.read_latest(spark, path).count())  # the new rows are there, the pointer is the old one
        done = run(spark, at, value, replace)
        seen.append(sinks.read_latest(spark, path).count())  # moved, and the old rows are still there
        return done

    monkeypatch.setattr(files, "write_json", watched)
    sinks.write_latest(spark.range(5), path, "v2")
    assert seen == [3, 5]
    assert len(list((tmp_path / "latest" / "versions").iterdir())) == 1
    assert sinks.latest_version(spark, path)["version"] == "v2"
    assert [p.name for p in (tmp_path / "latest").iterdir() if not p.name.endswith(".crc")] != []


def test_latest_survives_a_writer_that_dies(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/latest"
    sinks.write_latest(spark.range(3), path, "v1")

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(files, "write_json", lambda *a, **k: dies())
        with pytest.raises(RuntimeError, match="lost"):
            sinks.write_latest(spark.range(9), path, "v2")
    assert sinks.read_latest(spark, path).count() == 3
    sinks.write_latest(spark.range(4), path, "v3")
    assert sinks.read_latest(spark, path).count() == 4
    assert len(list((tmp_path / "latest" / "versions").iterdir())) == 1  # what the dead writer left is gone


def test_a_file_is_written_once(spark, tmp_path):
    at = f"file://{tmp_path}/x/one.json"
    assert files.read_json(spark, at) is None
    assert files.write_json(spark, at, {"a": 1}, replace=False)
    assert not files.write_json(spark, at, {"a": 2}, replace=False)
    assert files.read_json(spark, at) == {"a": 1}
    assert files.write_json(spark, at, {"a": 3}, replace=True)
    assert files.read_json(spark, at) == {"a": 3}
    assert not [n for n in files.names(spark, f"file://{tmp_path}/x") if n.startswith(".one.json.") and not n.endswith(".crc")]


@pytest.fixture
def keyed(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v string").schema
    return KeyedTable(spark, f"file://{tmp_path}/keyed", "k", schema, 8)


def newest(current, fresh):
    return current.join(fresh.select("k"), "k", "left_anti").unionByName(fresh.select("k", "v"))


def rows_of(table):
    return {r["k"]: r["v"] for r in table.read().collect()}


def test_keyed_table_rewrites_touched_buckets_only(spark, keyed):
    assert keyed.read().isEmpty()
    keyed.upsert(spark.range(40).select(F.col("id").alias("k"), F.lit("a").alias("v")), newest)
    before = keyed.state()["folders"]
    keyed.upsert(spark.createDataFrame([(3, "b")], "k long, v string"), newest)
    after = keyed.state()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert rows_of(keyed) == {k: "b" if k == 3 else "a" for k in range(40)}
    other = KeyedTable(spark, keyed.path, "k", keyed.schema, 99)  # as another session opens it
    assert rows_of(other) == rows_of(keyed) and other.state()["buckets"] == 8
    keyed.collect_garbage()
    assert rows_of(keyed)[3] == "b" and len(rows_of(keyed)) == 40
    assert len(files.names(spark, f"{keyed.path}/versions")) == 1
    with pytest.raises(ValueError, match="without k"):
        keyed.upsert(spark.createDataFrame([(None, "b")], "k long, v string"), newest)


def test_keyed_table_takes_a_batch_once_and_one_of_two_writers(spark, keyed):
    rows = lambda v: spark.createDataFrame([(1, v)], "k long, v string")
    assert keyed.upsert(rows("a"), newest, "s", 0)
    assert not keyed.upsert(rows("again"), newest, "s", 0)
    assert keyed.upsert(rows("b"), newest, "s", 1) and keyed.upsert(rows("c"), newest, "t", 0)
    assert rows_of(keyed) == {1: "c"}

    def late(current, fresh):  # while this writer merges, another one commits
        keyed.upsert(rows("first"), newest)
        return newest(current, fresh)

    with pytest.raises(RuntimeError, match="another writer"):
        keyed.upsert(rows("second"), late)
    assert rows_of(keyed) == {1: "first"}


def test_keyed_table_cuts_large_buckets_and_no_task_has_two(spark, keyed, monkeypatch, tmp_path):
    monkeypatch.setattr("tessera.sources.keyed.TASK_BYTES", 2000)
    rows = lambda a, b, v: spark.range(a, b).select(F.col("id").alias("k"), F.concat(F.lit(v), F.repeat(F.lit("x"), 99)).alias("v"))
    for a, b, v in ((0, 400, "a"), (200, 600, "b"), (5, 6, "c")):  # some 50, then 75 rows a bucket
        keyed.upsert(rows(a, b, v), newest)
    got = {k: v[0] for k, v in rows_of(keyed).items()}
    assert got == {k: "c" if k == 5 else "b" if k >= 200 else "a" for k in range(600)} and keyed.read().count() == 600
    first = sorted((tmp_path / "keyed" / "data").iterdir())[0]
    inside = [sorted(b.glob("part-*")) for b in first.glob("bucket=*")]
    assert len(inside) == 8 and all(len(b) > 1 for b in inside)
    tasks = [p.name.split("-")[1] for b in inside for p in b]
    assert len(set(tasks)) == len(tasks)  # a task wrote one file
    assert max(spark.read.parquet(f"file://{p}").count() for b in inside for p in b) < 40


def line(key, text, ts="2024-01-01T00:00:00Z"):
    return json.dumps({"recordId": key, "sourceType": "t", "sourceName": "s", "sourceRecordId": key, "customerText": text, "timestamp": ts, "metadata": {}})


def test_upsert_stream_goes_on_after_a_restart(spark, tmp_path):
    source, check = tmp_path / "in", f"file://{tmp_path}/check"
    source.mkdir()
    (source / "1.txt").write_text("\n".join(line(f"k{i}", "one") for i in range(5)) + "\nnot json\n")
    fields = ingest.accepted(ingest.validated(spark.read.text(str(source)).limit(0))).drop("value", "normalized_json").schema
    table = KeyedTable(spark, f"file://{tmp_path}/table", "record_key", fields.add("created_at", "timestamp").add("updated_at", "timestamp").add("is_active", "boolean"), 4)
    run = lambda: twins.upsert_stream(spark.readStream.text(str(source)), table, check).awaitTermination()
    run()
    first = {r["record_key"]: r for r in table.read().collect()}
    assert sorted(first) == [f"k{i}" for i in range(5)]
    run()  # nothing new: no new version
    assert table.state()["version"] == 1
    (source / "2.txt").write_text(line("k1", "two") + "\n" + line("k9", "new") + "\n")
    table = KeyedTable(spark, table.path, "record_key", table.schema)  # nothing is known but the folder
    run()
    second = {r["record_key"]: r for r in table.read().collect()}
    assert {k: r["customer_text"] for k, r in second.items()} == {"k0": "one", "k1": "two", "k2": "one", "k3": "one", "k4": "one", "k9": "new"}
    assert second["k1"]["created_at"] == first["k1"]["created_at"] and second["k1"]["updated_at"] > first["k1"]["updated_at"]
    assert table.state()["batches"]["records"] == 1


def test_bucket_counts_with_totals_drop_late_rows(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    row = lambda day, topic: json.dumps({"ts": f"2024-01-{day:02d}T10:00:00.000Z", "cluster_id": topic})
    batches = [[row(1, 0), row(1, 0), row(1, 1), row(2, -1)], [row(3, 1), row(6, 0)], [row(6, 1)], [row(1, 0), row(9, 0)], [row(14, 5)]]
    for i, rows in enumerate(batches):  # the row of the first day in the fourth file is later than two days
        (source / f"{i}.json").write_text("\n".join(rows))
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files go by their times
    stream = twins.json_stream(spark, str(source), "ts timestamp, cluster_id long")
    found = twins.drained(twins.bucket_counts(stream, "day", "2 days"), f"file://{tmp_path}/out", f"file://{tmp_path}/check").collect()
    got = {(str(r["bucket"]), r["cluster_id"]): (r["count"], r["total"]) for r in found}
    assert got == {
        ("2024-01-01", 0): (2, 3), ("2024-01-01", 1): (1, 3), ("2024-01-02", -1): (1, 1), ("2024-01-03", 1): (1, 1),
        ("2024-01-06", 0): (1, 2), ("2024-01-06", 1): (1, 2), ("2024-01-09", 0): (1, 1),
    }
    assert len(found) == len(got)


def test_facets_have_one_rest_and_no_window_over_all_values(spark):
    rows = [(f"r{i}", 1, False, f"v{i % 30:02d}" if i % 3 else "(other)") for i in range(300)] + [("n", 1, True, "noise"), ("e", 2, False, "x")]
    data = spark.createDataFrame(rows, "record_id string, cluster_id int, is_noise boolean, product string")
    found = tp.facets(data, data.select("record_id", "product"), "product", top=4)
    got = {(r["cluster_id"], r["value"]): r["count"] for r in found.collect()}
    assert found.count() == len(got) == 5
    assert got == {(1, "(other)"): 270, (1, "v01"): 10, (1, "v02"): 10, (1, "v04"): 10, (2, "x"): 1}
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()


def test_versions_that_are_forgotten_leave_the_disk(spark, keyed, tmp_path):
    """Of folders only those that the last versions name stay, and what another writer has not committed yet."""
    for k, v in ((40, "a"), (40, "b"), (3, "c")):
        keyed.upsert(spark.range(k).select(F.col("id").alias("k"), F.lit(v).alias("v")), newest)
    (tmp_path / "keyed" / "data" / "under-way" / "bucket=1").mkdir(parents=True)
    keyed.forget(2)
    assert len(files.names(spark, f"{keyed.path}/versions")) == 2
    keyed.forget()
    want = {"under-way/bucket=1", *keyed.state()["folders"].values()}
    assert {f"{b.parent.name}/{b.name}" for b in (tmp_path / "keyed" / "data").glob("*/bucket=*")} == want
    assert len(list((tmp_path / "keyed" / "data").iterdir())) == 3 and keyed.state()["version"] == 3
    assert rows_of(keyed) == {k: "c" if k < 3 else "b" for k in range(40)}


def shuffles(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}


def gone(spark, before):
    """No other shuffle files than before, within some seconds: they are removed in the background."""
    end = time.time() + 10
    while not shuffles(spark) <= before and time.time() < end:
        time.sleep(0.2)
    return shuffles(spark) <= before


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = shuffles(spark)
    found = stored(spark.range(2000).groupBy((F.col("id") % 700).alias("k")).count(), "counts")
    assert gone(spark, before)
    assert found.count() == 700


def test_an_upsert_leaves_no_shuffle_files(spark, keyed):
    rows = spark.range(2000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    keyed.upsert(rows, newest)
    before, setting = shuffles(spark), spark.conf.get(REMOVE_SHUFFLES, None)
    keyed.upsert(rows.where("k > 500"), newest)
    assert gone(spark, before)
    assert spark.conf.get(REMOVE_SHUFFLES, None) == setting


def test_a_stream_keeps_few_versions(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    fields = ingest.accepted(ingest.validated(spark.read.text(str(source)).limit(0))).drop("value", "normalized_json").schema
    table = KeyedTable(spark, f"file://{tmp_path}/table", "record_key", fields.add("created_at", "timestamp").add("updated_at", "timestamp").add("is_active", "boolean"), 4)
    for i in range(4):
        (source / f"{i}.txt").write_text("\n".join(line(f"k{j}", f"text {i}") for j in range(i, 9)))
        twins.upsert_stream(spark.readStream.text(str(source)), table, f"file://{tmp_path}/check").awaitTermination()
    assert table.state()["version"] == 4 and len(files.names(spark, f"{table.path}/versions")) == 2
    assert len(files.names(spark, f"{table.path}/data")) <= 4
    assert {r["record_key"]: r["customer_text"] for r in table.read().collect()} == {f"k{j}": f"text {min(j, 3)}" for j in range(9)}


def test_rows_of_a_stream_are_joined_where_they_are_written(spark, tmp_path, monkeypatch):
    """The table's rows are dealt out once for each micro-batch, and the new ones once more to find the last of a key."""
    monkeypatch.setattr("tessera.sources.keyed.TASK_BYTES", 2000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        fields = ingest.accepted(ingest.validated(spark.createDataFrame([], "value string"))).drop("value", "normalized_json").schema
        table = KeyedTable(spark, f"file://{tmp_path}/table", "record_key", fields.add("created_at", "timestamp").add("updated_at", "timestamp").add("is_active", "boolean"), 4)
        plans = []
        run = ingest.upserted
        monkeypatch.setattr(ingest, "upserted", lambda *a, **k: plans.append(run(*a, **k)) or plans[-1])
        source = tmp_path / "in"
        source.mkdir()
        for i in range(3):
            (source / f"{i}.txt").write_text("\n".join(line(f"k{j}", f"text {i}") for j in range(i * 20, i * 20 + 60) for _ in range(2)))
            twins.upsert_stream(spark.readStream.text(str(source)), table, f"file://{tmp_path}/check").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans[-1]._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 3
    assert {r["record_key"]: r["customer_text"] for r in table.read().collect()} == {f"k{j}": f"text {min(j // 20, 2)}" for j in range(100)}
    assert table.read().count() == 100
    last = max((tmp_path / "table" / "data").iterdir())
    tasks = [p.name.split("-")[1] for p in last.glob("bucket=*/part-*")]
    assert len(tasks) > 4 and len(set(tasks)) == len(tasks)
