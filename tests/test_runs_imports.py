"""Runs that are recorded, labels, imports that are refused, and queries that SQL can't express."""

import functools
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunks, ledger, providers
from tessera.operators import snapshot as sn
from tessera.plans import registry, scripted


def test_recorder_counts_on_the_way_and_keeps_failures(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    with ledger.Recorder(spark, path, 5, 1, "embed", inputs={"run_id": 4}) as run, run.phase("write"):
        run.watched(spark.range(10), "rows", even=F.sum((F.col("id") % 2 == 0).cast("int"))).write.parquet(f"file://{tmp_path}/out")
    with pytest.raises(ZeroDivisionError), ledger.Recorder(spark, path, 6, 1, "embed") as run:
        run.watched(spark.range(10), "rows")
        1 / 0  # noqa: B018
    rows = {r["id"]: r for r in spark.read.schema(ledger.RUN).parquet(path).collect()}
    assert rows[5]["stats"] == {"rows.rows": 10, "rows.even": 5} and rows[5]["status"] == "succeeded" and rows[5]["phases"]["write"] > 0
    assert rows[6]["stats"] == {} and rows[6]["status"] == "failed" and "division" in rows[6]["error"]
    assert rows[5]["completed_at"] >= rows[5]["created_at"]


def test_protected_views_stay(spark, tmp_path):
    with pytest.raises(ValueError):
        ledger.delete_view(spark, f"file://{tmp_path}/none", [], 0, protected=(0,))


def test_removal_of_a_view_asks_only_for_folders_that_are_there(spark, tmp_path, monkeypatch):
    path, out = f"file://{tmp_path}/ledger", f"file://{tmp_path}/out"
    spark.range(5000).selectExpr("id", "id % 2 as view_id").write.parquet(path)
    spark.createDataFrame([(r, 2 + r) for r in (1, 2, 7, 9999)], "run_id long, n long").write.partitionBy("run_id").parquet(out)
    removed, remove = [], ledger.files.remove
    monkeypatch.setattr(ledger.files, "remove", lambda spark, at: (removed.append(at), remove(spark, at)))
    monkeypatch.setattr(ledger.files, "name_blocks", functools.partial(ledger.files.name_blocks, size=2))
    left = ledger.delete_view(spark, path, [out, f"file://{tmp_path}/none"], 1)
    assert sorted(removed) == [f"{out}/run_id=1", f"{out}/run_id=7"]
    assert left.count() == 2500 == spark.read.parquet(path).count()
    assert {r["run_id"] for r in spark.read.parquet(out).collect()} == {2, 9999}


def test_label_run_that_fails_as_a_whole_keeps_nothing(spark, tmp_path):
    targets = spark.createDataFrame([(1, ["no"]), (2, ["no", "longer words"])], "cluster_id long, texts array<string>")
    path = f"file://{tmp_path}/labels"
    with pytest.raises(RuntimeError, match=r"every topic failed: \[1, 2\]"):
        providers.label_run(targets, scripted.KeywordLabeller("no"), path, "r1")
    assert not (tmp_path / "labels").exists()
    items = providers.label_run(targets, scripted.KeywordLabeller("longer words"), path, "r2")
    assert {r["cluster_id"]: r["error"] for r in items.collect()} == {1: None, 2: "scripted failure"}
    assert [(r["run_id"], r["cluster_id"]) for r in spark.read.parquet(path).collect()] == [("r2", 1)]
    assert tuple(providers.token_usage(items).first()) == (2, 3, 5, 1)
    assert providers.label_run(targets.limit(0), scripted.KeywordLabeller(), path, "r3").count() == 0


def test_vectors_that_conflict_refuse_the_import(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "vector_id long, v array<float>").select("vector_id", sn.vector_bytes(F.col("v")).alias("original"))
    empty = spark.createDataFrame([], "vector_id long, sha string, transformation string")
    added = sn.added_vectors(rows, empty)
    got = {r["vector_id"]: [round(x, 4) for x in r["v"]] for r in added.select("vector_id", sn.vector_values(F.col("derived")).alias("v")).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: [1.0, 0.0]}
    assert sn.added_vectors(rows, added).isEmpty()
    with pytest.raises(ValueError, match="other bytes or normalization"):
        sn.added_vectors(rows, added, normalized=True)
    changed = added.withColumn("sha", F.when(F.col("vector_id") == 3, "x").otherwise(F.col("sha")))
    with pytest.raises(ValueError, match=r"\[3\]"):
        sn.added_vectors(rows, changed)


def test_metadata_is_merged_under_the_own(spark):
    rows = spark.createDataFrame([('{"b":{"y":1,"x":[2]},"a\\"q":null,"chunk":5}',), (None,), ("[1]",), ("bad",)], "m string")
    got = [r[0] for r in rows.select(sn.merged_metadata(F.col("m"), F.struct(F.lit(1).alias("n")))).collect()]
    assert got == ['{"a\\"q":null,"b":{"x":[2],"y":1},"chunk":{"n":1}}', '{"chunk":{"n":1}}', '{"chunk":{"n":1}}', '{"chunk":{"n":1}}']


def test_reconciliation_of_repeated_sides(spark):
    chunks = spark.createDataFrame([("a", "i", 1, "c", "p", "d", 0, "true"), ("b", "i", 1, "c", "p", "d", 1, "false"), ("b", "i", 9, "c", "q", "d", 0, None)], "external_id string, identity string, vector long, collection string, path string, document string, sequence int, active string")
    index = spark.createDataFrame([(1, "i", "d", 0, "f"), (2, "i", "d", 1, "f"), (2, "i", "d", 1, "f")], "vector long, identity string, document string, sequence int, fingerprint string")
    manifest = spark.createDataFrame([(3, 3, 3)], "chunk_count int, vector_count int, document_count int")
    got = sorted(tuple(r) for r in sn.reconciled(chunks, index, manifest).where("problem <> 'identity'").collect())
    assert got == [
        ("chunk", "b", "active is not true or false"), ("chunk", "b", "external id repeats"), ("chunk", "b", "unknown vector"),
        ("manifest", "document_count", "says 3, has 2"), ("vector", "2", "unreferenced"), ("vector", "2", "vector id repeats"),
    ]


def test_focus_is_clustered_by_itself(spark, sf):
    """c12: every member of the topic, no one else, and the topic as parent."""
    found = registry.queries()["c12_focus_recluster"](spark, "/root/testdata/sf0.01").collect()
    want = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("label = 3").count()
    assert len(found) == len({r["record_id"] for r in found}) == want and {r["parent_cluster"] for r in found} == {3}
    sizes = {}
    for r in found:
        sizes[r["cluster_id"]] = sizes.get(r["cluster_id"], 0) + 1
    assert all(n >= 5 for c, n in sizes.items() if c != -1)


def test_documents_of_a_chunk_index_are_dealt_out_once(spark, sf, request):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, -1)  # as large tables are joined
    request.addfinalizer(lambda: spark.conf.unset(threshold))
    for name in ("j10_layered_joins", "m02_completeness", "m04_chunk_texts"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution()
        told = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        dealt = [x for x in told.split("\n\n") if re.match(r"\s*\(\d+\) Exchange", x)]
        assert len(dealt) >= 3 and sum("doc#" in x for x in dealt) <= 1, name


def test_fingerprints_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([("a", 0, "x"), ("b", 0, "x"), ("b", 1, "y")], "hash string, seq int, text string")

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch.assign(fingerprint=batch["text"])

    found = chunks.duplicates(rows.mapInPandas(counted, "hash string, seq int, text string, fingerprint string"))
    assert {tuple(r) for r in found.collect()} == {("x", "a", 0, "a", 0, 2), ("x", "b", 0, "a", 0, 2), ("y", "b", 1, "b", 1, 1)}
    assert seen.value == 3


def test_input_digest_follows_the_input(spark, sf):
    """a18: the same for the same population, another for one row less."""
    from tessera.operators import chunks as ck
    from tessera.plans.imports import population

    rows = population(spark, sf)
    one, again = ck.input_digest(rows).collect(), ck.input_digest(rows.repartition(3)).collect()
    assert one == again
    first = rows.select("hash_seq").orderBy("hash_seq").first()[0]
    assert ck.input_digest(rows.where(F.col("hash_seq") != first)).collect() != one


def test_noise_sample_is_a_sample_of_noise(spark, sf):
    """r08: noise records alone, no more than asked for, the same each time."""
    from tessera.operators import topics as tp
    from tessera.plans.fixture import members

    m = members(spark, sf)
    ids = [r["record_id"] for r in tp.noise_sample(m, 7).collect()]
    noise = {r["record_id"] for r in m.where("is_noise").collect()}
    assert len(ids) == len(set(ids)) == min(7, len(noise)) and set(ids) <= noise
    assert ids == [r["record_id"] for r in tp.noise_sample(m.repartition(5), 7).collect()]
    assert set(ids) != {r["record_id"] for r in tp.noise_sample(m, 7, seed=2).collect()}


def test_documents_are_checked_by_blocks_of_sequences(spark):
    """As a set in plain Python; nothing is counted distinct, for which each chunk was three rows."""
    runs = {
        "whole": range(200), "short": [0, 1], "gap": [*range(70), 71], "twice": [*range(130), 129], "far": [0, 1 << 40], "below": [-1, 0, 1], "low twice": [-65, -65, 0],
        "same bits": [0, 64, 128], "none": [None], "some none": [0, None], "late": [1, 2], "one": [0],
    }
    rows = [("c", path, s, "d", "t", 3 if path == "short" else len(seqs)) for path, seqs in runs.items() for s in seqs]
    rows += [("c", "title", 0, "d", None, 2), ("c", "title", 1, "d", "t", 2), ("c", "title too", 0, None, "d", 2), ("c", "title too", 1, "d", None, 2), ("c", "no title", 0, None, None, 2), ("c", "no title", 1, None, None, 2)]
    rows += [("b", "whole", 0, "d", "t", 1), ("c", "totals", 0, "d", "t", 1), ("c", "totals", 1, "d", "t", 2)]
    chunks = spark.createDataFrame(rows, "collection string, path string, sequence long, document string, title string, total_chunks int").repartition(5)

    def problem(of):
        seqs, total = [r[2] for r in of], max(r[5] for r in of)
        known = [s for s in seqs if s is not None]
        if len({r[3:] for r in of}) > 1:
            return "facts differ"
        if len(set(known)) < len(seqs):
            return "sequence repeats"
        return None if sorted(known) == list(range(total)) else "sequences"

    want = {key: problem([r for r in rows if r[:2] == key]) for key in {r[:2] for r in rows}}
    found = sn.checked_documents(chunks)
    assert {(r["collection"], r["path"]): r["problem"] for r in found.collect()} == want
    assert {want["c", p] for p in ("same bits", "gap", "short")} == {"sequences"} and want["c", "title too"] == "facts differ" and want["c", "no title"] is None
    assert "Expand" not in found._jdf.queryExecution().toString()
