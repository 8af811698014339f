"""The pipeline's stages, each against brute force on what it was given."""

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_dedup import brute_components  # noqa: E402

from tessera.session import stored, table  # noqa: E402

#: Names that operators use inside, or could.
CLASHING = ["_gone", "_sha", "_good", "_keep", "_text", "gone_id", "SHA", "keep", "node", "id", "text_key", "block", "spans"]


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    seen = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns[: len(columns)] == columns
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert set(seen[-1].items()) <= set(seen[-2].items())
    assert len(seen[1]) == len(seen[0])  # every text has letters
    squeezed = {}
    for i, t in sorted(seen[1].items()):
        squeezed.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t), i)
    assert set(seen[2]) == set(squeezed.values())
    classes = brute_components(sorted(seen[2].items()), 5, 80, 100)
    assert set(seen[3]) == {i for i, (_, c) in classes.items() if c == i}
    assert set(seen[4]) < set(seen[3])
    assert seen[5].keys() == seen[4].keys()
    assert docs.where("not round_trip or n_tokens <> size(token_ids)").count() == 0


def odd_documents(docs):
    """Rows of documents with null and repeated ids, repeated rows, odd texts, and columns of clashing names."""
    for i, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.lit(i))
    return docs


def test_odd_rows_through_all_stages(spark, sf):
    docs = table(spark, sf, "documents").where("lang = 'en'").orderBy("doc_id").limit(30)
    passage = " ".join(table(spark, sf, "benchmark").orderBy("item_id").first()["text"].split()[:14])
    clean, long = "a sentence of its own about rivers, mills and old stones in the valley", "word " * 30_000
    more = [(None, f"before it {passage} after it"), (None, clean), (7001, f"{passage} once more"), (7001, "another text under the same number, that is clean"), (7002, None), (7003, ""), (7004, "12 34 !"), (7005, "x " + clean), (7005, "x  " + clean), (7006, long)]
    rows = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long").select(docs.columns), allowMissingColumns=True)
    rows = stored(odd_documents(rows), "odd")
    out = rows
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, out, sf), name)
        assert out.columns[: len(rows.columns)] == rows.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] is None or r["doc_id"] >= 7000]
    assert sorted(got, key=str) == sorted([(None, clean), (7001, "another text under the same number, that is clean"), (7005, next(t for i, t in got if i == 7005)), (7006, long)], key=str)
    assert all(r[c] == i for r in out.collect() for i, c in enumerate(CLASHING))


def test_empty_and_label_free_tables_through_all_stages(spark, sf):
    docs = table(spark, sf, "documents")
    empty = odd_documents(docs.limit(0))
    unlabelled = stored(docs.withColumn("lang", F.lit(None).cast("string")), "unlabelled")
    with_letters = unlabelled.where(F.col("text").rlike(r"\p{L}")).count()
    for rows in (empty, unlabelled):
        out = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, out, sf), name)
            if name == "language_id" and rows is unlabelled:
                assert out.count() == with_letters
        assert out.columns[: len(rows.columns)] == rows.columns
        assert out.isEmpty() == (rows is empty)


def test_language_stage_drops_what_has_no_letters(spark, sf):
    docs = table(spark, sf, "documents")
    odd = docs.limit(3).select("doc_id", F.lit("12 -- 34").alias("text"), *docs.columns[2:])
    assert corpus_pipeline.known_language(spark, docs.unionByName(odd), sf).count() == docs.count()
