"""Queries of snapshot imports and of the chunk index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import chunks as ck
from tessera.operators import snapshot as sn
from tessera.plans.book import query
from tessera.sources import bundle
from tessera.session import fresh_path, table

#: Lines that one task checks: they shuffle as 11 bytes and are ten times as large in memory, so shuffled bytes say little.
_TASK_LINES = 250_000

CTES = """hist AS (
  SELECT CAST(doc_id AS VARCHAR) AS external_id, sha256(concat(source, lang)) AS version_hash, doc_id FROM documents WHERE doc_id % 10 <> 0
  UNION ALL SELECT CAST(doc_id AS VARCHAR), sha256(concat('back', lang)), doc_id FROM documents WHERE doc_id % 10 = 3),
cur AS (SELECT * FROM hist WHERE version_hash = (sha256(concat('x', 'y'))) OR doc_id % 10 <> 3 OR version_hash IN (SELECT sha256(concat(source, lang)) FROM documents d WHERE d.doc_id = hist.doc_id)),
snap AS (
  SELECT CAST(doc_id AS VARCHAR) AS external_id, doc_id, doc_id % 7 <> 0 AS active,
         sha256(concat(CASE WHEN doc_id % 10 = 2 THEN 'moved' WHEN doc_id % 10 = 3 THEN 'back' ELSE source END, lang)) AS version_hash
  FROM documents WHERE doc_id % 10 <> 1),
diff AS (
  SELECT coalesce(s.external_id, c.external_id) AS external_id,
         CASE WHEN s.external_id IS NULL THEN 'deleted' WHEN c.version_hash = s.version_hash THEN 'unchanged'
              WHEN c.external_id IS NULL AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.external_id = s.external_id AND h.version_hash = s.version_hash) THEN 'added' ELSE 'changed' END AS change,
         s.active, s.version_hash, s.doc_id
  FROM snap s FULL JOIN cur c ON c.external_id = s.external_id)"""


def _tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A history, in which every tenth document had a version before, and the next snapshot."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string").alias("external_id")
    old = d.where("doc_id % 10 <> 0").select(key, F.sha2(F.concat("source", "lang"), 256).alias("version_hash"), F.lit(True).alias("is_current"))
    before = d.where("doc_id % 10 = 3").select(key, F.sha2(F.concat(F.lit("back"), "lang"), 256), F.lit(False))
    history = old.union(before).select(
        "external_id",
        "version_hash",
        sn.record_id(F.lit("d1"), F.col("external_id"), F.col("version_hash")).alias("record_id"),
        "is_current",
        F.lit("import-1").alias("introduced_by"),
        F.when(~F.col("is_current"), F.lit("2024-01-01").cast("timestamp")).alias("superseded_at"),
    )
    k = F.col("doc_id") % 10
    name = F.when(k == 2, "moved").when(k == 3, "back").otherwise(F.col("source"))
    snap = d.where("doc_id % 10 <> 1").select(key, F.sha2(F.concat(name, "lang"), 256).alias("version_hash"), (F.col("doc_id") % 7 != 0).alias("active"), F.col("doc_id").alias("vector_id"))
    return history, snap


@query("u01_snapshot_diff", f"WITH {CTES} SELECT external_id, change FROM diff")
def u01(spark, sf_dir) -> DataFrame:
    return sn.difference(*_tables(spark, sf_dir)).select("external_id", "change")


@query("a10_change_counts", f"WITH {CTES} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (NOT active) AS inactive, count(*) FILTER (active) AS active FROM diff")
def a10(spark, sf_dir) -> DataFrame:
    return sn.change_counts(sn.difference(*_tables(spark, sf_dir)))


@query("j11_tombstones", f"WITH {CTES} SELECT external_id FROM cur WHERE external_id NOT IN (SELECT external_id FROM snap)")
def j11(spark, sf_dir) -> DataFrame:
    return sn.tombstones(*_tables(spark, sf_dir)).select("external_id")


@query("b07_history_applied", f"""WITH {CTES} SELECT external_id, version_hash, version_hash IN (SELECT version_hash FROM snap s WHERE s.external_id = a.external_id) AS is_current,
  introduced_by FROM (SELECT external_id, version_hash, 'import-1' AS introduced_by FROM hist UNION ALL SELECT s.external_id, s.version_hash, 'import-2' FROM snap s WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.external_id = s.external_id AND h.version_hash = s.version_hash)) a""")  # fmt: skip
def b07(spark, sf_dir) -> DataFrame:
    history, snap = _tables(spark, sf_dir)
    out = sn.applied(history, sn.difference(history, snap), "d1", "import-2", F.lit("2024-02-01").cast("timestamp"))
    return out.select("external_id", "version_hash", "is_current", "introduced_by")


@query("b07_admission", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'no-op' WHEN o_orderkey % 4 = 1 THEN 'rejected: other content under this export id' WHEN o_orderkey % 4 = 2 THEN 'rejected: not newer' ELSE 'apply' END AS verdict FROM orders""")
def b07a(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, dataset = F.col("o_orderkey") % 4, (F.col("o_custkey") % 50).alias("dataset")
    imports = o.select(dataset).distinct().select("dataset", F.lit("e1").alias("export_id"), F.lit("d1").alias("digest"), F.lit("2024-01-05").cast("timestamp").alias("exported_at"), F.lit("s").alias("source_id"))
    request = o.select(
        F.col("o_orderkey").alias("id"), dataset, F.when(k < 2, "e1").otherwise("e2").alias("export_id"), F.when(k == 0, "d1").otherwise("d2").alias("digest"),
        F.when(k == 2, F.lit("2024-01-04")).otherwise("2024-01-06").cast("timestamp").alias("exported_at"), F.lit("s").alias("source_id"),
    )
    return sn.admission(request, imports).select("id", "verdict")


@query("b08_chunk_records", """SELECT CAST(doc_id AS VARCHAR) AS record_key, source AS source_name, trim(text, ' ') AS customer_text, concat('{', CASE WHEN doc_id % 3 = 1 THEN concat('"a b":[1,null],"lang":"', lang, '",') ELSE '' END,
  '"chunk":{"collection":"', source, '","path":"', lang, '/', doc_id, '","sequence":0,"total_chunks":1}}') AS metadata FROM documents""")  # fmt: skip
def b08(spark, sf_dir) -> DataFrame:
    """A third of the chunks brings metadata, one of whose keys the record's own takes, and a third brings no object."""
    given = F.concat(F.lit('{"lang":"'), F.substring_index("path", "/", 1), F.lit('","chunk":7,"a b":[1,null]}'))
    k = F.col("vector_id") % 3
    chunks = _chunks(spark, sf_dir).withColumn("metadata", F.when(k == 1, given).when(k == 2, "[1]"))
    return sn.chunk_records(chunks).select("record_key", "source_name", "customer_text", "metadata")


def _chunks(spark, sf_dir) -> DataFrame:
    """Every document as one chunk of itself."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("external_id"),
        F.col("source").alias("collection"),
        F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"),
        F.sha2("text", 256).alias("document"),
        F.col("source").alias("title"),
        "text",
        F.lit(0).alias("start"),
        F.length("text").alias("end"),
        F.lit(0).alias("sequence"),
        F.lit(1).alias("total_chunks"),
        F.lit("2024-01-01").cast("timestamp").alias("modified_at"),
        F.col("doc_id").alias("vector_id"),
    )


@query("b09_vector_store", "SELECT vec_id AS vector_id, CASE WHEN vec_id % 4 = 0 THEN 'new' WHEN vec_id % 4 = 1 THEN 'known' ELSE 'conflict' END AS verdict, 'l2-normalize' AS transformation, round(3 * embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: 9.0 * x * x))), 4) AS first_value, len(embedding) * 4 AS bytes FROM embeddings")
def b09(spark, sf_dir) -> DataFrame:
    """Vectors of length 3; the store has a fourth of them, another with other bytes, and another as it came."""
    long = F.transform("embedding", lambda x: (x * 3).cast("float"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id"), sn.vector_bytes(long).alias("original"))
    k = F.col("vector_id") % 4
    store = v.where(k != 0).select("vector_id", F.when(k == 2, "other").otherwise(F.sha2("original", 256)).alias("sha"), F.when(k == 3, "none").otherwise("l2-normalize").alias("transformation"))
    found = sn.stored_vectors(v, store)
    return found.select("vector_id", "verdict", "transformation", F.round(F.get(sn.vector_values(F.col("derived")), F.lit(0)).cast("double"), 4).alias("first_value"), F.octet_length("derived").cast("long").alias("bytes"))


@query("b10_import_items", f"WITH {CTES} SELECT external_id, CASE WHEN active THEN 'active' ELSE 'inactive' END AS state, 'import-2' AS import_id FROM snap UNION ALL SELECT external_id, 'deleted', 'import-2' FROM cur WHERE external_id NOT IN (SELECT external_id FROM snap)")
def b10(spark, sf_dir) -> DataFrame:
    history, snap = _tables(spark, sf_dir)
    return sn.import_items(snap, sn.tombstones(history, snap), "import-2")


@query("b10_embedding_items", f"""WITH {CTES} SELECT 'run-1' AS run_id, external_id, sha256(concat('["space-1","', doc_id, '"]')) AS text_hash, 'imported' AS status FROM snap WHERE active""")
def b10e(spark, sf_dir) -> DataFrame:
    return sn.embedding_items(_tables(spark, sf_dir)[1], "space-1", "run-1")


@query("j05_provenance", """SELECT doc_id AS record_id, concat('i', CASE WHEN doc_id % 4 = 0 THEN 9 ELSE doc_id % 3 END) AS import_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 3 ELSE 9 END AS number FROM documents""")
def j05(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"))
    versions = d.select("record_id", F.concat(F.lit("i"), (F.col("record_id") % 3).cast("string")).alias("introduced_by"))
    imports = spark.range(10).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("import_id"), F.col("id").alias("number"))
    items = d.where("record_id % 4 = 0").select(F.lit("i9").alias("import_id"), "record_id")
    return sn.provenance(d, versions, imports, items, "i9").select("record_id", "import_id", "number")


@query("b01_manifests", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'embedding.distanceMetric' WHEN o_orderkey % 5 = 1 THEN 'exportedAt' WHEN o_orderkey % 5 = 2 THEN 'chunk_count,sourceIdentity' ELSE '' END AS errors FROM orders")
def b01(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey") % 5
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("chunk-bundle").alias("schema_name"), F.lit(1).alias("schema_version"), F.lit("float32-le").alias("dtype"),
        F.when(k == 0, "dot").otherwise("cosine").alias("metric"), F.lit("l2").alias("normalization"), F.lit("full").alias("mode"), F.lit("tombstone-absent").alias("deletion_policy"),
        F.lit(64).alias("dimensions"), F.when(k == 2, -1).otherwise(1).alias("chunk_count"), F.lit(1).alias("vector_count"), F.lit(1).alias("document_count"),
        F.when(k == 1, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00Z").alias("exported_at"),
        F.when(k == 2, F.array(F.lit("id"), F.lit("key"))).otherwise(F.array(F.lit("id"), F.lit("label"))).alias("identity_keys"),
    )
    return sn.checked_manifests(rows).select("id", F.array_join("errors", ",").alias("errors"))


def _written(spark, sf_dir) -> str:
    path = fresh_path(spark, "bundle")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id"), F.col("embedding").alias("vector"))
    bundle.write(_chunks(spark, sf_dir), vectors, path, "model-1")
    return path


@query("s02_bundle_source", "SELECT CAST(d.doc_id AS VARCHAR) AS external_id, d.doc_id AS vector_id, e.vec_id IS NOT NULL AS has_vector, round(e.embedding[1], 5) AS first_value FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def s02(spark, sf_dir) -> DataFrame:
    b = bundle.read(spark, _written(spark, sf_dir))
    rows = b.chunks.join(b.vectors.select("vector_id", "vector"), "vector_id", "left")
    return rows.select("external_id", "vector_id", F.col("vector").isNotNull().alias("has_vector"), F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("first_value"))


@query("b02_file_checksums", "SELECT 'vectors.f32' AS file, CAST(sum(4 * len(embedding)) AS BIGINT) AS bytes, 0 AS problems FROM embeddings UNION ALL SELECT 'gone.ndjson', NULL, 1")
def b02(spark, sf_dir) -> DataFrame:
    """Of the raw vectors, and of a file that is declared and isn't there."""
    path = _written(spark, sf_dir)
    sums = bundle.file_sums(spark, path)
    gone = spark.range(1).select(F.lit("gone.ndjson").alias("name"), F.lit("00").alias("sha256"), F.lit(1).cast("long").alias("bytes"))
    found = sn.checked_files(sums, sums.union(gone)).join(sums.select("name", "bytes"), "name", "left")
    top = F.substring_index("name", "/", 1).alias("file")
    return found.where("name like 'vectors.f32%' or name like 'gone%'").groupBy(top).agg(F.sum("bytes").alias("bytes"), F.count("problem").cast("int").alias("problems"))


@query("b03_vector_index", "SELECT count(*) AS vectors, CAST(count(*) FILTER (same > 1) AS INT) AS problems, true AS contiguous FROM (SELECT count(*) OVER (PARTITION BY d.text) AS same FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)")
def b03(spark, sf_dir) -> DataFrame:
    b = bundle.read(spark, _written(spark, sf_dir))
    found = sn.checked_vectors(b.vectors, "model-1", b.dims, True).agg(F.count(F.lit(1)).alias("vectors"), F.count("problem").cast("int").alias("problems"))
    return found.crossJoin(sn.offset_gaps(b.vectors, b.dims).select("contiguous"))


@query("b04_chunk_checks", "SELECT CAST(doc_id AS VARCHAR) AS external_id, CASE WHEN NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id) THEN 'unknown vector' WHEN doc_id % 5 = 0 THEN 'text differs' END AS problem FROM documents")
def b04(spark, sf_dir) -> DataFrame:
    c = _chunks(spark, sf_dir)
    sha = F.when(F.col("vector_id") % 5 == 0, "other").otherwise(F.sha2("text", 256))
    index = c.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id")), "vector_id").select("vector_id", "document", "sequence", sha.alias("text_sha"))
    return sn.checked_chunks(c, index)


@query("b05_document_checks", "SELECT path, CASE WHEN count(DISTINCT seq) < count(*) THEN 'sequence repeats' WHEN min(seq) <> 0 OR max(seq) <> count(*) - 1 THEN 'sequences' END AS problem FROM (SELECT l_orderkey AS path, l_linenumber - 1 + CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END AS seq FROM lineitem) GROUP BY path")
def b05(spark, sf_dir) -> DataFrame:
    """Lines of great quantity are one place too far."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber") - 1 + (F.col("l_quantity") >= 45).cast("int")).alias("sequence"))
    dealt = rows.repartition(-(-rows.count() // _TASK_LINES) or 1, "path")  # the checks go by path too, so this is the only shuffle
    lines = dealt.withColumn("total_chunks", F.count(F.lit(1)).over(Window.partitionBy("path"))).select("*", F.lit("c").alias("collection"), F.lit("d").alias("document"), F.lit("t").alias("title"))
    return sn.checked_documents(lines).select("path", "problem")


@query("b05_reconciliation", """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'twice' ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents),
v AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT -1 - vec_id FROM embeddings WHERE vec_id % 50 = 0)
SELECT 'chunk' AS side, id, 'unknown vector' AS problem FROM c WHERE doc_id NOT IN (SELECT id FROM v)
UNION ALL SELECT 'chunk', id, 'identity' FROM c WHERE doc_id % 11 = 0 UNION ALL SELECT 'chunk', id, 'active is not true or false' FROM c WHERE doc_id % 13 = 0
UNION ALL SELECT 'chunk', id, 'external id repeats' FROM c GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'vector', CAST(id AS VARCHAR), 'unreferenced' FROM v WHERE id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'vector', CAST(id AS VARCHAR), 'identity' FROM v WHERE id % 9 = 5
UNION ALL SELECT 'manifest', 'vector_count', concat('says ', (SELECT count(*) FROM embeddings), ', has ', (SELECT count(*) FROM v)) WHERE (SELECT count(*) FROM embeddings) <> (SELECT count(*) FROM v)
UNION ALL SELECT 'manifest', 'document_count', concat('says nothing, has ', (SELECT count(*) FROM documents))""")  # fmt: skip
def b05r(spark, sf_dir) -> DataFrame:
    """Chunks of documents and vectors of embeddings, each with its faults; the manifest counts other vectors and no documents."""
    k, own = F.col("doc_id"), [F.col(c).cast("string") for c in ("collection", "path", "document", "sequence")]
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("collection"), F.concat_ws("/", "lang", k.cast("string")).alias("path"), F.sha2("text", 256).alias("document"), F.lit(0).alias("sequence"))
    chunks = d.select(
        F.when(k % 17 == 0, "twice").otherwise(k.cast("string")).alias("external_id"), F.when(k % 11 == 0, "other").otherwise(tx.identity_hash(F.lit("chunk"), *own)).alias("identity"),
        k.alias("vector"), "collection", "path", "document", "sequence", F.when(k % 13 == 0, '"yes"').otherwise("true").alias("active"),
    )
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector"))
    v = e.where("vector % 7 <> 0").union(e.where("vector % 50 = 0").select(-1 - F.col("vector")))
    parts = [F.lit("d"), F.lit("0"), F.lit("model-1")]
    index = v.select("vector", F.when(F.col("vector") % 9 == 5, "other").otherwise(tx.identity_hash(F.lit("vector"), *parts)).alias("identity"), F.lit("d").alias("document"), F.lit(0).alias("sequence"), F.lit("model-1").alias("fingerprint"))
    manifest = d.agg(F.count(F.lit(1)).alias("chunk_count")).crossJoin(e.agg(F.count(F.lit(1)).alias("vector_count"))).withColumn("document_count", F.lit(None).cast("long"))
    return sn.reconciled(chunks, index, manifest)


# the chunk index: documents as content, slices of 400 characters as chunks

INDEX = """docs AS (SELECT doc_id, source AS collection, sha256(text) AS hash, doc_id % 9 <> 0 AS active, text FROM documents),
content AS (SELECT DISTINCT hash, text AS doc FROM docs),
pieces AS (
  SELECT hash, unnest(range(0, greatest(1, (length(doc) + 399) // 400))) AS seq, greatest(1, (length(doc) + 399) // 400) AS total_chunks, doc FROM content),
pop AS (
  SELECT p.hash, p.seq, p.seq * 400 AS pos, least(400, length(p.doc) - p.seq * 400) AS chunk_len, p.total_chunks, p.doc
  FROM pieces p WHERE p.hash IN (SELECT hash FROM docs WHERE active AND collection <> 'src1'))"""


def _index(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("collection"), F.sha2("text", 256).alias("hash"), (F.col("doc_id") % 9 != 0).alias("active"), "text")
    content = d.select("hash", F.col("text").alias("doc")).dropDuplicates(["hash"])
    lengths = d.select("hash", F.length("text").alias("_len")).dropDuplicates(["hash"])  # no texts
    n = F.greatest(F.lit(1), F.ceil(F.col("_len") / 400)).cast("int")
    pieces = lengths.select("hash", "_len", n.alias("total_chunks"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    pieces = pieces.select("hash", "seq", (F.col("seq") * 400).alias("pos"), F.least(F.lit(400), F.col("_len") - F.col("seq") * 400).alias("chunk_len"), "total_chunks")
    value = F.array(F.col("seq").cast("float"), F.lit(1.0).cast("float"))
    vectors = pieces.select(F.concat_ws("_", "hash", F.col("seq").cast("string")).alias("hash_seq"), value.alias("embedding"))
    collections = [f"src{i}" for i in range(100) if i != 1]
    return d, content, pieces, vectors, collections


def population(spark, sf_dir) -> DataFrame:
    d, content, pieces, vectors, collections = _index(spark, sf_dir)
    return ck.population(d, content, pieces, vectors, collections)


_POP = f"WITH {INDEX} "


@query("m01_population", _POP + "SELECT hash, seq, pos, chunk_len FROM pop")
def m01(spark, sf_dir) -> DataFrame:
    return population(spark, sf_dir).select("hash", *(F.col(c).cast("long").alias(c) for c in ("seq", "pos", "chunk_len")))


query("s03_chunk_index_source", _POP + "SELECT hash, seq, concat(hash, '_', seq) AS hash_seq FROM pop")(
    lambda spark, sf_dir: population(spark, sf_dir).select("hash", F.col("seq").cast("long").alias("seq"), "hash_seq")
)


@query("f09_collection_list", _POP + "SELECT DISTINCT hash FROM docs WHERE active AND collection IN ('src2', 'src3')")
def f09(spark, sf_dir) -> DataFrame:
    d, content, pieces, vectors, _ = _index(spark, sf_dir)
    return ck.population(d, content, pieces, vectors, ["src2", "src3"]).select("hash").distinct()


@query("j10_layered_joins", _POP + "SELECT hash, count(*) AS chunks, count(DISTINCT doc) AS docs FROM pop GROUP BY hash")
def j10(spark, sf_dir) -> DataFrame:
    return population(spark, sf_dir).groupBy("hash").agg(F.count("hash_seq").alias("chunks"), F.countDistinct("doc").alias("docs"))


@query("m02_completeness", _POP + "SELECT hash, CASE WHEN substring(hash, 1, 1) = 'a' AND max(total_chunks) > 1 THEN 'sequences' ELSE 'no vector' END AS problem FROM pop WHERE (substring(hash, 1, 1) = 'a' AND total_chunks > 1) OR substring(hash, 1, 1) = 'b' GROUP BY hash")
def m02(spark, sf_dir) -> DataFrame:
    d, content, pieces, vectors, collections = _index(spark, sf_dir)
    pieces = pieces.where("not (hash like 'a%' and seq = 0 and total_chunks > 1)")
    return ck.incomplete(ck.population(d, content, pieces, vectors.where("hash_seq not like 'b%'"), collections))


@query("m03_vector_checks", _POP + "SELECT count(DISTINCT CASE WHEN hash LIKE 'e%' THEN 3 ELSE 2 END) AS dims, count(*) FILTER (hash LIKE 'c%') AS not_finite, count(*) FILTER (hash LIKE 'd%') AS zero FROM pop")
def m03(spark, sf_dir) -> DataFrame:
    """Vectors of some hashes are broken in one way each."""
    d, content, pieces, vectors, collections = _index(spark, sf_dir)
    broken = F.when(F.col("hash_seq").startswith("c"), F.array(F.lit(float("nan")), F.lit(1.0))).when(F.col("hash_seq").startswith("d"), F.array(F.lit(0.0), F.lit(0.0)))
    broken = F.coalesce(broken.when(F.col("hash_seq").startswith("e"), F.array(*map(F.lit, (1.0, 2.0, 3.0)))).cast("array<float>"), "embedding")
    return ck.vector_problems(ck.population(d, content, pieces, vectors.withColumn("embedding", broken), collections))


@query("m04_chunk_texts", _POP + "SELECT hash, seq, sha256(substring(doc, CAST(pos + 1 AS BIGINT), CAST(chunk_len AS BIGINT))) AS fingerprint FROM pop WHERE chunk_len > 0")
def m04(spark, sf_dir) -> DataFrame:
    return ck.texts(population(spark, sf_dir)).where("chunk_len > 0").select("hash", F.col("seq").cast("long").alias("seq"), "fingerprint")


@query("m05_text_duplicates", _POP + """, f AS (SELECT hash, seq, sha256(substring(doc, CAST(pos + 1 AS BIGINT), CAST(chunk_len AS BIGINT))) AS fingerprint FROM pop)
SELECT fingerprint, hash, seq, first_value(hash) OVER w AS canonical_hash, first_value(seq) OVER w AS canonical_seq, count(*) OVER (PARTITION BY fingerprint) AS copies FROM f WINDOW w AS (PARTITION BY fingerprint ORDER BY hash, seq)""")  # fmt: skip
def m05(spark, sf_dir) -> DataFrame:
    found = ck.duplicates(ck.texts(population(spark, sf_dir)))
    return found.select("fingerprint", "hash", F.col("seq").cast("long").alias("seq"), "canonical_hash", F.col("canonical_seq").cast("long").alias("canonical_seq"), "copies")


@query("a18_input_digest")
def a18(spark, sf_dir) -> DataFrame:
    return ck.input_digest(population(spark, sf_dir))
