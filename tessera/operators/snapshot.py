"""Full-snapshot imports: bundle checks, differences, version history and provenance.

history: external_id, version_hash, record_id, is_current, introduced_by, superseded_at.
snapshot: external_id, version_hash, active.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import identity_hash
from tessera.session import stored


def record_id(dataset: Column, external_id: Column, version_hash: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.array(dataset, external_id, version_hash)), 256), 1, 32)


def difference(history: DataFrame, snapshot: DataFrame) -> DataFrame:
    """external_id, version_hash, active, old_hash, change: added, changed, unchanged or deleted.

    A version that was seen before and comes back is changed, also where nothing is current.
    """
    current = history.where("is_current").select(F.col("external_id").alias("_id"), F.col("version_hash").alias("old_hash"))
    seen = history.select("external_id", "version_hash", F.lit(True).alias("_seen")).distinct()
    both = snapshot.join(seen, ["external_id", "version_hash"], "left").join(current, F.col("external_id") == F.col("_id"), "full")
    change = (
        F.when(F.col("external_id").isNull(), "deleted")
        .when(F.col("old_hash") == F.col("version_hash"), "unchanged")
        .when(F.col("old_hash").isNull() & F.col("_seen").isNull(), "added")
        .otherwise("changed")
    )
    return both.select(F.coalesce("external_id", "_id").alias("external_id"), "version_hash", "active", "old_hash", change.alias("change"))


def change_counts(diff: DataFrame) -> DataFrame:
    """One row: added, changed, unchanged, deleted, and inactive and active rows of the snapshot besides."""
    kinds = (F.count_if(F.col("change") == k).alias(k) for k in ("added", "changed", "unchanged", "deleted"))
    here = F.col("change") != "deleted"
    return diff.agg(*kinds, F.count_if(here & ~F.col("active")).alias("inactive"), F.count_if(here & F.col("active")).alias("active"))


def tombstones(history: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Current versions that the snapshot doesn't have."""
    return history.where("is_current").join(snapshot.select("external_id"), "external_id", "left_anti")


def applied(history: DataFrame, diff: DataFrame, dataset: str, import_id: str, exported_at: Column) -> DataFrame:
    """The history after the import: old versions closed, new ones opened, revived ones opened again."""
    d = diff.select(F.col("external_id").alias("_id"), F.col("version_hash").alias("_hash"), "change")
    moved = history.join(d, F.col("external_id") == F.col("_id"), "left")
    revived = (F.col("change") == "changed") & (F.col("version_hash") == F.col("_hash"))
    closed = F.col("is_current") & F.col("change").isin("changed", "deleted") & ~F.coalesce(revived, F.lit(False))
    kept = moved.select(
        "external_id",
        "version_hash",
        "record_id",
        F.when(F.coalesce(revived, F.lit(False)), True).when(F.coalesce(closed, F.lit(False)), False).otherwise(F.col("is_current")).alias("is_current"),
        "introduced_by",
        F.when(F.coalesce(revived, F.lit(False)), F.lit(None)).when(F.coalesce(closed, F.lit(False)), exported_at).otherwise(F.col("superseded_at")).alias("superseded_at"),
    )
    fresh = diff.where("change in ('added', 'changed')").join(history.select("external_id", "version_hash"), ["external_id", "version_hash"], "left_anti")
    opened = fresh.select(
        "external_id",
        "version_hash",
        record_id(F.lit(dataset), F.col("external_id"), F.col("version_hash")).alias("record_id"),
        F.lit(True).alias("is_current"),
        F.lit(import_id).alias("introduced_by"),
        F.lit(None).cast("timestamp").alias("superseded_at"),
    )
    return kept.unionByName(opened)


def admission(request: DataFrame, imports: DataFrame) -> DataFrame:
    """request rows with verdict: no-op for the same export again, rejected for other bytes under its id or an older export, else apply.

    imports: dataset, export_id, digest, exported_at, source_id of earlier imports. An export
    that is recorded more than once is the same again if any of its records has the digest.
    """
    earlier = imports.groupBy("dataset").agg(F.max("exported_at").alias("_latest"), F.max_by("source_id", "exported_at").alias("_source"))
    wanted = request.select("dataset", "export_id", F.col("digest").alias("_wanted")).distinct()
    known = imports.join(wanted, ["dataset", "export_id"]).groupBy("dataset", "export_id", "_wanted").agg(F.max(F.col("digest") == F.col("_wanted")).alias("_same"))
    verdict = (
        F.when(F.col("_same"), "no-op")
        .when(F.col("_same").isNotNull(), "rejected: other content under this export id")
        .when(F.col("source_id") != F.col("_source"), "rejected: another source")
        .when(F.col("exported_at") <= F.col("_latest"), "rejected: not newer")
        .otherwise("apply")
    )
    rows = request.join(earlier, "dataset", "left").withColumn("_wanted", F.col("digest")).join(known, ["dataset", "export_id", "_wanted"], "left")
    return rows.withColumn("verdict", verdict).select(*request.columns, "verdict")


def merged_metadata(given: Column, own: Column) -> Column:
    """JSON text of the given JSON object's entries, keys in order, and the own struct under ``chunk``, which wins; null and what is no object give nothing."""
    entries = F.map_entries(F.coalesce(F.try_variant_get(F.try_parse_json(given), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    kept = F.array_sort(F.transform(F.filter(entries, lambda e: e["key"] != "chunk"), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("json"))))
    quoted = lambda text: F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)
    parts = F.transform(kept, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["json"]))
    return F.concat(F.lit("{"), F.array_join(F.array_append(parts, F.concat(F.lit('"chunk":'), F.to_json(own))), ","), F.lit("}"))


def chunk_records(chunks: DataFrame) -> DataFrame:
    """Records of chunks: key, source, title, text, timestamp and metadata as JSON.

    Where chunks bring metadata of their own, JSON text, it is merged in, see merged_metadata().
    """
    own = F.struct("collection", "path", "sequence", "total_chunks")
    metadata = merged_metadata(F.col("metadata"), own) if "metadata" in chunks.columns else F.to_json(own)
    return chunks.select(
        F.col("external_id").alias("record_key"),
        F.lit("memory").alias("source_type"),
        F.col("collection").alias("source_name"),
        F.col("external_id").alias("source_record_id"),
        F.col("title"),
        F.trim("text").alias("customer_text"),
        F.col("modified_at").alias("ts"),
        metadata.alias("metadata"),
    )


def provenance(records: DataFrame, versions: DataFrame, imports: DataFrame, items: DataFrame, selected: str | None) -> DataFrame:
    """Where each record came from: the selected import if it holds the record, else the one that introduced it."""
    picked = items.where(F.lit(selected is not None) & (F.col("import_id") == F.lit(selected))).select("record_id", F.col("import_id").alias("_picked"))
    rows = records.join(versions, "record_id").join(picked, "record_id", "left")
    rows = rows.withColumn("import_id", F.coalesce("_picked", "introduced_by")).drop("_picked", "introduced_by")
    return rows.join(imports, "import_id", "left")


def import_items(snapshot: DataFrame, gone: DataFrame, import_id: str) -> DataFrame:
    """external_id, state: active, inactive or deleted, for an import's ledger."""
    here = snapshot.select("external_id", F.when(F.col("active"), "active").otherwise("inactive").alias("state"))
    return here.union(gone.select("external_id", F.lit("deleted"))).withColumn("import_id", F.lit(import_id))


def embedding_items(snapshot: DataFrame, space: str, run_id: str) -> DataFrame:
    """Items of active chunks: run_id, external_id, text_hash (the vector's key in its space), status."""
    key = F.sha2(F.to_json(F.array(F.lit(space), F.col("vector_id").cast("string"))), 256)
    return snapshot.where("active").select(F.lit(run_id).alias("run_id"), "external_id", key.alias("text_hash"), F.lit("imported").alias("status"))


#: Keys of a manifest's identity, and the formats that are taken.
IDENTITY = ["id", "label", "metadata"]


def checked_manifests(manifests: DataFrame, schema: str = "chunk-bundle", version: int = 1) -> DataFrame:
    """manifests with errors, one row per bundle: names, versions, types, modes, counts and times.

    manifests: schema_name, schema_version, dtype, metric, normalization, mode, deletion_policy, dimensions,
    chunk_count, vector_count, document_count, exported_at (text), identity_keys (array).
    """

    def rule(bad: Column, name: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.lit(name))

    rules = [
        rule(F.col("schema_name") != schema, "schema.name"),
        rule(F.col("schema_version") != version, "schema.version"),
        rule(F.col("dtype") != "float32-le", "embedding.dtype"),
        rule(F.col("metric") != "cosine", "embedding.distanceMetric"),
        rule(~F.col("normalization").isin("l2", "none"), "embedding.normalization"),
        rule(F.col("mode") != "full", "snapshot.mode"),
        rule(F.col("deletion_policy") != "tombstone-absent", "snapshot.deletionPolicy"),
        rule(F.col("dimensions") <= 0, "embedding.dimensions"),
        *(rule(F.col(c) < 0, c) for c in ("chunk_count", "vector_count", "document_count")),
        rule(~F.col("exported_at").rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$") | F.try_to_timestamp("exported_at").isNull(), "exportedAt"),
        rule(F.size(F.array_except("identity_keys", F.array(*map(F.lit, IDENTITY)))) > 0, "sourceIdentity"),
    ]
    return manifests.withColumn("errors", F.filter(F.array(*rules), lambda e: e.isNotNull()))


def checked_files(files: DataFrame, declared: DataFrame) -> DataFrame:
    """name, problem: files against declared ones, both name, sha256, bytes; files that aren't declared are not looked at."""
    got = files.select("name", F.col("sha256").alias("_sha"), F.col("bytes").alias("_n"))
    problem = (
        F.when(F.col("_sha").isNull(), "missing").when(F.col("_n") != F.col("bytes"), "bytes").when(F.col("_sha") != F.col("sha256"), "sha256")
    )
    return declared.join(got, "name", "left").select("name", problem.alias("problem"))


def vector_values(payload: Column) -> Column:
    """Little-endian float32 bytes as an array."""
    import numpy as np

    @F.pandas_udf("array<float>")
    def values(data):
        return data.map(lambda b: None if b is None else np.frombuffer(bytes(b), "<f4"))

    return values(payload)


def vector_bytes(values: Column) -> Column:
    """Float arrays as little-endian float32 bytes."""
    import numpy as np

    @F.pandas_udf("binary")
    def packed(rows):
        return rows.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return packed(values)


def unit_bytes(payload: Column) -> Column:
    """Float32 bytes of a vector brought to unit length; the zero vector stays."""
    import numpy as np

    def unit(data: bytes) -> bytes:
        v = np.frombuffer(bytes(data), "<f4").astype(np.float64)
        return (v / (np.sqrt(v @ v) or 1.0)).astype("<f4").tobytes()

    @F.pandas_udf("binary")
    def units(data):
        return data.map(lambda b: None if b is None else unit(b))

    return units(payload)


def checked_vectors(index: DataFrame, fingerprint: str, dims: int, normalized: bool) -> DataFrame:
    """vector_id, problem (first that applies): index rows vector_id, document, sequence, fingerprint, offset, length, vector."""
    by = Window.partitionBy("vector_id")
    place = Window.partitionBy("document", "sequence")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    broken = F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    problem = (
        F.when(F.col("fingerprint") != fingerprint, "fingerprint")
        .when(F.count(F.lit(1)).over(by) > 1, "vector id repeats")
        .when(F.count(F.lit(1)).over(place) > 1, "document and sequence repeat")
        .when((F.col("length") != 4 * dims) | (F.size("vector") != dims), "length")
        .when((F.col("offset") % (4 * dims) != 0) | (F.col("offset") < 0), "offset")
        .when(broken, "not finite")
        .when(norm == 0, "zero norm")
        .when(F.lit(normalized) & (F.abs(norm - 1) > 1e-4), "not unit length")
    )
    return index.select("vector_id", problem.alias("problem"))


def offset_gaps(index: DataFrame, dims: int) -> DataFrame:
    """One row: rows, lowest and highest offset, distinct offsets, and whether they run from 0 without a gap."""
    found = index.agg(F.count(F.lit(1)).alias("rows"), F.min("offset").alias("lo"), F.max("offset").alias("hi"), F.countDistinct("offset").alias("distinct"))
    whole = (F.col("lo") == 0) & (F.col("hi") == (F.col("rows") - 1) * 4 * dims) & (F.col("distinct") == F.col("rows"))
    return found.withColumn("contiguous", whole)


def checked_chunks(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """external_id, problem: chunks against the vector index (vector_id, document, sequence, text_sha)."""
    v = index.select("vector_id", F.col("document").alias("_doc"), F.col("sequence").alias("_seq"), F.col("text_sha").alias("_sha"))
    problem = (
        F.when(F.col("_doc").isNull(), "unknown vector")
        .when((F.col("_doc") != F.col("document")) | (F.col("_seq") != F.col("sequence")), "vector of another chunk")
        .when(F.sha2("text", 256) != F.col("_sha"), "text differs")
        .when((F.col("start") < 0) | (F.col("end") < F.col("start")), "offsets")
        .when((F.col("sequence") < 0) | (F.col("sequence") >= F.col("total_chunks")), "sequence")
    )
    return chunks.join(v, "vector_id", "left").select("external_id", problem.alias("problem"))


def checked_documents(chunks: DataFrame) -> DataFrame:
    """collection, path, problem: facts that differ within a document, and sequences that are not 0 to total - 1.

    Sequences are told apart as bits, 64 in a row, so that what tasks hold of a document is a row for 64 chunks; rows of other facts
    are apart, where the document's problem is these facts anyway.
    """
    facts = ["document", "title", "total_chunks"]
    block, bit = F.expr("shiftright(cast(sequence as bigint), 6)"), F.expr("shiftleft(1L, cast(cast(sequence as bigint) & 63 as int))")
    blocks = chunks.groupBy("collection", "path", *facts, block.alias("_block")).agg(F.count(F.lit(1)).alias("_n"), F.bit_or(bit).alias("_bits"), F.min("sequence").alias("_lo"), F.max("sequence").alias("_hi"))
    found = blocks.groupBy("collection", "path").agg(
        F.sum("_n").alias("_n"),
        F.coalesce(F.sum(F.bit_count("_bits")), F.lit(0)).alias("_seqs"),
        F.min("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"),
        F.min(F.struct(*facts)).alias("_some"),
        F.max(F.struct(*facts)).alias("_other"),
        F.max("total_chunks").alias("_total"),
    )
    problem = (
        F.when(~F.col("_some").eqNullSafe(F.col("_other")), "facts differ")
        .when(F.col("_seqs") < F.col("_n"), "sequence repeats")
        .when((F.col("_lo") != 0) | (F.col("_hi") != F.col("_total") - 1) | (F.col("_n") != F.col("_total")), "sequences")
    )
    return found.select("collection", "path", problem.alias("problem"))


def stored_vectors(incoming: DataFrame, store: DataFrame, normalized: bool = False) -> DataFrame:
    """vector_id, original, sha, derived, transformation, verdict: new, known, or conflict where the id has other bytes or another transformation.

    derived is the original where vectors are declared to be of unit length, else brought to it, as float32 bytes; the zero vector stays.
    store: vector_id, sha, and transformation where it was kept.
    """
    unit = F.col("original") if normalized else unit_bytes(F.col("original"))
    change = "none" if normalized else "l2-normalize"
    rows = incoming.withColumn("sha", F.sha2("original", 256)).withColumn("derived", unit).withColumn("transformation", F.lit(change))
    before = F.col("transformation") if "transformation" in store.columns else F.lit(change)
    old = store.select("vector_id", F.col("sha").alias("_sha"), before.alias("_change"))
    same = (F.col("_sha") == F.col("sha")) & (F.col("_change") == change)
    verdict = F.when(F.col("_sha").isNull(), "new").when(same, "known").otherwise("conflict")
    return rows.join(old, "vector_id", "left").withColumn("verdict", verdict).drop("_sha", "_change")


def added_vectors(incoming: DataFrame, store: DataFrame, normalized: bool = False) -> DataFrame:
    """What an import appends to the store: its new vectors. One conflict refuses the import."""
    rows = stored(stored_vectors(incoming, store, normalized), "incoming-vectors")
    wrong = [r[0] for r in rows.where("verdict = 'conflict'").orderBy("vector_id").select("vector_id").limit(5).collect()]
    if wrong:
        raise ValueError(f"vectors were imported before with other bytes or normalization: {wrong}")
    return rows.where("verdict = 'new'").drop("verdict")


def reconciled(chunks: DataFrame, index: DataFrame, manifest: DataFrame) -> DataFrame:
    """side, id, problem: what chunks, vector index and manifest say against each other, in one pass over the first two.

    chunks: external_id, identity, vector, collection, path, document, sequence, active (JSON text). index: vector, identity,
    document, sequence, fingerprint. manifest, one row: chunk_count, vector_count, document_count. vector is
    the id that both sides name a vector by, identity the one that the content gives: of a chunk
    its collection, path, document and sequence, of a vector its document, sequence and fingerprint. An id may have several
    problems. A side's orphans are ``unknown vector`` (chunk) and ``unreferenced`` (vector).
    """
    text = lambda *names: [F.col(n).cast("string") for n in names]
    left = chunks.select(
        F.lit(1).alias("_c"), "external_id", F.col("vector").alias("_wants"), F.struct("collection", "path").alias("_doc"),
        (F.col("identity") != identity_hash(F.lit("chunk"), *text("collection", "path", "document", "sequence"))).alias("_cid"), (~F.coalesce("active", F.lit("")).isin("true", "false")).alias("_kind"),
    )
    right = index.select(F.lit(1).alias("_v"), F.col("vector").alias("_has"), (F.col("identity") != identity_hash(F.lit("vector"), *text("document", "sequence", "fingerprint"))).alias("_vid"))
    met = stored(left.join(right, F.col("_wants") == F.col("_has"), "full"), "reconciled")
    tell = lambda rows, side, at, problem: rows.select(F.lit(side).alias("side"), F.col(at).cast("string").alias("id"), F.lit(problem).alias("problem"))
    chunk, vector = met.where("_c = 1"), met.where("_v = 1")
    twice = lambda rows, at: rows.groupBy(at).count().where("count > 1")
    # a vector that several chunks name comes back as often
    vectors = vector.groupBy("_has").agg(F.max("_vid").alias("_vid"), F.max("_c").alias("_c"))
    found = [
        tell(chunk.where("_v is null"), "chunk", "external_id", "unknown vector"),
        tell(chunk.where("_cid"), "chunk", "external_id", "identity"),
        tell(chunk.where("_kind"), "chunk", "external_id", "active is not true or false"),
        tell(twice(chunk, "external_id"), "chunk", "external_id", "external id repeats"),
        tell(vectors.where("_c is null"), "vector", "_has", "unreferenced"),
        tell(vectors.where("_vid"), "vector", "_has", "identity"),
        tell(twice(right, "_has"), "vector", "_has", "vector id repeats"),
    ]
    counts = met.agg(F.count("_c").alias("chunk_count"), F.countDistinct("_doc").alias("document_count")).crossJoin(right.agg(F.count("_v").alias("vector_count")))  # one row each
    names = ("chunk_count", "vector_count", "document_count")
    said = manifest.select(*(F.col(n).alias(f"_{n}") for n in names)).crossJoin(counts)
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("id"), F.col(f"_{n}").cast("long").alias("said"), F.col(n).alias("found")) for n in names))).alias("x")
    wrong = said.select(sides).select("x.*").where("said is null or said <> found")
    found.append(wrong.select(F.lit("manifest").alias("side"), "id", F.format_string("says %s, has %s", F.coalesce(F.col("said").cast("string"), F.lit("nothing")), F.col("found").cast("string")).alias("problem")))
    return reduce(DataFrame.unionByName, found)
