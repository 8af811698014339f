"""Exact duplicates by content-defined chunk recipes, with built-in functions only.

A text is cut where its own characters say so, in any script, therefore equal passages are
cut alike wherever they stand. Chunks become identifiers, a document becomes the ordered list
of its identifiers, and only these short lists are moved and compared: a long text
is read once, where it lies.

An identifier is a 64-bit hash with the chunk's length, verified over the whole
corpus: where two chunks of one identifier have different SHA-256 digests, both take
their digests instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import unused
from tessera.session import stored

#: A chunk has at least MIN_CHUNK characters and ends where three characters stand again within
#: the next few, in scripts of thousands of characters one; without that it ends at MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 1024, 16384
_LARGE = r"\p{IsHan}\p{IsHangul}"
CUT = rf"(?:([^{_LARGE}]{{3}}).{{0,3}}\1|([{_LARGE}]).?\2)"
#: Copies of a repeated row that one array lists.
COPIES = 4096


def normalised(text: Column) -> Column:
    """Null counts as empty; every run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks(norm: Column) -> Column:
    """Content-defined chunks in order; the empty text has none."""
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?{CUT}|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of ``[\\x20\\x09-\\x0D]`` by one
    space. The smallest id of a group stays. Null counts as the empty text. Rows that
    repeat both id and text are members of their own: all count in group_size, one of
    them stays. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("_norm")).select(
        "doc_id",
        F.sha2("_norm", 256).alias("text_sha256"),
        F.transform(
            chunks(F.col("_norm")),
            lambda c: F.struct(
                F.xxhash64(c).alias("h"), F.length(c).alias("n"), F.unhex(F.sha2(c, 256)).alias("d")
            ),
        ).alias("_chunks"),
    )
    # repeated rows travel as one with a count; the table is a few hundredths of the texts
    rows = stored(
        rows.groupBy("doc_id", "text_sha256", "_chunks").agg(F.count(F.lit(1)).alias("_copies")), "recipes"
    )
    parts = rows.select("doc_id", "text_sha256", F.posexplode_outer("_chunks").alias("_pos", "_c")).select(
        "doc_id", "text_sha256", "_pos", "_c.h", "_c.n", "_c.d"
    )
    unlike = (
        parts.where("h is not null")
        .groupBy("h", "n")
        .agg(F.min("d").alias("_a"), F.max("d").alias("_b"))
        .where("_a <> _b")
        .select("h", "n", F.lit(True).alias("_unlike"))
    )
    recipes = (
        parts.join(unlike, ["h", "n"], "left")
        .withColumn(
            "_id",
            F.when(F.col("_unlike"), F.col("d")).otherwise(
                F.unhex(F.concat(F.lpad(F.hex("h"), 16, "0"), F.lpad(F.hex("n"), 8, "0")))
            ),
        )
        .groupBy("doc_id", "text_sha256")
        .agg(F.array_sort(F.collect_list(F.when(F.col("h").isNotNull(), F.struct("_pos", "_id")))).alias("_r"))
        .select("doc_id", "text_sha256", F.transform("_r", lambda x: x["_id"]).alias("recipe"))
    )
    counted = (
        rows.select("doc_id", "text_sha256", "_copies")
        .join(
            recipes.withColumnsRenamed({"doc_id": "_doc", "text_sha256": "_sha"}),
            F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_sha256") == F.col("_sha")),
        )
        .drop("_doc", "_sha")
    )
    groups = (
        counted.groupBy("recipe")
        .agg(F.min("doc_id").alias("keep_id"), F.sum("_copies").alias("group_size"))
        .where("group_size > 1")
    )
    found = (
        counted.join(groups, "recipe", "left")
        .select(
            "doc_id",
            F.coalesce("keep_id", "doc_id").alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            "text_sha256",
            "_copies",
            F.explode(F.sequence(F.lit(0), F.col("_copies") - 1, F.lit(COPIES))).alias("_from"),
        )
        .select("*", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + COPIES, "_copies") - 1)).alias("_copy"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 0))
    )
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whatever these are called.

    Rows go by id and text: where the table repeats an id with an equal text, one of these rows
    stays; rows with a null id group like others, and one of them stays only if no row of the
    group has an id. Null and empty texts are one group; an empty table stays empty. Texts move
    once, for the join; repeated rows, if there are any, once more.
    """
    found = stored(exact_duplicates(docs, id_col, text_col), "exact")
    sha, keep, kept_sha = (unused(docs, c) for c in ("sha", "keep", "kept_sha"))
    kept = found.where("kept").select(F.col("doc_id").alias(keep), F.col("text_sha256").alias(kept_sha))
    marked = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    same = F.col(id_col).eqNullSafe(F.col(keep)) & (F.col(sha) == F.col(kept_sha))
    out = marked.join(kept, same, "left_semi")
    if not found.where("not kept and doc_id <=> keep_id").isEmpty():
        out = out.dropDuplicates([id_col, sha])
    return out.drop(sha)
