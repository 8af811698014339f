"""Embedding, summarising and labelling through providers, with content-addressed reuse.

A provider is any picklable object with ``run(texts) -> rows``. It is called in batches
inside mapInPandas, and only with texts that the cache does not have.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import stored

#: Kinds of text that are no support requests, and none.
JUNK_TYPES = ["none", "ooo", "vendor_pitch", "newsletter", "platform_notification", "other_non_support"]


def misses(texts: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct texts whose keys the cache does not have."""
    return texts.dropDuplicates(keys).join(cache.select(*keys).distinct(), keys, "left_anti")


def embedded(records: DataFrame, text: Column, cache: DataFrame, provider) -> tuple[DataFrame, DataFrame]:
    """(items, new cache rows). items: record_id, text_hash, status reused or embedded.

    cache: model, dims, text_hash, vector. New rows are written once before they are used, so
    a task that runs again does not ask the provider for rows of two kinds.
    """
    held = records.sparkSession.sparkContext.broadcast(provider)
    keyed = records.select("record_id", text.alias("text")).withColumn("text_hash", F.sha2("text", 256))
    own = cache.where((F.col("model") == provider.model) & (F.col("dims") == provider.dims)).select("text_hash")
    todo = misses(keyed.select("text_hash", "text"), own, ["text_hash"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"text_hash": rows["text_hash"], "vector": held.value.run(rows["text"].tolist())})

    made = todo.mapInPandas(run, "text_hash string, vector array<double>")
    fresh = stored(
        made.select(F.lit(provider.model).alias("model"), F.lit(provider.dims).alias("dims"), "text_hash", F.col("vector").cast("array<float>").alias("vector")),
        "vectors",
    )
    known = fresh.select("text_hash", F.lit("embedded").alias("status"))
    items = keyed.join(known, "text_hash", "left").select("record_id", "text_hash", F.coalesce("status", F.lit("reused")).alias("status"))
    return items, fresh


def summarised(records: DataFrame, text: Column, cache: DataFrame, provider, prompt_hash: str) -> tuple[DataFrame, DataFrame]:
    """(items, new cache rows). items: record_id, text_hash, status reused, summarized or failed.

    Each distinct text is asked for once; a text that fails does not stop the others. When every
    text that was asked for failed, and none was reused, the run fails.
    """
    held = records.sparkSession.sparkContext.broadcast(provider)
    keyed = records.select("record_id", text.alias("text")).withColumn("text_hash", F.sha2("text", 256))
    own = cache.where((F.col("model") == provider.model) & (F.col("prompt_hash") == prompt_hash)).select("text_hash")
    todo = misses(keyed.select("text_hash", "text"), own, ["text_hash"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, value in zip(rows["text_hash"], rows["text"], strict=True):
                try:
                    got = held.value.run([value])[0]
                    out.append((key, got["issue"], got["junk_type"], None))
                except Exception as e:  # one text's failure is that text's result
                    out.append((key, None, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["text_hash", "issue", "junk_type", "error"])

    made = stored(todo.mapInPandas(run, "text_hash string, issue string, junk_type string, error string"), "summaries")
    state = made.select("text_hash", F.when(F.col("error").isNull(), "summarized").otherwise("failed").alias("status"))
    items = keyed.join(state, "text_hash", "left").select("record_id", "text_hash", F.coalesce("status", F.lit("reused")).alias("status"))
    if not made.isEmpty() and items.where("status <> 'failed'").isEmpty():
        raise RuntimeError("every summary failed")
    fresh = made.where("error is null").select(F.lit(provider.model).alias("model"), F.lit(prompt_hash).alias("prompt_hash"), "text_hash", "issue", "junk_type")
    return items, fresh


def label_targets(representatives: DataFrame, records: DataFrame, summaries: DataFrame | None, k: int, source: str = "auto") -> DataFrame:
    """cluster_id, texts (in rank order), fallbacks: what a topic's label is made from.

    source raw takes customer_text; summary and auto take the summary, and fall back to
    customer_text where it is missing or empty.
    """
    rows = representatives.where(F.col("rank") <= k).join(records.select("record_id", "customer_text"), "record_id")
    if source == "raw" or summaries is None:
        rows = rows.withColumn("text", F.col("customer_text")).withColumn("fallback", F.lit(0))
    else:
        text = F.nullif("summary", F.lit(""))
        rows = rows.join(summaries.select("record_id", "summary"), "record_id", "left")
        rows = rows.withColumn("text", F.coalesce(text, "customer_text")).withColumn("fallback", text.isNull().cast("int"))
    return rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_t"), F.sum("fallback").alias("fallbacks")).select(
        "cluster_id", F.transform("_t", lambda x: x["text"]).alias("texts"), "fallbacks"
    )


def labelled(targets: DataFrame, provider) -> DataFrame:
    """cluster_id, label, coherent, error, prompt_tokens, completion_tokens: one call for each topic; one failure is one topic's.

    Tokens are the usage that the provider reports with its result, null where it reports none.
    """
    held = targets.sparkSession.sparkContext.broadcast(provider)
    names = ["cluster_id", "label", "coherent", "error", "prompt_tokens", "completion_tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, texts in zip(rows["cluster_id"], rows["texts"], strict=True):
                try:
                    got = held.value.run(list(texts))
                    usage = got.get("usage") or {}
                    out.append((key, got["label"], got["coherent"], None, usage.get("prompt_tokens"), usage.get("completion_tokens")))
                except Exception as e:
                    out.append((key, None, None, str(e)[:200], None, None))
            yield pd.DataFrame(out, columns=names).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    schema = "cluster_id long, label string, coherent boolean, error string, prompt_tokens long, completion_tokens long"
    return targets.select("cluster_id", "texts").mapInPandas(run, schema)


def label_run(targets: DataFrame, provider, path: str, run_id: str) -> DataFrame:
    """labelled(), once: labels are appended to path with run_id and created_at, and all items come back.

    A run whose every topic failed is an error and appends nothing.
    """
    items = stored(labelled(targets, provider), "labels")
    good = items.where("error is null")
    if not items.isEmpty() and good.isEmpty():
        failed = [r[0] for r in items.orderBy("cluster_id").select("cluster_id").limit(50).collect()]
        raise RuntimeError(f"every topic failed: {failed}")
    good.select(F.lit(run_id).alias("run_id"), "cluster_id", "label", "coherent", F.current_timestamp().alias("created_at")).write.mode("append").parquet(path)
    return items


def token_usage(items: DataFrame) -> DataFrame:
    """One row: prompt, completion and total tokens of all calls that reported them, and how many did."""
    prompt, completion = (F.coalesce(F.sum(c), F.lit(0)) for c in ("prompt_tokens", "completion_tokens"))
    return items.agg(prompt.alias("prompt"), completion.alias("completion"), (prompt + completion).alias("total"), F.count("prompt_tokens").alias("calls"))


def label_report(representatives: DataFrame, records: DataFrame, summaries: DataFrame | None, prompt: str, k: int = 10, limit: int = 500) -> DataFrame:
    """cluster_id, rank, record_id, block, truncated, from_summary, prompt_hash: what a label run showed of each representative."""
    rows = representatives.where(F.col("rank") <= k).join(records.select("record_id", "source_name", F.col("product").alias("title"), "customer_text"), "record_id")
    if summaries is None:
        rows = rows.withColumn("_s", F.lit(None).cast("string"))
    else:
        rows = rows.join(summaries.select("record_id", F.nullif("summary", F.lit("")).alias("_s")), "record_id", "left")
    text = F.coalesce("_s", "customer_text")
    block = representative_block(F.col("rank"), F.col("source_name"), F.col("title"), text, limit)
    return rows.select("cluster_id", "rank", "record_id", block.alias("block"), (F.length(text) > limit).alias("truncated"), F.col("_s").isNotNull().alias("from_summary"), F.sha2(F.lit(prompt), 256).alias("prompt_hash"))


def _kind(name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant"))


def _text(name: str) -> Column:
    return F.try_variant_get("_v", f"$.{name}", "string")


def checked_results(rows: DataFrame, required: list[str], optional: list[str], lists: list[str], json_col: str = "value", enums: dict | None = None, booleans: tuple = (), filled: tuple = ()) -> DataFrame:
    """rows with error (the first broken rule, or null) for a provider's JSON result."""
    allowed = [*required, *optional, *lists, *(enums or {}), *booleans]
    out = rows.withColumn("_v", F.try_parse_json(json_col))
    error = F.when(~F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)), "must be an object").when(
        F.size(F.array_except(F.json_object_keys(json_col), F.array(*map(F.lit, allowed)))) > 0, "unknown keys"
    )
    for n in required:
        error = error.when(~F.coalesce((_kind(n) == "STRING") & (F.trim(_text(n)) != ""), F.lit(False)), f"{n} must be a non-empty string")
    for n in optional:
        error = error.when(~F.coalesce(_kind(n), F.lit("VOID")).isin("STRING", "VOID"), f"{n} must be a string or null")
    for n in lists:
        phrases = F.try_variant_get("_v", f"$.{n}", "array<string>")
        some = F.exists(phrases, lambda p: F.trim(p) != "")
        error = error.when(~F.coalesce(_kind(n), F.lit("")).isin("ARRAY<STRING>", "ARRAY<VOID>"), f"{n} must be a list of strings")
        if n in filled:
            error = error.when(~F.coalesce(some, F.lit(False)), f"{n} must have an entry")
    for n, values in (enums or {}).items():
        error = error.when(~F.coalesce((_kind(n) == "STRING") & _text(n).isin(values), F.lit(False)), f"{n} is invalid")
    for n in booleans:
        error = error.when(F.coalesce(_kind(n), F.lit("")) != "BOOLEAN", f"{n} must be true or false")
    return out.withColumn("error", error).drop("_v")


def checked_summaries(rows: DataFrame, json_col: str = "value") -> DataFrame:
    return checked_results(rows, ["issue"], ["product", "desiredResolution", "sentiment"], ["keyCustomerPhrases"], json_col, {"junkType": JUNK_TYPES}, filled=("keyCustomerPhrases",))


def checked_labels(rows: DataFrame, json_col: str = "value") -> DataFrame:
    return checked_results(rows, ["label", "summary"], [], ["keySignals", "tags"], json_col, booleans=("coherent",))


def representative_block(rank: Column, source: Column, title: Column, text: Column, limit: int) -> Column:
    """Lines of one representative for a prompt, long texts cut."""
    cut = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)
    return F.concat_ws("\n", F.concat(F.lit("Record "), rank.cast("string")), F.concat(F.lit("Source: "), source), F.concat(F.lit("Title: "), title), F.concat(F.lit("Text: "), cut))
