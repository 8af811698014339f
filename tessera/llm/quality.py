"""Quality selection by importance resampling.

Two generative models over hashed word n-grams, one of target text and one of raw text,
give every document the log ratio of its likelihoods; adding Gumbel noise and keeping the
k largest keys draws k documents without replacement in proportion to that ratio
(Xie et al. 2023, "Data selection for language models via importance resampling").
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, as_bytes, parts_of
from tessera.session import stored

BUCKETS = 10_000
#: Weight of one pseudo-count, shared over all buckets.
SMOOTHING = 1.0
#: Share of documents that the registered query draws.
SHARE = 0.5
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def hashed_ngrams(texts: list[bytes | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the text each belongs to."""
    words = [t.translate(_WORDS).split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    pairs = flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:]
    pairs = (pairs ^ (pairs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    same = owner[:-1] == owner[1:]
    buckets = np.concatenate([flat, pairs[same] >> np.uint64(20)]) % np.uint64(BUCKETS)
    return buckets.astype(np.int64), np.concatenate([owner, owner[:-1][same]])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of a partition's texts."""
    total = np.zeros(BUCKETS, np.int64)
    hashes = WordHashes()
    for batch in batches:
        for part in parts_of(batch, 0):
            total += np.bincount(hashed_ngrams(as_bytes(part.column(0)), hashes)[0], minlength=BUCKETS)
    (at,) = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def _model(texts: DataFrame) -> np.ndarray:
    """Counts of a generative model: BUCKETS sums reach the driver, whatever there is to count."""
    total = np.full(BUCKETS, SMOOTHING / BUCKETS)
    for bucket, n in texts.mapInArrow(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        total[bucket] += n
    return total


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, log_ratio, n_grams.

    ``target`` is the text of the target model, any table with ``text_col``; the raw model counts
    all rows of docs. log_ratio is the sum over the text's n-grams of log p(target) - log p(raw),
    the log of the ratio of its likelihoods; texts without words have 0, as has every text where
    the target has no words. Rows that repeat an id get the same noise and are drawn or left
    together.
    """
    spark = docs.sparkSession
    total = np.stack([_model(target.select(text_col)), _model(docs.select(text_col))])
    ratio = np.log(total[0] / total[0].sum()) - np.log(total[1] / total[1].sum())
    if total[0].sum() < 2 * SMOOTHING:
        ratio[:] = 0
    held = spark.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in parts_of(batch, 1):
                buckets, owner = hashed_ngrams(as_bytes(part.column(1)), hashes)
                n = np.bincount(owner, minlength=part.num_rows)
                ratios = np.bincount(owner, held.value[buckets], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ratios), pa.array(n)], ["id", "log_ratio", "n_grams"]
                )

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return keyed.mapInArrow(run, "id long, log_ratio double, n_grams long")


def gumbel_keys(scored: DataFrame, seed: int = 17, weight: float = 1.0) -> DataFrame:
    """Adds gumbel_key: the weighted log ratio and Gumbel noise drawn by a hash of seed and id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id")), 11).cast("double") + 0.5) / float(1 << 53)
    return scored.withColumn("gumbel_key", F.lit(weight) * F.col("log_ratio") - F.log(-F.log(u)))


def top_k(keyed: DataFrame, k: int, rounds: int = 12, bins: int = 4096) -> DataFrame:
    """Adds selected: whether the row is among the k largest keys; ties go to the smaller id.

    The k-th key is found by counting: each round keeps the bin that holds it, so nothing is
    sorted and only bin counts reach the driver.
    """
    lo, hi, n = keyed.agg(F.min("gumbel_key"), F.max("gumbel_key"), F.count("gumbel_key")).first()
    if k >= n or not n:
        return keyed.withColumn("selected", F.lit(True))
    if k <= 0:
        return keyed.withColumn("selected", F.lit(False))
    above = 0  # rows above hi, all selected
    for _ in range(rounds):
        if hi <= lo:
            break
        width = (hi - lo) / bins
        at = F.least(F.floor((F.col("gumbel_key") - lo) / width), F.lit(bins - 1))
        inside = F.col("gumbel_key").between(lo, hi)
        found = dict(tuple(r) for r in keyed.where(inside).groupBy(at.alias("b")).count().collect())
        for b in sorted(found, reverse=True):
            if above + found[b] >= k:
                break
            above += found[b]
        edges = keyed.where(inside & (at == b)).agg(F.min("gumbel_key"), F.max("gumbel_key")).first()
        lo, hi = edges[0], edges[1]
        if found[b] <= 1000:
            break
    left = keyed.where(F.col("gumbel_key").between(lo, hi)).orderBy(F.desc("gumbel_key"), "id")
    last = left.select("gumbel_key", "id").offset(k - above - 1).limit(1).first()  # of the rows of one bin, or equal keys
    ahead = (F.col("gumbel_key") > last[0]) | ((F.col("gumbel_key") == last[0]) & (F.col("id") <= last[1]))
    return keyed.withColumn("selected", ahead)


def resampled(docs: DataFrame, target: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """One row per input row: id, log_ratio, n_grams, gumbel_key, selected (k rows, or all if there are fewer)."""
    return top_k(stored(gumbel_keys(importance(docs, target, id_col, text_col), seed), "gumbel"), k)
