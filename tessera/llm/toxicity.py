"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other text is unlabelled, a mixture that
holds toxic texts too. A linear classifier over the presence of words minimises

    prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])

with the logistic loss: where the corrected negative risk goes below zero, the step goes
against it (Kiryo et al. 2017). Features are the words and word beginnings that the
positives hold far more often than unlabelled text; the sample sizes below bound what is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import KNOWN_WORD, as_bytes, parts_of

#: Bounds of the training sample, in texts; the sample is drawn by a hash of the id.
POSITIVES, UNLABELLED = 4000, 16000
#: Features: in so many positives at least, which make up so much of the texts that have it, and at most so many.
LEAST_TEXTS, LEAST_SHARE, FEATURES = 4, 0.5, 2048
#: Characters of the word beginnings that are features besides whole words.
PREFIXES = range(3, 9)
#: Bounds of the share of toxic text that the risk is corrected by.
LEAST_PRIOR, MOST_PRIOR = 1e-3, 0.5
EPOCHS, BATCH, RATE, L2 = 40, 512, 0.05, 1e-4
#: Words whose features a worker remembers.
KNOWN_WORDS = 300_000

_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> set[bytes]:
    return set(text.translate(_WORDS).split()) if text else set()


def features_of(word: bytes) -> list[bytes]:
    """The word itself, and its beginnings, marked as such."""
    text = word.decode("utf-8", "ignore")
    return [word, *(text[:n].encode() + b"*" for n in PREFIXES if n < len(text))]


class Features(dict):
    """Word to the numbers of its features that the vocabulary holds."""

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = tuple(self.vocabulary[f] for f in features_of(word) if f in self.vocabulary)
        if len(word) <= KNOWN_WORD:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = found
        return found

    def of_words(self, words: set[bytes]) -> list[int]:
        return sorted({i for w in words for i in self[w]})


@dataclass
class ToxicityModel:
    vocabulary: dict[bytes, int]
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(rows)), sizes)
        z = self.bias + np.bincount(owner, self.weights[flat], len(rows))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def nonnegative_pu(pos: list[list[int]], unl: list[list[int]], n_features: int, prior: float, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear classifier; rows are lists of present features.

    Every feature was chosen for speaking for the positives, so no weight goes below zero.
    """
    rng = np.random.default_rng(seed)

    def dense(rows: list[list[int]]) -> np.ndarray:
        """Bytes of 0 and 1, made once: UNLABELLED + POSITIVES rows of FEATURES at most."""
        out = np.zeros((len(rows), n_features), np.uint8)
        for i, r in enumerate(rows):
            out[i, r] = 1
        return out

    all_pos, all_unl = dense(pos), dense(unl)
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    moment, square, t = np.zeros(n_features + 1), np.zeros(n_features + 1), 0
    half = BATCH // 2
    for _ in range(EPOCHS if pos and unl else 0):
        order = rng.permutation(len(unl))
        for lo in range(0, len(order), half):
            u = all_unl[order[lo : lo + half]].astype(np.float32)
            p = all_pos[rng.integers(0, len(pos), half)].astype(np.float32)
            fp, fu = p @ w + b, u @ w + b
            sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
            as_negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            gp, gu = -prior * (1 - sp) / len(p), np.zeros(len(u))
            if as_negative >= 0:
                gp, gu = gp - prior * sp / len(p), su / len(u)
            else:  # against the part that went below zero
                gp, gu = prior * sp / len(p), -su / len(u)
            g = np.append(p.T @ gp + u.T @ gu + L2 * w, gp.sum() + gu.sum())
            t += 1
            moment = 0.9 * moment + 0.1 * g
            square = 0.999 * square + 0.001 * g * g
            step = RATE * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
            w, b = np.maximum(w - step[:-1], 0), b - step[-1]
    return w, b


def calibrated(weights: np.ndarray, bias: float, pos: list[list[int]], unl: list[list[int]], prior: float) -> float:
    """The bias with which one half is the threshold of the best F1 that positives and unlabelled texts tell.

    Recall comes from the positives; the prior times recall, over the share of unlabelled
    texts found, is precision. A text without features always stays below one half.
    """

    def logits(rows: list[list[int]]) -> np.ndarray:
        return np.sort(np.array([bias + weights[r].sum() for r in rows]))

    f_pos, f_unl = logits(pos), logits(unl)
    cuts = np.unique(np.concatenate([f_pos, f_unl]))
    cuts = cuts[cuts > bias]
    if not len(cuts):
        return min(bias, -1e-6)
    recall = 1 - np.searchsorted(f_pos, cuts) / len(f_pos)
    found = 1 - np.searchsorted(f_unl, cuts) / len(f_unl)
    at = int((2 * prior * recall / (prior + found)).argmax())
    below = cuts[at - 1] if at else bias
    return bias - float(cuts[at] + below) / 2


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.binary())
    for batch in batches:
        for part in parts_of(batch, 0):
            words = [sorted(words_of(t)) for t in as_bytes(part.column(0))]
            marks = [sorted({f for w in ws for f in features_of(w)}) for ws in words]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(words, kind), pa.array(marks, kind)], ["positive", "words", "marks"])


def fit(labelled: DataFrame, unlabelled: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fits on at most POSITIVES texts with label 1 and UNLABELLED texts without regard to labels.

    The prior is the share of label 1 among the labelled rows, held between LEAST_PRIOR and
    MOST_PRIOR: outside these the corrected risk has nothing to correct. Without positives every
    score is LEAST_PRIOR.
    """
    counts = labelled.agg(
        F.count(label_col).alias("n"), F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0)).alias("pos")
    ).first()
    n, n_pos, n_unl = counts["n"] or 0, counts["pos"] or 0, unlabelled.count()
    prior = min(MOST_PRIOR, max(LEAST_PRIOR, n_pos / n)) if n else LEAST_PRIOR

    def drawn(rows: DataFrame, have: int, bound: int, seed: int) -> DataFrame:
        share = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) / 1_000_000
        return rows.where(share < min(1.0, bound / max(1, have)))

    sample = (
        drawn(labelled.where(F.col(label_col) == 1), n_pos, POSITIVES, 1)
        .select(text_col, F.lit(True).alias("positive"))
        .union(drawn(unlabelled, n_unl, UNLABELLED, 2).select(text_col, F.lit(False)))
        .mapInArrow(_words, "positive boolean, words array<binary>, marks array<binary>")
        .persist()
    )
    df = sample.select("positive", F.explode("marks").alias("word")).groupBy("word").agg(
        F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("u")
    )
    totals = {r[0]: r[1] for r in sample.groupBy("positive").count().collect()}
    pos_n, unl_n = totals.get(True, 0), totals.get(False, 0)
    lift = (F.col("p") / F.lit(max(1, pos_n))) / ((F.col("u") + 2) / F.lit(max(1, unl_n)))
    chosen = (
        df.where(F.col("p") >= LEAST_TEXTS)
        .withColumn("lift", lift)
        .where(F.col("lift") * prior >= LEAST_SHARE)
        .orderBy((F.col("p") * F.log("lift")).desc(), "word")
        .limit(FEATURES)
        .collect()
    )
    vocabulary = {bytes(r["word"]): i for i, r in enumerate(chosen)}
    held = labelled.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features(held.value)
        for batch in batches:
            rows = [known.of_words(set(words)) for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["positive", "features"])

    rows = sample.select("positive", "words").mapInArrow(encode, "positive boolean, features array<int>").collect()  # bounded by the sample
    sample.unpersist()
    rows.sort(key=lambda r: (r[0], r[1]))  # one result whatever the order of tasks
    pos, unl = [r[1] for r in rows if r[0]], [r[1] for r in rows if not r[0]]
    weights, bias = nonnegative_pu(pos, unl, len(vocabulary), prior)
    if pos and unl:
        bias = calibrated(weights, bias, pos, unl, prior)
    else:
        bias = float(np.log(prior / (1 - prior)))
    return ToxicityModel(vocabulary, weights, bias, prior)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score. Null, empty and wordless texts score as texts without any feature."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        known = Features(model.vocabulary)
        for batch in batches:
            for part in parts_of(batch, 1):
                rows = [known.of_words(words_of(t)) for t in as_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(rows))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are not learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit_on_documents(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns from documents that are not held out, and from the labels of those that have some."""
    open_docs = docs.where(~held_out()).select("doc_id", "text")
    known = labels.where(~held_out()).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return fit(open_docs.join(known, "doc_id"), open_docs)
