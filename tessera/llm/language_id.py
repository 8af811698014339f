"""Language identification of whole texts, with spans for texts of several languages.

A word's script narrows the languages that come into question; a hashed character n-gram
model scores the word under each of them; a Viterbi pass with a price for every switch
labels the words. A text's language is the one that most of its words were given.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lean, parts_of, with_row_key

#: Labelled texts that the model is fitted on, for each language.
TRAIN_PER_LANG = 3000
#: Hash buckets of character n-grams, and the n-grams' lengths.
BUCKETS, GRAMS = 1 << 15, (1, 2, 3, 4)
#: Nats that a change of language costs.
SWITCH = 6.0
#: A language comes into question for a script that holds this share of its training letters.
SCRIPT_SHARE = 0.02
#: Words that one Viterbi pass takes on, and words whose n-grams are held at once: they bound a worker's memory.
PASS_WORDS, GRAM_WORDS = 1_000_000, 50_000
UNDETERMINED = "und"

#: First code points of Unicode's script blocks; 0 stands for letters of no listed script.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, ""), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "odia"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, ""),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, ""), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3130, "hangul"), (0x3190, ""), (0x31F0, "kana"),
    (0x3200, ""), (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"),
    (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, ""), (0x20000, "han"), (0x32000, ""),
]
_STARTS = [s for s, _ in SCRIPTS]
_NAMES = sorted({n for _, n in SCRIPTS})
_WORD = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


_OF_BLOCK = [_NAMES.index(n) for _, n in SCRIPTS]


def script_of(word: str) -> int:
    """The script of most of its letters; of equal ones, that of the first."""
    if word.isascii():
        return _OF_BLOCK[0]
    found = [_OF_BLOCK[bisect_right(_STARTS, ord(c)) - 1] for c in word]
    return found[0] if len(set(found)) == 1 else max(found, key=found.count)


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word between marks, and the word each belongs to."""
    points = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.cumsum(points == 2) - 1
    buckets, owners = [], []
    for n in GRAMS:
        size = len(points) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint64)
        for j in range(n):
            h = (h ^ points[j : j + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = of[:size] == of[n - 1 :]
        buckets.append((h[inside] % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(of[:size][inside])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class LanguageModel:
    langs: list[str]
    logs: np.ndarray  # [languages, BUCKETS]
    allowed: np.ndarray  # [scripts, languages], True where the language uses the script

    def scores(self, words: list[str]) -> np.ndarray:
        """[languages, words]; the best is 0. A word is scored under the languages of its script alone; the others are ruled out.

        A script that no language uses leaves all of them in question.
        """
        out = np.full((len(self.langs), len(words)), -np.inf)
        scripts = np.fromiter(map(script_of, words), np.int64, len(words))
        for script in np.unique(scripts).tolist():
            every = np.flatnonzero(scripts == script)
            langs = np.flatnonzero(self.allowed[script] if self.allowed[script].any() else ~self.allowed[script]).tolist()
            for lo in range(0, len(every), GRAM_WORDS):
                at = every[lo : lo + GRAM_WORDS]
                buckets, owners = gram_buckets([words[i] for i in at.tolist()])
                for i in langs:
                    out[i, at] = np.bincount(owners, self.logs[i][buckets], len(at))
        return (out - out.max(axis=0)).astype(np.float32)


def fit(labelled: DataFrame, text_col: str, lang_col: str, key: Column, per_lang: int = TRAIN_PER_LANG) -> LanguageModel:
    """Counts n-grams on the executors; only languages x BUCKETS sums reach the driver. Rows without text or language teach nothing."""
    labelled = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], np.zeros((0, BUCKETS)), np.zeros((len(_NAMES), 0), bool))
    share = F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_lang / counts[k])))))
    dealt = F.pmod(F.xxhash64(key), F.lit(1_000_000)) / 1_000_000
    chosen = labelled.where(dealt < share[F.col(lang_col)]).select(text_col, lang_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(langs), BUCKETS), np.int64)
        scripts = np.zeros((len(langs), len(_NAMES)), np.int64)
        for batch in batches:
            for part in parts_of(batch, 0):
                by: dict[str, list[str]] = {}
                for t, k in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by.setdefault(k, []).extend(words_of(t))
                for k, words in by.items():
                    if words:
                        i = langs.index(k)
                        for at in range(0, len(words), GRAM_WORDS):
                            grams[i] += np.bincount(gram_buckets(words[at : at + GRAM_WORDS])[0], minlength=BUCKETS)
                        scripts[i] += np.bincount([script_of(w) for w in words], minlength=len(_NAMES))
        both = np.concatenate([grams, scripts], axis=1)
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(both[i, j])], ["i", "j", "n"]
        )

    sums = chosen.mapInArrow(lean(count), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((len(langs), BUCKETS + len(_NAMES)))
    for i, j, n in sums:
        both[i, j] = n
    grams, scripts = both[:, :BUCKETS] + 0.5, both[:, BUCKETS:]
    logs = np.log(grams / grams.sum(axis=1, keepdims=True))
    allowed = scripts.T >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1))
    return LanguageModel(langs, logs, allowed)


def viterbi(scores: np.ndarray, words: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every word, for many texts in step; longest texts first.

    scores: [labels, distinct words]; words: indices of all texts' words, one text behind
    the other. Ties stay in the label they are in, else the smallest label is taken.
    """
    n_labels = len(scores)
    order = np.argsort(-sizes, kind="stable")
    at = (np.cumsum(sizes) - sizes)[order]
    live = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
    best = np.zeros((n_labels, len(sizes)), np.float32)
    stays = np.zeros((-(-n_labels // 8), len(words)), np.uint8)
    froms = np.zeros(len(words), np.min_scalar_type(n_labels))
    for t, k in enumerate(live.tolist()):
        here, v = at[:k] + t, best[:, :k]
        top = v.argmax(axis=0)
        floor = v.max(axis=0) - np.float32(switch)
        stays[:, here] = np.packbits(v >= floor, axis=0)
        froms[here] = top
        np.maximum(v, floor, out=v)
        v += scores.take(words[here], axis=1)
    labels = np.zeros(len(words), froms.dtype)
    state = best.argmax(axis=0)
    for t in range(len(live) - 1, -1, -1):
        k = int(live[t])
        here, s = at[:k] + t, state[:k]
        labels[here] = s
        stay = stays[s >> 3, here] >> (7 - (s & 7)).astype(np.uint8) & 1
        state[:k] = np.where(stay, s, froms[here])
    return labels


def _labelled(model: LanguageModel, table: np.ndarray, words: np.ndarray, sizes: np.ndarray, switch: float) -> dict[str, pa.Array]:
    """lang_pred, score, n_words and spans of texts of so many words."""
    labels = viterbi(table, words, sizes, switch) if model.langs else np.zeros(0, np.int64)
    n_langs = max(1, len(model.langs))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    votes = np.bincount(owner * n_langs + labels, minlength=len(sizes) * n_langs).reshape(len(sizes), -1)
    share = votes.max(axis=1) / np.maximum(1, sizes)
    first = np.ones(len(labels), bool)
    first[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(first)
    span_owner = owner[starts]
    stops = np.append(starts[1:], len(labels))[: len(starts)]
    base = (ends - sizes)[span_owner]
    names = pa.array(model.langs, pa.string())
    spans = pa.StructArray.from_arrays(
        [pa.array((starts - base).astype(np.int32)), pa.array((stops - base).astype(np.int32)), names.take(pa.array(labels[starts].astype(np.int32)))],
        names=["first_word", "end_word", "lang"],
    )
    offsets = np.concatenate([[0], np.cumsum(np.bincount(span_owner, minlength=len(sizes)))]).astype(np.int32)
    some = sizes > 0
    pred = [model.langs[i] if ok else UNDETERMINED for i, ok in zip(votes.argmax(axis=1).tolist(), some.tolist(), strict=True)]
    return {
        "lang_pred": pa.array(pred, pa.string()),
        "score": pa.array(np.where(some, share, 0.0)),
        "n_words": pa.array(sizes),
        "spans": pa.ListArray.from_arrays(pa.array(offsets), spans),
    }


def _passes(batches: Iterator[pa.RecordBatch], text_at: int, model: LanguageModel, switch: float) -> Iterator[tuple[list[pa.RecordBatch], dict[str, pa.Array]]]:
    """Rows, as parts of the batches, and what _labelled() says of them, PASS_WORDS or so at a time."""
    held: list[pa.RecordBatch] = []
    parts: list[np.ndarray] = []
    sizes: list[int] = []
    known: dict[str, int] = {}
    tables: list[np.ndarray] = []

    def passed() -> dict[str, pa.Array]:
        words = np.concatenate(parts)
        table = np.concatenate(tables, axis=1) if tables else np.zeros((len(model.langs), 0), np.float32)
        return _labelled(model, table, words, np.array(sizes, np.int64), switch)

    for batch in batches:
        for part in parts_of(batch, text_at):
            flat: list[str] = []
            for text in part.column(text_at).to_pylist():
                words = words_of(text) if text and model.langs else []
                sizes.append(len(words))
                flat += words
            held.append(part)
            before = len(known)
            parts.append(np.fromiter((known.setdefault(w, len(known)) for w in flat), np.int32, len(flat)))
            if len(known) > before:
                tables.append(model.scores(list(known)[before:]))
            if sum(map(len, parts)) > PASS_WORDS:
                yield held, passed()
                held, parts, sizes, known, tables = [], [], [], {}, []
    if held:
        yield held, passed()


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """One row per input row: id, lang_pred, score, n_words, spans.

    Words are runs of letters. score is the share of words in the language named; spans are
    runs of words of one language, by word positions, the end exclusive. Null, empty and
    letterless texts, and every text under a model without languages, get ``und`` and 0.
    Ties go to the language that comes first by name.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _passes(batches, 1, held.value, switch):
            ids = pa.concat_arrays([r.column(0) for r in rows])
            yield pa.RecordBatch.from_arrays([ids, *found.values()], names=["id", *found])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        lean(run), "id long, lang_pred string, score double, n_words long, spans array<struct<first_word: int, end_word: int, lang: string>>"
    )


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit_on_documents(docs: DataFrame) -> LanguageModel:
    """Learns from text and lang of the rows that are not held out."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return fit(labelled.select("doc_id", "text", "lang"), "text", "lang", F.col("doc_id"))


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.0, text_col: str = "text", switch: float = SWITCH, id_col: str = "doc_id") -> DataFrame:
    """Rows in a known language, with all their columns: ``und`` goes, and texts whose score is below ``least``.

    Rows go by a hash of id and text, so null and repeated ids are judged by their own texts,
    whatever the table's columns are called. Under a model without languages nothing can be
    told apart: then only null and letterless texts go. An empty table stays empty.
    """
    if not model.langs:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    marked, key = with_row_key(docs, id_col, text_col)
    found = identify(marked, model, key, text_col, switch).where((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < least))
    return marked.join(found.select(F.col("id").alias(key)), key, "left_anti").drop(key)
