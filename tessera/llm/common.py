"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on: bounds a Python worker's memory.
SLICE_BYTES = 2 << 20


def unused(rows: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case of letters."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name


def with_row_key(rows: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """The rows with a 64-bit hash of id and text, and its column's name, which the table didn't have."""
    key = unused(rows, "row_key")
    return rows.withColumn(key, F.xxhash64(F.lit(1), F.col(id_col).cast("string"), F.lit(2), F.col(text_col))), key


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8 bytes, without decoding them."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def parts_of(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_BYTES of text, so that no more of it becomes Python objects at once."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    for lo, hi in slices(sizes):
        yield batch.slice(lo, hi - lo)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task function, which at its end gives back what Arrow holds unused: workers live on, and the next stage needs it."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return bounded


#: Bytes of the longest word that a worker remembers; text without spaces is one word.
KNOWN_WORD = 64
#: Memory of a remembered word besides its text: its object, its place in the table, what is known of it.
WORD_COST = 200


class WordHashes(dict):
    """64-bit hashes of words; short ones are remembered, up to a bound of memory."""

    def __init__(self, limit: int = 32 << 20):
        super().__init__()
        self.bound = limit // WORD_COST

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= KNOWN_WORD:
            if len(self) >= self.bound:
                self.clear()
            self[word] = h
        return h


class WordIds:
    """Token ids of distinct words, one behind the other; short words stay known, up to a bound of memory."""

    def __init__(self, limit: int, always: dict[str, int] | None = None):
        self.limit, self.always = limit, always or {}
        self.forget()

    def forget(self) -> None:
        """Only the words stay that always have the id given."""
        self.known = {w: i for i, w in enumerate(self.always)}
        self.held = 0
        self.sizes = np.ones(len(self.always), np.int64)
        self.starts = np.arange(len(self.always), dtype=np.int64)
        self.tokens = np.array(list(self.always.values()), np.int32)

    def unknown(self, words: list[str]) -> list[str]:
        return sorted(set(words) - self.known.keys())

    def learn(self, words: list[str], tokens: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.tokens, self.sizes = np.concatenate([self.tokens, tokens.astype(np.int32)]), np.concatenate([self.sizes, sizes])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.held += sum(map(len, words)) + WORD_COST * len(words)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, and where each word's begin and the last one's end."""
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.tokens[np.repeat(self.starts[at] - total[:-1], sizes) + np.arange(total[-1])], total

    def trim(self, learnt: list[str]) -> None:
        """Of the words learnt last the long ones go; all go where they take too much."""
        if self.held > self.limit:
            self.forget()
        elif any(len(w) > KNOWN_WORD for w in learnt):
            keep = len(self.sizes) - len(learnt)
            stay = [w for w in learnt if len(w) <= KNOWN_WORD]
            ids, ends = self.of(stay)
            for w in learnt:
                del self.known[w]
            self.held -= sum(map(len, learnt)) + WORD_COST * len(learnt)
            self.tokens, self.sizes = self.tokens[: int(self.sizes[:keep].sum())], self.sizes[:keep]
            self.learn(stay, ids, np.diff(ends))
