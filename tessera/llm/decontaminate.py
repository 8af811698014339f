"""Benchmark decontamination with an FM-index for each training shard.

A shard holds the runs of words that a benchmark window could lie in: every occurrence of
a window lies in a run of words that all occur in the benchmark, as long as the shortest
window at least, so nothing else has to be indexed. All windows are searched backward
through wavelet-matrix ranks, their occurrences located by sampled suffix positions, and
the spans found are merged for each document.

The benchmark lies in the shared folder in blocks that a worker holds one at a time. Where
it takes more than one, passages of it are left out first of which no window's hash is
among those of the documents, so that shards go through what may occur and not through all.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyarrow.parquet import ParquetFile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, as_bytes, lean, parts_of, slices, with_row_key
from tessera.llm.fm_index import FMIndex
from tessera.session import fresh_path
from tessera.sources import files

#: Words of a window.
WINDOW = 10
#: Words that one index takes on, and occurrences located at once.
SHARD_WORDS, LOCATE_ROWS = 1 << 20, 1 << 20
#: Text of a shard, which a worker holds while it goes through the benchmark's blocks.
SHARD_BYTES = 8 << 20
#: Benchmark text of a block. Blocks lie in the shared folder; a worker holds one at a time, the driver none.
BLOCK_BYTES = 16 << 20
#: Windows that a passage of an item begins, which is dealt to a block as a whole.
PASSAGE_WINDOWS = 1 << 10
#: The filter of window hashes: bits set for each, bits for each window, and bits at most; beyond that it only lets more through.
FILTER_PROBES, FILTER_RATE, FILTER_BITS = 6, 16, 1 << 30

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null has none."""
    return text.translate(_WORDS).split() if text else []


class Windows:
    """Distinct windows of a block of items, by length, and the items each belongs to."""

    def __init__(self, items: list[tuple[str, bytes | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        numbers = {name: i for i, name in enumerate(self.names)}
        tokens: dict[int, list[tuple[int, np.ndarray]]] = {}
        for name, text in items:
            words = words_of(text)
            if words:
                ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words))
                tokens.setdefault(min(len(ids), width), []).append((numbers[name], ids))
        # for each length: the windows, and where each one's owners begin in the list of owners
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n, same in sorted(tokens.items()):
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, n) for _, ids in same])
            owner = np.repeat(np.array([i for i, _ in same], np.int32), [len(ids) - n + 1 for _, ids in same])
            order = np.lexsort((owner, *rows.T[::-1]))
            rows, owner = rows[order], owner[order]
            first = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
            pair = first | np.append(True, owner[1:] != owner[:-1])
            self.by_length.append((rows[first], np.append(np.flatnonzero(first[pair]), pair.sum()), owner[pair]))
        self.shortest = min(tokens, default=0)


def window_hashes(texts: list[bytes | None], lengths: list[int], memory: WordHashes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: it, the texts that the windows of as many words lie in, and the windows' hashes."""
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter(map(memory.__getitem__, chain.from_iterable(words)), np.uint64, sizes.sum())
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
    rolled = np.zeros(len(flat), np.uint64)
    for n in range(1, min(max(lengths), len(flat)) + 1):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled[: len(flat) - n + 1] += flat[n - 1 :]
        if n in lengths:
            inside = left >= n
            mixed = rolled[inside] + np.uint64(n)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            yield n, owner[inside], mixed ^ (mixed >> np.uint64(32))


class HashFilter:
    """Which window hashes a benchmark may have: bits in the shared folder, set by Spark and read by its workers."""

    def __init__(self, hashes: DataFrame, n: int, path: str):
        self.path = path
        self.bits = min(FILTER_BITS, 1 << max(6, (n * FILTER_RATE - 1).bit_length()))
        low, step = F.col("hash").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("hash", 32).bitwiseOR(1)
        probes = F.array(*((low + step * i).bitwiseAND(self.bits - 1) for i in range(FILTER_PROBES)))
        bit = hashes.select(F.explode(probes).alias("bit"))
        words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
        words.write.parquet(path)

    def load(self) -> np.ndarray:
        words = np.zeros(self.bits >> 6, np.uint64)
        for file in _parquet(self.path):
            for batch in file.iter_batches(columns=["word", "mask"]):
                words[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
        return words

    def passed(self, words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        low, step = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        for i in range(FILTER_PROBES):
            bit = (low + step * np.uint64(i)) & np.uint64(self.bits - 1)
            held = (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
            hashes, low, step = hashes[held], low[held], step[held]
        return hashes


def _parquet(path: str) -> Iterator[ParquetFile]:
    """Files of a folder that Spark wrote into the shared folder, which may be missing."""
    fs, folder = pafs.FileSystem.from_uri(path)
    for file in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if file.path.endswith(".parquet"):
            with fs.open_input_file(file.path) as stream:
                yield ParquetFile(stream)


class Shard:
    """The runs of some documents' words that go into one index."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.runs: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.offsets: list[np.ndarray] = []
        self.words = 0

    def add(self, first_doc: int, texts: list[bytes | None]) -> list[int]:
        """Takes documents in, numbered from first_doc; returns their numbers of words."""
        flat: list[bytes] = []
        starts, counts = [], []
        for text in texts:
            starts.append(len(flat))
            flat += words_of(text)
            counts.append(len(flat) - starts[-1])
            flat.append(b"")
        ids = np.fromiter(map(self.windows.vocabulary.get, flat, repeat(0)), np.int32, len(flat))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids > 0, [False]]).astype(np.int8)))
        first, last = edges[::2], edges[1::2]
        long = last - first >= max(1, self.windows.shortest)
        first, last = first[long], last[long]
        if len(first):
            sizes = last - first + 1  # with the end of the run, which may be any word outside
            at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            tokens = ids[at]
            tokens[np.cumsum(sizes) - 1] = 0
            doc = np.searchsorted(starts, first, side="right") - 1
            self.runs.append(tokens)
            self.owners.append(np.repeat(first_doc + doc, sizes))
            self.offsets.append(at - np.repeat(np.asarray(starts)[doc], sizes))
            self.words += len(tokens)
        return counts

    def found(self, spans: list[list[tuple[int, int]]], items: list[set[str]]) -> None:
        """Adds the word spans that windows cover, ends exclusive, and the items found to each document's."""
        if not self.runs:
            return
        seq, owner, offset = (np.concatenate(x) for x in (self.runs, self.owners, self.offsets))
        index = FMIndex(seq, len(self.windows.vocabulary))
        cover = np.zeros(len(seq) + 1, np.int64)
        for phrases, starts, names in self.windows.by_length:
            lo, hi = index.search(phrases)
            some = np.flatnonzero(hi > lo)
            for a, b in slices((hi - lo)[some].tolist(), LOCATE_ROWS):
                of = some[a:b]
                n = hi[of] - lo[of]
                rows = np.repeat(lo[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                at = index.locate(rows)
                cover += np.bincount(at, minlength=len(cover))
                cover -= np.bincount(at + phrases.shape[1], minlength=len(cover))
                hits = np.unique(owner[at] * len(phrases) + np.repeat(of, n))
                for doc, phrase in zip((hits // len(phrases)).tolist(), (hits % len(phrases)).tolist(), strict=True):
                    items[doc].update(self.windows.names[i] for i in names[starts[phrase] : starts[phrase + 1]])
        hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            start = int(offset[a])
            spans[owner[a]].append((start, start + b - a))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _passages(items: DataFrame, width: int) -> DataFrame:
    """The items' words in distinct passages that share width - 1 words with the next, so that each window lies in one."""
    step = PASSAGE_WINDOWS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 1):
                names, texts = [], []
                for name, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                    words = words_of(text)
                    for at in range(0, max(len(words) - width + 1, 1) if words else 0, step):
                        names.append(name)
                        texts.append(b" ".join(words[at : at + step + width - 1]))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["item", "passage"])

    return items.mapInArrow(lean(cut), "item string, passage binary").distinct().withColumn("key", F.xxhash64("item", "passage"))


def _occurring(passages: DataFrame, texts: DataFrame, width: int, folder: str) -> DataFrame:
    """The passages with a window whose hash is one of the texts' windows too: all that occur, and hardly another."""
    spark = passages.sparkSession

    def of_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            for part in parts_of(batch, 1):
                keys, held = part.column(0).to_numpy(), part.column(1).to_pylist()
                own = np.array([min(t.count(b" ") + 1, width) for t in held])
                for n, owner, hashes in window_hashes(held, list(range(1, width + 1)), memory):
                    mine = own[owner] == n
                    hashes = hashes[mine].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[owner[mine]]), pa.array(hashes), pa.array(np.full(len(hashes), n))], names=["key", "hash", "n"])

    passages.select("key", "passage").mapInArrow(lean(of_passages), "key long, hash long, n long").distinct().write.parquet(f"{folder}/hashes")
    known = spark.read.schema("key long, hash long, n long").parquet(f"{folder}/hashes")
    lengths = sorted(r[0] for r in known.select("n").distinct().collect())  # up to as many as a window has words
    if not lengths:
        return passages
    kept = HashFilter(known, known.count(), f"{folder}/filter")

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, bits = WordHashes(), kept.load()
        for batch in batches:
            for part in parts_of(batch, 0):
                for _, _, hashes in window_hashes(as_bytes(part.column(0)), lengths, memory):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(kept.passed(bits, hashes)).view(np.int64))], names=["hash"])

    seen = texts.mapInArrow(lean(of_texts), "hash long").distinct()
    return passages.join(known.join(seen, "hash", "left_semi").select("key").distinct(), "key", "left_semi")


class Blocks:
    """The benchmark's windows in the shared folder, block by block, written by Spark and read by its workers.

    Passages that no document can hold are left out where all of them would take more than one block.
    """

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, width: int, texts: DataFrame):
        spark = benchmark.sparkSession
        items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
        folder = fresh_path(spark, "benchmark")
        self.path = f"{folder}/blocks"

        def written(rows: DataFrame, name: str) -> DataFrame:
            rows.write.parquet(f"{folder}/{name}")
            return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

        def blocks(rows: DataFrame) -> int:
            return -(-(rows.agg(F.sum(F.octet_length("passage") + F.octet_length("item") + 64)).first()[0] or 0) // BLOCK_BYTES)

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            windows = Windows(list(zip(rows["item"], rows["passage"], strict=True)), width)
            return pd.DataFrame({"block": [rows["block"].iloc[0]], "data": [pickle.dumps(windows)]})

        passages = written(_passages(items, width), "passages")
        self.n = blocks(passages)
        if self.n > 1:
            passages = written(_occurring(passages, texts, width, folder), "occurring")
            self.n = blocks(passages)
        if self.n:
            dealt = passages.select("item", "passage", F.pmod("key", F.lit(self.n)).alias("block"))
            dealt.groupBy("block").applyInPandas(build, "block long, data binary").write.partitionBy("block").parquet(self.path)
        for name in ("passages", "hashes", "filter", "occurring"):
            files.remove(spark, f"{folder}/{name}")

    def __iter__(self) -> Iterator[Windows]:
        """Loads the blocks one after the other; a single one is kept for the next round."""
        if self.n == 1:
            if not hasattr(self, "only"):
                self.only = next(self._loaded())
            yield self.only
        else:
            yield from self._loaded()

    def _loaded(self) -> Iterator[Windows]:
        for block in range(self.n):
            for file in _parquet(f"{self.path}/block={block}"):  # a block that no passage was dealt has none
                for data in file.read(columns=["data"]).column("data"):
                    yield pickle.loads(data.as_py())


def _searched(batches: Iterator[pa.RecordBatch], text_at: int, blocks: Blocks) -> Iterator[tuple]:
    """(rows, numbers of words, merged spans, items) of each shard; rows as parts of the batches."""
    held: list[tuple[pa.RecordBatch, list[bytes | None]]] = []
    size = 0

    def searched() -> tuple:
        n = sum(len(texts) for _, texts in held)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items: list[set[str]] = [set() for _ in range(n)]
        counts: list[int] | None = None
        for windows in chain(blocks, repeat(Windows([], 1), 0 if blocks.n else 1)):
            shard, at, seen = Shard(windows), 0, []
            for _, texts in held:
                seen += shard.add(at, texts)
                at += len(texts)
                if shard.words >= SHARD_WORDS:
                    shard.found(spans, items)
                    shard = Shard(windows)
            shard.found(spans, items)
            counts = counts or seen
        return [rows for rows, _ in held], counts, [merged(x) for x in spans], items

    for batch in batches:
        for part in parts_of(batch, text_at):
            texts = as_bytes(part.column(text_at))
            held.append((part, texts))
            size += sum(len(t or b"") for t in texts)
            if size >= SHARD_BYTES:
                yield searched()
                held, size = [], 0
    if held:
        yield searched()


_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
) -> DataFrame:
    """One row per input row: id, n_words, spans (merged, in words, ends exclusive), items.

    A window is ``width`` consecutive words of an item; an item of fewer, but some, is one
    window; items without words or ids are ignored. Every occurrence of a window in a
    document is found. Null and wordless texts have no spans; an empty benchmark finds
    nothing. Items that repeat an id count as one item, rows that repeat an item as one row.
    Documents pass no shuffle: shards are cut from partitions as they are read, and a lost
    one is indexed again. A benchmark of more than one block has the documents read once
    before, for their windows' hashes; the search itself is one pass either way.
    """
    blocks = Blocks(benchmark, item_col, item_text_col, width, docs.select(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts, spans, items in _searched(batches, 1, blocks):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([r.column(0) for r in rows]),
                    pa.array(counts, pa.int64()),
                    pa.array([[{"first_word": a, "end_word": b} for a, b in x] for x in spans], _SPANS),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                names=["id", "n_words", "spans", "items"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "id long, n_words long, spans array<struct<first_word: long, end_word: long>>, items array<string>")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contamination() as counts and a digest of the items found."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end_word"] - x["first_word"])
    return contamination(docs, benchmark).select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows in which no window of the benchmark occurs, with all their columns.

    Rows go by a hash of id and text, so null and repeated ids are judged by their own texts,
    whatever the table's columns are called. Null and wordless texts stay; an empty benchmark
    drops nothing, an empty table stays empty.
    """
    marked, key = with_row_key(docs, id_col, text_col)
    hit = contamination(marked, benchmark, key, text_col).where(F.size("spans") > 0).select(F.col("id").alias(key))
    return marked.join(hit, key, "left_anti").drop(key)
