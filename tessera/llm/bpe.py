"""Byte-level BPE encoding and decoding by a pair occurrence index.

Texts are cut into words by the tokenizer's pattern, and no merge reaches over a word's end.
The distinct words of a slice that the worker doesn't know yet stand one behind the other in
one array of symbols. An index maps each pair of neighbours that has a rank to all its
positions there. Active ranks are taken in ascending order: all occurrences of the pair are
merged, left to right, and the lists of the pairs that this makes are extended; entries
whose symbols have changed since are passed over. A merge's pair is always newer than its
parts, so no later step can bring back a lower rank, and all words come out as they would
one by one.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WordIds, as_bytes, lean, parts_of

MODEL = "byte_bpe_50k.json"
#: Symbols that one index covers, about, and memory of the words that a worker remembers.
INDEX_SYMBOLS, KNOWN_BYTES = 1 << 18, 128 << 20
#: Code points that Unicode gave letters and numbers after the version which these tokenizers know.
NEWER_LETTERS = (
    r"\x{558}\x{58b}-\x{58c}\x{88f}\x{c5c}\x{cdc}\x{208f}\x{209d}-\x{209f}\x{a7ce}-\x{a7cf}\x{a7d2}\x{a7d4}\x{a7dd}\x{a7e2}\x{a7f1}"
    r"\x{ab6c}-\x{ab6d}\x{107bb}-\x{107bf}\x{10940}-\x{10959}\x{10ec5}-\x{10ec7}\x{10ed9}-\x{10eee}\x{11b0a}\x{11db0}-\x{11ddb}\x{11df1}"
    r"\x{16ea0}-\x{16eb8}\x{16ebb}-\x{16ed3}\x{16ff2}-\x{16ff3}\x{187f8}-\x{187ff}\x{18cd6}-\x{18cda}\x{18d09}-\x{18d20}\x{18d80}-\x{18df2}"
    r"\x{18e00}-\x{19191}\x{191a0}-\x{191d2}\x{1b123}-\x{1b128}\x{1b168}\x{1d6a6}\x{1df1f}-\x{1df24}\x{1df2b}-\x{1df81}\x{1df90}-\x{1df96}"
    r"\x{1dfcd}-\x{1dfff}\x{1e6c0}-\x{1e6de}\x{1e6e0}-\x{1e6e2}\x{1e6e4}-\x{1e6e5}\x{1e6e7}-\x{1e6ed}\x{1e6f0}-\x{1e6f4}\x{1e6fe}-\x{1e6ff}"
    r"\x{2b73a}-\x{2b73f}\x{2b81e}\x{2cea2}-\x{2cead}\x{323b0}-\x{33479}\x{3d000}-\x{3fc3f}"
)
NEWER_NUMBERS = r"\x{11de0}-\x{11de9}\x{1246f}\x{12475}-\x{1247f}\x{12550}-\x{12686}\x{16ff4}-\x{16ff6}"
NEWER = f"[{NEWER_LETTERS}{NEWER_NUMBERS}]"


def word_pattern(known_only: bool) -> str:
    """The pattern of byte-level BPE; known_only: newer letters and numbers are signs, as these tokenizers see them."""
    letter, number, sign = r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"
    if known_only:
        newer = (NEWER_LETTERS + NEWER_NUMBERS).replace(r"\x{", "{").replace("}-{", "}-{")
        newer = regex.sub(r"\{([0-9a-f]+)\}", lambda m: rf"\U{int(m[1], 16):08x}", newer)
        letter, number, sign = rf"(?:(?![{newer}])\p{{L}})", rf"(?:(?![{newer}])\p{{N}})", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])"
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{sign}+|\s+(?!\S)|\s+"


@dataclass
class ByteModel:
    name: str  # digest of the file
    byte_ids: list[int]  # of the 256 bytes
    surface: list[bytes]  # what each id stands for
    left: list[int]  # by rank: the parts of a pair and what they become
    right: list[int]
    made: list[int]
    added: dict[str, int]  # texts that stand for themselves wherever they are

    def __post_init__(self):
        self.base = len(self.surface)
        self.ranks = {a * self.base + b: i for i, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        keys = np.array(self.left, np.int64) * self.base + np.array(self.right, np.int64)
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]


def byte_signs() -> list[str]:
    """The printable character that stands for each byte in the file: itself, or one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def load(path: str | None = None) -> ByteModel:
    """Reads a byte-level BPE file of the tokenizers library on the driver; executors get it by broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        data = f.read()
    spec = json.loads(data)
    model, pre = spec["model"], spec["pre_tokenizer"]
    plain = pre and pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    if not plain or odd or spec["normalizer"] or spec["post_processor"] or spec["decoder"]["type"] != "ByteLevel" or model["type"] != "BPE":
        raise ValueError("only plain byte-level BPE files can be read")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take their surroundings with them can't be read")
    ids, signs = model["vocab"], byte_signs()
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte_of = {c: b for b, c in enumerate(signs)}
    surface = [b""] * (1 + max([*ids.values(), *added.values()]))
    for token, at in ids.items():
        surface[at] = bytes(byte_of[c] for c in token)
    for token, at in added.items():
        surface[at] = token.encode()
    born: dict[str, int] = {c: -1 for c in signs}
    left, right, made = [], [], []
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        if a + b in born or max(born[a], born[b]) >= rank:
            raise ValueError("a merge makes a known token, or comes before its parts")
        born[a + b] = rank
        left.append(ids[a]), right.append(ids[b]), made.append(ids[a + b])
    return ByteModel(hashlib.sha256(data).hexdigest(), [ids[c] for c in signs], surface, left, right, made, added)


def merged(model: ByteModel, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, one behind the other, and how many each has, by one pair occurrence index."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    n, base, ranks = len(raw), model.base, model.ranks
    first = np.array(model.byte_ids, np.int64)[raw]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(n, bool)
    inner[starts] = False  # no pair ends at a word's first symbol
    keys = first[:-1] * base + first[1:]
    at = np.minimum(np.searchsorted(model.keys, keys), len(model.keys) - 1)
    live = np.flatnonzero((model.keys[at] == keys) & inner[1:])
    rank = model.by_key[at[live]]
    order = np.argsort(rank, kind="stable")
    found, cuts = np.unique(rank[order], return_index=True)
    places = {r: p.tolist() for r, p in zip(found.tolist(), np.split(live[order], cuts[1:]), strict=True)} if len(found) else {}
    # n stands for a word's border; a long word's arrays are compact
    kind: Callable = list if n <= 2 * INDEX_SYMBOLS else lambda x: array("q", x)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[np.append(starts[1:], n) - 1] = n
    before[starts] = n
    symbol, after, before = kind([*first.tolist(), -1] if kind is list else np.append(first, -1)), kind(after.tolist()), kind(before.tolist())
    active = list(places)
    heapify(active)
    while active:
        now = heappop(active)
        a, b, c = model.left[now], model.right[now], model.made[now]
        for p in sorted(places.pop(now)):
            q = after[p]
            if symbol[p] != a or q == n or symbol[q] != b:
                continue
            symbol[p], symbol[q] = c, -1
            t = after[p] = after[q]
            if t != n:
                before[t] = p
                new = ranks.get(c * base + symbol[t])
                if new is not None:
                    if new in places:
                        places[new].append(p)
                    else:
                        places[new] = [p]
                        heappush(active, new)
            s = before[p]
            if s != n:
                new = ranks.get(symbol[s] * base + c)
                if new is not None:
                    if new in places:
                        places[new].append(s)
                    else:
                        places[new] = [s]
                        heappush(active, new)
    out = np.array(symbol, np.int64)[:n]
    left = out >= 0
    return out[left], np.add.reduceat(left, starts, dtype=np.int64) if n else sizes


class TextEncoder:
    """Token ids of texts; short words that were seen keep their ids, up to KNOWN_BYTES of memory."""

    def __init__(self, model: ByteModel):
        self.model = model
        self.plain, self.exact = (regex.compile(word_pattern(x)).findall for x in (False, True))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(model.added, key=len, reverse=True))) + ")").split if model.added else None
        self.ids = WordIds(KNOWN_BYTES, model.added)

    def words(self, text: str, odd: bool) -> list[str]:
        find = self.exact if odd else self.plain
        if self.cut is None or not any(t in text for t in self.model.added):
            return find(text)
        parts = self.cut(text)  # added tokens stand at the odd places
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else find(part))]

    def _learn(self, fresh: list[str]) -> None:
        raw = [w.encode() for w in fresh]
        ends = np.cumsum([len(w) for w in raw]).tolist()
        tokens, sizes, lo = [], [], 0
        while lo < len(raw):
            hi = max(lo + 1, bisect_left(ends, (ends[lo - 1] if lo else 0) + INDEX_SYMBOLS))
            ids, counts = merged(self.model, raw[lo:hi])
            tokens.append(ids), sizes.append(counts)
            lo = hi
        self.ids.learn(fresh, np.concatenate(tokens), np.concatenate(sizes))

    def encode(self, texts: list[str | None], odd: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text behind the other, and the offsets of the texts; odd: texts with NEWER characters."""
        flat: list[str] = []
        counts = [0]
        for text, strange in zip(texts, odd, strict=True):
            if text:
                flat += self.words(text, strange)
            counts.append(len(flat))
        fresh = self.ids.unknown(flat)
        if fresh:
            self._learn(fresh)
        out, total = self.ids.of(flat)
        self.ids.trim(fresh)
        return out, total[counts]


_CODERS: dict[str, TextEncoder] = {}


def _coder(model: ByteModel) -> TextEncoder:
    """The worker's encoder for the model; what it remembers serves the tasks that follow."""
    if model.name not in _CODERS:
        _CODERS.clear()
        _CODERS[model.name] = TextEncoder(model)
    return _CODERS[model.name]


def decoded(model: ByteModel, ids: list[int]) -> str:
    """The text that the ids stand for, added tokens included; broken UTF-8 gets U+FFFD."""
    return b"".join(map(model.surface.__getitem__, ids)).decode("utf-8", "replace")


def _mapped(docs: DataFrame, model: ByteModel, text_col: str, new: list[T.StructField], make: Callable) -> DataFrame:
    """The rows with new columns, which ``make`` gets from the ids, the offsets and the number of rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in new]
    kept = [c for c in docs.columns if c.lower() not in names]
    rows, text_at = docs.select(*(docs[f"`{c}`"] for c in kept)), kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(held.value)
        for batch in batches:
            for part in parts_of(batch, text_at):
                odd = pc.fill_null(pc.match_substring_regex(part.column(text_at), NEWER), False).to_pylist()
                texts = [None if t is None else t.decode() for t in as_bytes(part.column(text_at))]
                ids, offsets = coder.encode(texts, odd)
                del texts
                yield pa.RecordBatch.from_arrays([*part.columns, *make(coder.model, ids, offsets)], names=[*kept, *names])

    return rows.mapInArrow(lean(run), T.StructType([*rows.schema.fields, *new]))


def _ids(model: ByteModel, ids: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(np.diff(offsets))]


def _digests(model: ByteModel, ids: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    packed, flat, ends = ids.astype("<u4"), ids.tolist(), offsets.tolist()
    spans = list(zip(ends, ends[1:], strict=False))
    of_ids = [hashlib.sha256(packed[a:b]).hexdigest() for a, b in spans]
    of_text = [hashlib.sha256(decoded(model, flat[a:b]).encode()).hexdigest() for a, b in spans]
    return [pa.array(np.diff(offsets)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]


def encoded(docs: DataFrame, model: ByteModel, text_col: str = "text") -> DataFrame:
    """The rows with token_ids and n_tokens behind their columns.

    Null and empty texts have no tokens. A text of any length is taken whole; repeated rows stay, an
    empty table stays empty. Columns of these two names, in any case of letters, are replaced.
    """
    new = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    return _mapped(docs, model, text_col, new, _ids)


def decoded_texts(rows: DataFrame, model: ByteModel, ids_col: str = "token_ids") -> DataFrame:
    """The rows with decoded behind their columns; null ids give null, a column of that name is replaced."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: None if x is None else decoded(held.value, x.tolist()))

    return rows.withColumn("decoded", text(F.col(ids_col)))


def digested(docs: DataFrame, model: ByteModel, text_col: str = "text") -> DataFrame:
    """encoded() and then decoded, with digests in place of ids and texts: n_tokens, ids_sha256, decoded_sha256.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the decoded text
    in UTF-8, both in lower-case hex. Odd rows are treated as by encoded().
    """
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, model, text_col, new, _digests)
