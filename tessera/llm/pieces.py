"""SentencePiece encoding and decoding by a Viterbi pass that words with a common prefix share.

A text becomes marked words: a run of marks (the model's sign for a space) and what follows
up to the next. No piece reaches over such a border, so words are encoded on their own.
The distinct words of a slice are sorted, which lists their trie depth-first, and the
forward values of a prefix are worked out once for all words that begin with it.

Unigram models score a path by the sum of its pieces' scores. A BPE model scores a path 0
if BPE leaves every two neighbours of it unmerged, and minus infinity otherwise; exactly
one path to each prefix is left, the one that merging by rank would give.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WordIds, as_bytes, lean, parts_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Memory of the words that a worker remembers, pairs of pieces that it does, and steps of its automaton.
KNOWN_BYTES, KNOWN_PAIRS, KNOWN_STEPS = 48 << 20, 400_000, 400_000


@dataclass
class PieceModel:
    bpe: bool
    dummy_prefix: bool
    ids: dict[str, int]
    scores: list[float]
    surface: list[bytes]  # what each id stands for
    byte_ids: list[int]  # of the 256 bytes; empty without byte fallback
    unknown: int
    name: str = ""  # digest of the model's file
    sizes: list[int] = field(default_factory=list)  # characters of each id
    borders: str = ""  # characters below U+0080 that are in no piece with others
    unknown_score: float = 0.0

    def __post_init__(self):
        joined = set()
        self.sizes = [1] * len(self.scores)
        for piece, at in self.ids.items():
            self.sizes[at] = len(piece)
            if len(piece) > 1:
                joined.update(piece)
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"{piece!r} reaches over a word's border")
        self.unknown_score = min(self.scores, default=0.0) - 10
        self.borders = "".join(c for c in map(chr, range(128)) if c not in joined)


def load(path: str = MODEL) -> PieceModel:
    """Reads a .model file on the driver; executors get it by broadcast."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        data = f.read()
    proto.ParseFromString(data)
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models that keep the text as it is can be decoded to the same text")
    normal, unknown_type, byte_type = 1, 2, 6
    pieces = proto.pieces
    ids = {p.piece: i for i, p in enumerate(pieces) if p.type == normal}
    byte_of = {int(p.piece[1:-1], 16): i for i, p in enumerate(pieces) if p.type == byte_type}
    surface = [
        p.piece.replace(MARK, " ").encode() if p.type == normal else bytes([int(p.piece[1:-1], 16)]) if p.type == byte_type else b""
        for p in pieces
    ]
    return PieceModel(
        proto.trainer_spec.model_type == 2,
        norm.add_dummy_prefix,
        ids,
        [p.score for p in pieces],
        surface,
        [byte_of[b] for b in range(256)] if len(byte_of) == 256 else [],
        next(i for i, p in enumerate(pieces) if p.type == unknown_type),
        hashlib.sha256(data).hexdigest(),
    )


def merged_by_rank(model: PieceModel, text: str) -> list[str]:
    """BPE as defined: the best-scored neighbours merge first, the leftmost of equals."""
    parts = list(text)
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            piece = model.ids.get(parts[i] + parts[i + 1])
            if piece is not None and (best is None or model.scores[piece] > best):
                best, at = model.scores[piece], i
        if best is None:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class WordEncoder:
    """Encodes sorted words; forward values stand for the current word's prefixes.

    A value is the number of the piece that ends the best path; characters that are no piece
    have numbers behind the pieces', and the empty prefix has the last one. Which pieces end at
    a character is read from an automaton over the pieces' beginnings, built as it is walked.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.n = len(model.scores)
        self.start = self.n + 0x110000
        self.pairs: dict[int, bool] = {}
        self.text = {i: p for p, i in model.ids.items()}
        self.word = ""
        self.last = [self.start]
        self.score = [0.0]
        self.prefixes = {p[:i] for p in model.ids for i in range(len(p) + 1)}
        self.nodes: dict[str, int] = {}
        self.names: list[str] = []
        self.next: list[dict[str, int]] = []
        self.ends: list[tuple[tuple[int, int], ...]] = []
        self.steps = 0
        self.at = [self._node("")]

    def _apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves two neighbours, or a first piece, as they are."""
        if len(self.pairs) >= KNOWN_PAIRS:
            self.pairs.clear()
        parts = [self.text[x] if x < self.n else chr(x - self.n) for x in (left, right) if x != self.start]
        known = self.pairs[left * (self.start + 1) + right] = merged_by_rank(self.model, "".join(parts)) == parts
        return known

    def _node(self, text: str) -> int:
        """The number of the longest end of the text that begins a piece, with the pieces that end it, longest first."""
        while text not in self.prefixes:
            text = text[1:]
        node = self.nodes.get(text)
        if node is None:
            node = self.nodes[text] = len(self.next)
            self.next.append({})
            self.names.append(text)
            tails = ((self.model.ids.get(text[i:]), len(text) - i) for i in range(len(text)))
            self.ends.append(tuple((piece, n) for piece, n in tails if piece is not None))
        return node

    def rest(self) -> None:
        """Lets go of the current word, and of the automaton where it has grown large."""
        self.word = ""
        del self.last[1:], self.score[1:], self.at[1:]
        if self.steps > KNOWN_STEPS:
            self.nodes, self.names, self.next, self.ends, self.steps = {}, [], [], [], 0
            self.at = [self._node("")]

    def _walk(self, word: str, common: int) -> None:
        """The nodes of the prefixes longer than ``common``."""
        at, moves = self.at, self.next
        node = at[-1]
        for c in word[common:]:
            to = moves[node].get(c)
            if to is None:
                to = moves[node][c] = self._node(self.names[node] + c)
                self.steps += 1
            node = to
            at.append(node)

    def _ranked(self, word: str, common: int) -> None:
        """BPE's forward values of the prefixes longer than ``common``."""
        last, ends, known = self.last, self.ends, self.pairs.get
        base = self.start + 1
        for i, node in enumerate(self.at[common + 1 :], common + 1):
            for piece, n in ends[node]:
                before = last[i - n]
                apart = known(before * base + piece)
                if apart or (apart is None and self._apart(before, piece)):
                    last.append(piece)
                    break
            else:  # a character that is no piece
                last.append(self.n + ord(word[i - 1]))

    def _scored(self, word: str, common: int) -> None:
        """Unigram forward values of the prefixes longer than ``common``: the best sum, and its last piece."""
        scores, values = self.model.scores, self.score
        for i, node in enumerate(self.at[common + 1 :], common + 1):
            best, end = values[i - 1] + self.model.unknown_score, self.n + ord(word[i - 1])
            for piece, n in self.ends[node]:
                if values[i - n] + scores[piece] > best:
                    best, end = values[i - n] + scores[piece], piece
            self.last.append(end)
            values.append(best)

    def encode(self, word: str) -> list[int]:
        common, most, old = 0, min(len(word), len(self.word)), self.word
        while common < most and word[common] == old[common]:
            common += 1
        del self.last[common + 1 :], self.score[common + 1 :], self.at[common + 1 :]
        self.word = word
        self._walk(word, common)
        if self.model.bpe:
            self._ranked(word, common)
        else:
            self._scored(word, common)
        out: list[int] = []
        i, last, size = len(word), self.last, self.model.sizes
        while i:
            at = last[i]
            if at < self.n:
                out.append(at)
                i -= size[at]
            else:
                raw = chr(at - self.n).encode()
                out += [self.model.byte_ids[b] for b in reversed(raw)] if self.model.byte_ids else [self.model.unknown]
                i -= 1
        out.reverse()
        return out


class TextEncoder:
    """Token ids of texts; short words that were seen keep their ids, up to KNOWN_BYTES of memory."""

    def __init__(self, model: PieceModel):
        self.model = model
        b = re.escape(model.borders)
        self.split = re.compile(f"{MARK}+[^{MARK}{b}]*|[^{MARK}{b}]+|[{b}]").findall
        self.words = WordEncoder(model)
        self.ids = WordIds(KNOWN_BYTES)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text behind the other, and the offsets of the texts."""
        flat: list[str] = []
        counts = [0]
        for text in texts:
            if text:
                flat += self.split((MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK))
            counts.append(len(flat))
        fresh = self.ids.unknown(flat)
        if fresh:
            ids = [self.words.encode(w) for w in fresh]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.ids.learn(fresh, np.fromiter((t for x in ids for t in x), np.int32, int(sizes.sum())), sizes)
        out, total = self.ids.of(flat)
        self.ids.trim(fresh)
        self.words.rest()
        return out, total[counts]


_CODERS: dict[str, TextEncoder] = {}


def _coder(model: PieceModel) -> TextEncoder:
    """The worker's encoder for the model; what it remembers serves the tasks that follow."""
    if model.name not in _CODERS:
        _CODERS.clear()
        _CODERS[model.name] = TextEncoder(model)
    return _CODERS[model.name]


def decoded(model: PieceModel, ids: list[int]) -> bytes:
    """UTF-8 of the text; the space that the dummy prefix stands for goes."""
    out = b"".join(map(model.surface.__getitem__, ids))
    return out[1:] if model.dummy_prefix and out[:1] == b" " else out


def encoded(docs: DataFrame, model: PieceModel, text_col: str = "text") -> DataFrame:
    """The rows with token_ids, n_tokens and round_trip behind their columns.

    round_trip says whether decoding gives the same text back, as it does unless the text
    holds the mark itself. Null and empty texts have no tokens. Columns of these three names,
    in any case of letters, are replaced; an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("token_ids", "n_tokens", "round_trip")]
    rows, text_at = docs.select(*(docs[f"`{c}`"] for c in kept)), kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        coder = _coder(model)
        for batch in batches:
            for part in parts_of(batch, text_at):
                raw = as_bytes(part.column(text_at))
                flat, offsets = coder.encode([None if t is None else t.decode() for t in raw])
                ends = offsets.tolist()
                ids = flat.tolist()
                same = [decoded(model, ids[a:b]) == (t or b"") for a, b, t in zip(ends, ends[1:], raw, strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)),
                        pa.array(np.diff(offsets).astype(np.int64)),
                        pa.array(same, pa.bool_()),
                    ],
                    names=[*kept, "token_ids", "n_tokens", "round_trip"],
                )

    schema = T.StructType([*rows.schema.fields])
    schema.add("token_ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("round_trip", "boolean")
    return rows.mapInArrow(lean(run), schema)


def decoded_texts(rows: DataFrame, model: PieceModel, ids_col: str = "token_ids") -> DataFrame:
    """The rows with decoded behind their columns; null ids give null, broken UTF-8 gets U+FFFD."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: None if x is None else decoded(held.value, x.tolist()).decode("utf-8", "replace"))

    return rows.withColumn("decoded", text(F.col(ids_col)))
