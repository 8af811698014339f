"""Byte-level BPE against the tokenizers library."""

import hashlib
import json
import struct

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, queries
from tessera.llm.common import KNOWN_WORD

ODD = [
    "a<|endoftext|>b <|endoftext|>", "<|endoftext|><|endoftext|>", " \n\n  x", "don't WE'LL we'll've", "é" * 3000, "a" * 4001, "½ ² Ⅷ",
    "՘x \U0003d000y\x85z  q\x1c\x1f t\x00", "日本語" * 200, "  　 a", "﻿x​", "x \U00011de5 7\U0001246f", "ab" * 999,
]


@pytest.fixture(scope="module")
def model():
    return bpe.load()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.MODEL))


def ids_of(encoder, text):
    odd = pc.match_substring_regex(pa.array([text]), bpe.NEWER).to_pylist()
    ids, offsets = encoder.encode([text], odd)
    assert offsets.tolist() == [0, len(ids)]
    return ids.tolist()


def test_odd_texts_and_all_code_points(model, library):
    encoder = bpe.TextEncoder(model)
    every = [f"a{chr(c)}1{chr(c)}!{chr(c)}a" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 97 == 0 or c in range(0x1DF00, 0x1E700))]
    for text in [*ODD, *map("".join, zip(every[::2], every[1::2], strict=False))]:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(encoder, text) == want
        assert bpe.decoded(model, want) == library.decode(want, skip_special_tokens=False) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab eE'tll\n\té日🙂<|endoftext|>1½"), max_size=60), max_size=4))
def test_any_text(model, library, texts):
    encoder = bpe.TextEncoder(model)
    for text in texts:
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_what_is_remembered_is_bounded_and_does_not_matter(model, library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 3000)
    encoder = bpe.TextEncoder(model)
    for i in range(60):
        text = f"word{i} some words here {'long' * 40}{i % 3} again some"
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids
        assert encoder.ids.held <= 3000 and not any(len(w) > KNOWN_WORD for w in encoder.ids.known)


def test_many_indexes_give_what_one_gives(model, library, monkeypatch):
    monkeypatch.setattr(bpe, "INDEX_SYMBOLS", 40)
    text = " ".join(f"tokenization{i} banana bananas aaaa{'a' * i}" for i in range(30))
    assert ids_of(bpe.TextEncoder(model), text) == library.encode(text, add_special_tokens=False).ids


def test_files_that_mean_something_else_are_refused(tmp_path):
    with open(public_tokenizers.path(bpe.MODEL)) as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.load(str(tmp_path / "t.json"))


def test_query_equals_the_library_on_whole_texts(spark, sf, library):
    got = {r.doc_id: r for r in queries.op12_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        row = got[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((doc.text or "").encode()).hexdigest()


def test_odd_rows(spark, make_docs, odd_texts, model, library):
    docs = make_docs([*enumerate([*odd_texts, *ODD]), (None, "a b"), (None, "a b")]).withColumnRenamed("sig", "N_TOKENS")
    rows = bpe.decoded_texts(bpe.encoded(docs, model), model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "") and r.n_tokens == len(r.token_ids) and r.lang == "en"
    assert bpe.encoded(make_docs([]), model).count() == bpe.digested(make_docs([]), model).count() == 0
