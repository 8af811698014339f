"""Spelling variants against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = [n, best if best and counts[best] >= 2 * n else None, w, len(near)]
    for row in out.values():
        while out[row[2]][1]:
            row[2] = out[row[2]][1]
    return {w: (n, form, root, near, counts.get(form)) for w, (n, form, root, near) in out.items()}


def found(rows):
    got = {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in rows.collect()}
    assert len(got) == rows.count()
    return got


def vocabulary(seed, size, letters, lengths):
    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.choice(lengths))) for _ in range(size)}
    return {w: rng.choice([3, 3, 4, 6, 12, 25, 60]) for w in words}


@pytest.mark.parametrize("group", [3, 512])
def test_near_words_of_crowded_vocabularies(spark, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    counts = vocabulary(1, 250, "abé", (5, 6, 7)) | vocabulary(2, 60, "ab", (11, 12)) | {"x" * 300: 5, "x" * 301: 11, "x" * 150 + "y" + "x" * 150: 3, "zzzzz": 4}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.variants(words)) == expected(counts)


def test_groups_are_split_until_small(spark, monkeypatch):
    """A third of all words share a beginning, and no group stays large where there is more than one free place."""
    monkeypatch.setattr(spelling, "GROUP", 40)
    counts = {f"same{a}{b}{c}" for a in "abcdefghij" for b in "abcdefghij" for c in "abc"} | set(vocabulary(3, 600, "abcdefghijklmnop", (7, 8)))
    rows = spelling.grouped(spark.createDataFrame([(w, 3) for w in sorted(counts)], "word string, n long"))
    sizes = rows.groupBy(*spelling._KEY).count().collect()
    assert max(r["count"] for r in sizes if r.m - r.front - r.back > 1) <= 40
    assert max(r["count"] for r in sizes) <= 40


def test_tiles_give_what_pairs_give(monkeypatch):
    words = sorted(vocabulary(4, 200, "ab", (6, 7)))
    want = {tuple(sorted((a, b))) for a in words for b in words if one_edit(a, b) and max(len(a), len(b)) == 7}
    for block in (1, 3, 64, 1000):
        monkeypatch.setattr(spelling, "BLOCK", block)
        n = len(words)
        i, j = spelling.near_places(words, np.full(n, 7), np.zeros(n, np.int64), np.full(n, 99))
        pairs = [tuple(sorted((words[a], words[b]))) for a, b in zip(i, j, strict=True)]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_words_of_texts_with_their_damage(spark, make_docs, odd_texts):
    texts = [*odd_texts, "Straße STRAẞE Çedille çedille naïve×3", "under_score It's re-read", "abcde " * 300, None]
    docs = make_docs([*enumerate(texts * 3), (None, "nullid nullid nullid NULLID")])
    want = Counter()
    for r in docs.collect():
        for run in spelling_runs(r.text or ""):
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            want[word] += 1
    assert {r.word: r.n for r in spelling.counted_words(docs).collect()} == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}


def spelling_runs(text):
    import re

    return [m.translate({c: c + 32 for c in range(65, 91)}) for m in re.findall(spelling.RUN, text)]


def test_few_words(make_docs):
    assert spelling.spelling_groups(make_docs([])).count() == 0
    assert spelling.spelling_groups(make_docs([(1, "alone alone alone")])).collect()[0].asDict() == {"word": "alone", "n": 3, "form": None, "root": "alone", "n_near": 0, "form_n": None}
