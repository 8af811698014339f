"""The prefix trie of conversations against brute force."""

import hashlib
import random
import zlib

import pytest

from tessera.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, head string, n long, PATH string"


def expected(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        own_saving = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        parts = [below(x) for x in children.get(node, [])]
        return sum(x[0] for x in parts) or 1, own_saving + sum(x[1] for x in parts)

    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), *below(node),
            hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def check(spark, rows):
    table = spark.createDataFrame([(*r, "h", 7, "p") for r in rows], SCHEMA)
    got = pt.prefix_trie(table)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == expected(rows)


def many(seed, convs, words, turns):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "bot"]), rng.choice(words)) for c in range(convs) for t in range(rng.choice(turns))]


@pytest.mark.parametrize("limit", [1, 6, 40, 100_000])
def test_containers_of_any_size_give_the_same_trie(spark, monkeypatch, limit):
    monkeypatch.setattr(pt, "CONTAINER_TURNS", limit)
    rows = many(1, 60, ["a", "b", "a longer text é"], (0, 1, 3, 5, 12))
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(14)]  # copies share all turns
    rows += [(c, t, "user", f"same {t}" if t < 11 else f"own {c}") for c in range(160, 180) for t in range(13)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [
        (3, None, None, None), (3, None, None, None), (3, 2, "user", ""), (3, -1, "user", "first"), (7, 1, "", "x"), (None, 1, "user", "nobody's"),
        (8, 1, "us", "erx"), (9, 1, "user", "x"), (12, 5, None, "日本 \x00 text"), (12, 5, None, "日本 \x00 text"), (20, 1, "user", "long " * 50_000), (-7, 1, "user", "x"), (10**15, 1, "user", "x"),
    ]
    check(spark, rows)
    turnless = next(c for c in range(6, 10**6, 5) if zlib.crc32(str(c).encode()) % 9 == 8)
    check(spark, [(turnless, 1, "user", "gone"), (turnless + 5, 1, "user", "x")])
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pt.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", "h", 1, "p")], SCHEMA)).count() == 0


def test_a_burst_skips_what_all_share(spark, monkeypatch):
    """A long common beginning takes one round, however long it is."""
    monkeypatch.setattr(pt, "CONTAINER_TURNS", 20)
    rows = [(c, t, "user", f"turn {t}" if t < 200 else f"own {c}") for c in range(0, 40, 5) for t in range(202)]
    sequences = pt.distinct_sequences(pt.with_shared_starts(pt.turn_sequences(spark.createDataFrame([(*r, "h", 7, "p") for r in rows], SCHEMA))))
    settled, rounds = pt.containers(sequences)
    assert len(rounds) == 1 and settled.count() == 8
    assert rounds[0][0].collect()[0].shared == 200
    check(spark, rows)
