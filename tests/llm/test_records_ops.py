"""Chat repair and WARC archives."""

import hashlib
import itertools
import random

import pyarrow.fs as pafs
import pytest

from tessera.llm import chat, warc
from tessera.session import fresh_path

CONV = "conv_id long, turn long, role string, text string, block string"


def best_cost(roles):
    """Cheapest repair by trying every action for every turn."""
    best = None
    for labels in itertools.product((chat.SYSTEM, chat.USER, chat.ASSISTANT), repeat=len(roles)):
        state, cost = chat.START, 0
        for role, to in zip(roles, labels, strict=True):
            label = 0 if role == to else chat.LABEL if role == chat.UNKNOWN else chat.RELABEL
            ways = []
            if to in chat.FOLLOWS[state]:
                ways.append(label)
            if state == to:
                ways.append(label + chat.MERGE)
            ways += [label + chat.INSERT for m in chat.FOLLOWS[state] if to in chat.FOLLOWS[m]]
            if not ways:
                break
            cost, state = cost + min(ways), to
        else:
            total = cost + chat.END_COST[state]
            best = total if best is None else min(best, total)
    return best


@pytest.mark.parametrize("block", [3, 20_000])
def test_repair_is_cheapest_and_legal(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    rng = random.Random(1)
    names = ["user", "assistant", "system", "Human", "bot", None, "tool"]
    rows = [(c, t, rng.choice(names), f"t{t}" if rng.random() < 0.9 else None, "b") for c in range(25) for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, CONV)
    got = chat.repaired_turns(df)
    assert got.count() == len(rows)
    whole = {r["conv_id"]: r for r in chat.rendered_conversations(got).collect()}
    for c in range(25):
        turns = sorted([r for r in rows if r[0] == c], key=lambda r: r[1])
        assert whole[c]["cost"] == best_cost([chat.role_of(r[2]) for r in turns])
        roles = [line[2:-2] for line in whole[c]["rendered"].split("\n") if line in ("<|user|>", "<|assistant|>", "<|system|>")]
        rest = roles[1:] if roles[0] == "system" else roles
        assert rest == ["user", "assistant"] * (len(rest) // 2) and rest
        assert whole[c]["rendered"].count("<|end|>") == len(roles)


def test_long_conversation_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 50)
    rows = [(1, t, "user" if t % 3 else "assistant", "x", "b") for t in range(2000)]
    got = chat.repaired_turns(spark.createDataFrame(rows, CONV)).agg({"cost": "sum", "turn": "count"}).first()
    path = chat.repaired([chat.role_of(r[2]) for r in rows], chat.START, None)
    want = sum(int(chat.COSTS[chat.role_of(r[2])][p]) for r, p in zip(rows, path, strict=True)) + chat.END_COST[path[-1][1]]
    assert (got["sum(cost)"], got["count(turn)"]) == (want, 2000)


def test_chat_odd_tables(spark):
    assert chat.repaired_turns(spark.createDataFrame([], CONV)).count() == 0
    rows = [(None, None, None, None, None), (None, 1, "user", "", None), (3, 0, "user", "a" * 200_000, "b"), (3, 0, "user", "a", "b")]
    got = chat.repaired_turns(spark.createDataFrame(rows, CONV)).collect()
    assert len(got) == 4 and {r["conv_id"] for r in got} == {-1, 3}


def test_repeated_turns_keep_their_order_over_blocks(spark, monkeypatch):
    """Turns of one number and role: a legal, cheapest conversation, however they are dealt into blocks."""
    monkeypatch.setattr(chat, "BLOCK_TURNS", 4)
    rows = [(1, t // 7, "user" if t % 7 < 4 else "assistant", f"text {t}" * (t % 3), "b") for t in range(60)]
    got = chat.repaired_turns(spark.createDataFrame(rows, CONV))
    whole = chat.rendered_conversations(got).first()
    roles = [line[2:-2] for line in whole["rendered"].split("\n") if line in ("<|user|>", "<|assistant|>")]
    assert roles == ["user", "assistant"] * (len(roles) // 2)
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    path = chat.repaired([chat.role_of(r[2]) for r in ordered], chat.START, None)
    assert whole["cost"] == sum(int(chat.COSTS[chat.role_of(r[2])][p]) for r, p in zip(ordered, path, strict=True)) + chat.END_COST[path[-1][1]]


PAGES = "page_id long, url string, html string, key string, kind string"


def test_warc_round_trip_is_deterministic(spark):
    rng = random.Random(2)
    html = [f"<p>{rng.random()}</p>" * rng.randint(1, 400) for _ in range(60)]
    rows = [(i, f"http://e.com/{i} ü", html[i % 40], "k", "0") for i in range(100)]
    rows += [(200, None, None, None, None), (201, "u", "", None, None), (202, "u\nv", "x" * 300_000, None, None), (5, "http://other", html[5], None, None), (None, "n", "same", None, None), (203, "n", "same", None, None)]
    runs = []
    for parts in (3, 7):
        folder = fresh_path(spark, "warc")
        manifest = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(parts), folder, roll_bytes=9000, range_bytes=40_000)
        runs.append(sorted(tuple(r) for r in manifest.collect()))
        got = [(r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.read_archives(spark, folder).collect()]
    assert runs[0] == runs[1] and len(runs[0]) > 3
    first = {}
    for i, _, h, _, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h, _, _ in rows:
        data = (h or "").encode()
        at = first.get(h or "")
        refers = at if i is not None and at < i else None
        want.append((i, "response" if refers is None else "revisit", len(data), warc.digest(data), refers))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_warc_threshold_and_empty(spark):
    rows = [(1, "u", "ab", None, None), (2, "u", "ab", None, None), (3, "u", "abcdef", None, None), (4, "u", "abcdef", None, None)]
    folder = fresh_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, PAGES), folder, least_bytes=5)
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(spark, folder).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    folder = fresh_path(spark, "warc")
    assert warc.write_archives(spark.createDataFrame([], PAGES), folder).count() == 0
    assert warc.read_archives(spark, folder).count() == 0


def test_warc_written_again_over_an_earlier_attempt(spark, tmp_path):
    """Files of an attempt that was lost before the manifest: equal ones stay, others are replaced, none is left over."""
    rows = [(i, f"u{i}", f"<p>{i}</p>" * 50, None, None) for i in range(60)]
    pages = spark.createDataFrame(rows, PAGES)
    manifest = sorted(tuple(r) for r in warc.write_archives(pages, f"file://{tmp_path}/one", roll_bytes=2000, range_bytes=9000).collect())
    names = [r[0] for r in manifest]
    assert len({n[:11] for n in names}) > 1 and any(n.endswith("-0001.warc.gz") for n in names)
    two = tmp_path / "two"
    two.mkdir()
    for name in names[:-1]:
        (two / name).write_bytes((tmp_path / "one" / name).read_bytes())
    (two / names[0]).write_bytes(b"another table's")
    assert sorted(tuple(r) for r in warc.write_archives(pages, f"file://{two}", roll_bytes=2000, range_bytes=9000).collect()) == manifest
    assert sorted(p.name for p in two.iterdir() if p.is_file() and not p.name.endswith(".crc")) == names
    assert warc.read_archives(spark, f"file://{two}").count() == 60


def test_warc_publish_over_what_is_there(tmp_path):
    fs = pafs.LocalFileSystem()
    sha = hashlib.sha256(b"abc").hexdigest()
    for before in (None, b"abc", b"xyz"):
        (tmp_path / "made").write_bytes(b"abc")
        if before is not None:
            (tmp_path / "name").write_bytes(before)
        warc.publish(fs, f"{tmp_path}/made", f"{tmp_path}/name", sha)
        assert (tmp_path / "name").read_bytes() == b"abc" and not (tmp_path / "made").exists()
