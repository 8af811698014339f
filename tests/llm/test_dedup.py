"""Exact and near duplicates against brute force."""

import random
import re

from pyspark.sql import functions as F

from tessera.llm import exact_dedup as ed
from tessera.llm import near_dedup as nd
from tessera.llm.components import connected_components


def test_exact_odd_rows(make_docs, odd_texts):
    rows = list(enumerate(odd_texts)) + [(6, "same  text\there"), (6, "same text here")]
    got = ed.exact_duplicates(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    want = {}
    for i, t in rows:
        want.setdefault(norm(t), []).append(i)
    assert sorted(len(v) for v in by.values()) == sorted(len(v) for v in want.values())
    for group in by.values():
        assert sum(r["kept"] for r in group) == 1
        assert {r["group_size"] for r in group} == {len(group)}
        assert {r["keep_id"] for r in group} == {min(r["doc_id"] for r in group)}


def test_exact_chunks_are_cut_by_content_in_every_script(spark):
    """What stands before a text moves its first chunks and no others; few chunks are cut by length alone."""
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    texts = {
        "latin": " ".join(word("etaoinshrdlcumwfgypb") for _ in range(15_000)),
        "cyrillic": " ".join(word("оеаинтсрвлкмдпуяыьгз") for _ in range(15_000)),
        "arabic": " ".join(word("ابتثجحخدرزسشصضطعغفقكلمنهوي") for _ in range(15_000)),
        "chinese": "".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(64_000)),
        "korean": "".join(rng.choices(" 은" + "".join(map(chr, range(0xAC00, 0xB1E0))), [9.0, 2.0, *(10 / (i + 15) for i in range(1504))], k=60_000)),
        "thai": "".join(rng.choices([*map(chr, range(0x0E01, 0x0E2F))], [1 / (i + 3) for i in range(46)], k=60_000)),
        "no spaces": "".join(chr(rng.randrange(97, 123)) for _ in range(60_000)),
    }
    rows = [(k, t, "新 prefix " * 30 + t) for k, t in texts.items()]
    for r in spark.createDataFrame(rows, "k string, a string, b string").select("k", ed.chunks(F.col("a")).alias("a"), ed.chunks(F.col("b")).alias("b")).collect():
        assert "".join(r.a) == texts[r.k] and len(r.a) > 4
        assert sum(len(c) == ed.MAX_CHUNK for c in r.a) <= len(r.a) // 2, r.k
        assert len(set(r.b) - set(r.a)) <= max(8, len(r.b) // 3), r.k
        assert r.a[-1] == r.b[-1]


def test_exact_many_copies_of_a_row(make_docs, monkeypatch):
    monkeypatch.setattr(ed, "COPIES", 4)
    got = ed.exact_duplicates(make_docs([(5, "x y")] * 11 + [(4, "x\ty"), (6, "z")] * 4)).collect()
    assert len(got) == 19 and sum(r["kept"] for r in got) == 2
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(5, 4, 15), (4, 4, 15), (6, 6, 4)}


def test_exact_empty(make_docs):
    assert ed.exact_duplicates(make_docs([])).count() == 0
    assert ed.without_exact_duplicates(make_docs([])).columns == make_docs([]).columns


def test_exact_stage_keeps_one_with_columns(make_docs):
    docs = make_docs([(2, "a  b"), (1, "a b"), (3, "c"), (3, "c"), (4, None), (5, "")])
    kept = ed.without_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, "a b"), (3, "c"), (4, None)]


def test_chunks_rebuild_text(spark):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abeiou.") for _ in range(rng.randint(1, 9))) for _ in range(20_000))
    row = spark.createDataFrame([(text,)], "t string").select(ed.chunks(F.col("t"))).first()
    parts = row[0]
    assert "".join(parts) == text
    assert len(parts) > 10 and max(map(len, parts)) <= ed.MAX_CHUNK + 2


def brute_components(texts, width, num, den):
    def shingles(t):
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if len(words) >= width:
            return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        return {tuple(words)} if words else set()

    sets = {i: shingles(t) for i, t in texts}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                x = len(sets[a] & sets[b])
                if den * x >= num * len(sets[a] | sets[b]):
                    p, q = sorted((find(a), find(b)))
                    top[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_corpus(seed=3, variants=60):
    """Variants of one text whose likeness to each other lies on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(variants):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(40))) for i in range(20)]
    return rows


def test_near_against_brute_force(make_docs, odd_texts):
    rows = near_corpus() + [(200 + i, t) for i, t in enumerate(odd_texts)] + [(300, "One two three"), (301, "one TWO three"), (302, "one two")]
    for num in (80, 85):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicate_classes(make_docs(rows), num=num).collect()}
        assert got == brute_components(rows, 5, num, 100)


def test_near_empty_and_repeated(make_docs):
    assert nd.near_duplicate_classes(make_docs([])).count() == 0
    got = nd.near_duplicate_classes(make_docs([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 2)]
    docs = make_docs([(2, "a b c d e f"), (1, "A b c d e f"), (3, None)])
    kept = nd.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_near_repeated_ids_go_by_their_texts(spark, make_docs):
    """Of rows with one id each is judged by its own text; names that the stage uses inside are the user's to keep."""
    a, b = "a b c d e f g h i j k l m n o p q r s t", "one two three four five six seven"
    docs = make_docs([(2, a), (1, a + " x"), (1, b), (1, b), (3, b), (None, a), (4, None), (4, "")])
    docs = docs.withColumn("gone_id", F.lit(1)).withColumn("Gone_Key", F.lit(2))
    got = nd.without_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
    assert kept == sorted([(1, a + " x"), (1, b), (1, b), (0, a), (4, ""), (4, "")])
    # near copies under one id are one component, of which one text stays
    kept = nd.without_near_duplicates(make_docs([(1, a), (1, a + " x"), (1, a + " y"), (5, a + " z")])).collect()
    assert len(kept) == 1 and kept[0]["doc_id"] == 1


def _own(part, n, base, start):
    """n near copies of a set, each with two shingles of its own."""
    return [(start + i, part, [*base, 10_000 * (part + 1) + 2 * i, 10_000 * (part + 1) + 2 * i + 1]) for i in range(n)]


def test_near_candidates_grow_with_the_rows(spark):
    """Two parts of n rows that share one shingle, that are alike by two thirds, that are linked; and a part with one foreign row."""
    for other, most in ([0, *range(500, 599)], 0), (range(20, 120), 0), (range(5, 105), 1), (range(10, 110), 1):
        for n in (40, 160):
            rows = _own(0, n, range(100), 0) + _own(1, n, other, 1000)
            sets = spark.createDataFrame(rows, "node long, part long, shingles array<long>")
            links, pairs = nd._between(sets, 80, 100)
            assert links.count() + pairs.count() <= most
        links, pairs = nd._between(spark.createDataFrame([*_own(0, 60, range(100), 0), (9999, 1, list(other))], sets.schema), 80, 100)
        assert links.count() + pairs.count() <= 60


def test_near_links_between_parts_are_complete(spark):
    """Whatever the parts are, links and tested pairs join what brute force over all pairs joins."""
    rng = random.Random(11)
    rows = []
    for i in range(160):
        base = rng.choice([range(0, 40), range(5, 45), range(8, 48), range(60, 100)])
        rows.append((i, rng.choice([i, 200 + i % 3, 210 + i % 2]), sorted(rng.sample([*base], rng.randint(30, 40)) + [1000 + rng.randrange(40)])))
    sets = {i: set(s) for i, _, s in rows}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])

    def joined(links):
        top = {}
        find = lambda x: x if top.get(x, x) == x else find(top[x])
        for a, b in [(f"p{p}", i) for i, p, _ in rows] + links:
            top[find(a)] = find(b)
        return {frozenset(i for i in sets if find(i) == r) for r in map(find, sets)}

    links, pairs = nd._between(spark.createDataFrame(rows, "node long, part long, shingles array<long>"), 80, 100)
    links, pairs = [tuple(r) for r in links.collect()], [tuple(r) for r in pairs.collect()]
    assert all(alike(*x) for x in links)
    want = [(a, b) for a in sets for b in sets if a < b and alike(a, b)]
    assert joined(links + [x for x in pairs if alike(*x)]) == joined(want)
    assert len(pairs) < len(sets) ** 2 / 2


def test_components_chain_and_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
