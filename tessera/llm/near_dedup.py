"""Near duplicates by many universal hash minima, banding, verification and components.

1. Every text becomes its set of distinct word shingles (64-bit fingerprints) and a
   signature of BANDS * ROWS minima under multiply-add-shift hash functions. Texts with the
   same set share one representative from here on.
2. Bands of the signature become bucket keys; buckets with one member go.
3. In each bucket the first and the last member are tested against all others: signatures
   first, then the full sets. Components join what is linked.
4. The members of buckets that still hold more than one component are searched to the end:
   a prefix join on their rarest shingles gives all pairs from different components that can
   be alike enough. Components meet first, by one test of their pivots; their members only
   where distances from the pivots leave a link open. So neither pairs within a component nor
   all pairs between two are listed: no bucket is capped, and a bucket of thousands of
   variants of one text, or of two, costs a few tests for each of its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, as_bytes, lean, parts_of, slices, unused
from tessera.llm.components import connected_components
from tessera.session import stored

#: 26 bands of 5 minima: a pair of similarity 0.85 shares no band with probability 2e-7.
BANDS, ROWS = 26, 5
#: A pair whose signatures agree in a share this far below the threshold is not tested on
#: its sets: 0.16 is five standard deviations of 130 minima at 0.85.
SIGNATURE_SLACK = 0.16
#: Distances are sums of rounded shares.
_ROUNDING = 1e-9
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _universal(n: int, seed: int = 20240607) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    top = np.iinfo(np.uint64).max
    a = rng.integers(0, top, n, dtype=np.uint64, endpoint=True) | np.uint64(1)
    return a, rng.integers(0, top, n, dtype=np.uint64, endpoint=True)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[bytes | None], width: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text; see near_duplicate_classes."""
    words = [t.translate(_LOWER).split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
    n = len(flat) - width + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + flat[j : j + n]
    rolled = _mixed(rolled)
    out, start = [], 0
    for size in sizes.tolist():
        if size >= width:
            out.append(np.unique(rolled[start : start + size - width + 1]))
        elif size:
            whole = xxhash.xxh64_intdigest(flat[start : start + size].tobytes(), seed=size)
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        start += size
    return out


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Minima of each non-empty set under n universal hash functions, 32 bits each."""
    a, b = _universal(n)
    out = np.empty((len(sets), n), np.uint32)
    for lo, hi in slices([len(s) for s in sets], 1 << 15):
        flat = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0, *(len(s) for s in sets[lo : hi - 1])])
        work = np.empty_like(flat)
        for i in range(n):
            np.multiply(flat, a[i], out=work)
            np.add(work, b[i], out=work)
            out[lo:hi, i] = np.minimum.reduceat(work, starts) >> np.uint64(32)
    return out


def _sketches(width: int, n: int):
    schema = pa.schema(
        [("id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("sig", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in parts_of(batch, 2):
                sets = shingle_sets(as_bytes(part.column(2)), width, hashes)
                full = [i for i, s in enumerate(sets) if len(s)]
                sigs: list[bytes | None] = [None] * len(sets)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full], n), strict=True):
                        sigs[i] = row.astype(">u4").tobytes()
                digests = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(sigs, pa.binary()),
                    ],
                    schema=schema,
                )

    return run, "id long, text_key long, n_shingles long, set_hash binary, sig binary"


def _sets(width: int):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part in parts_of(batch, 1):
                sets = shingle_sets(as_bytes(part.column(1)), width, hashes)
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(pa.array(offsets), values),
                    ],
                    schema=schema,
                )

    return run, "node long, shingles array<long>"


def _agreeing(slack_num: int, n: int):
    """Whether two signatures agree in slack_num of 100 minima at least."""

    @F.pandas_udf("boolean")
    def agree(a, b):
        x = np.frombuffer(b"".join(a), np.uint32).reshape(-1, n)
        y = np.frombuffer(b"".join(b), np.uint32).reshape(-1, n)
        return pd.Series((x == y).sum(axis=1) * 100 >= slack_num * n)

    return agree


def _verified(pairs: DataFrame, sketch: DataFrame, sets: DataFrame, num: int, den: int, n: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are alike enough."""
    least = max(0, round(100 * (num / den - SIGNATURE_SLACK)))
    sig = sketch.select("node", "sig")
    near = (
        pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a")
        .join(sig.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b")
        .where(_agreeing(least, n)("sig_a", "sig_b"))
        .select("a", "b")
    )
    shared = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - shared
    return (
        near.join(sets.withColumnsRenamed({"node": "a", "shingles": "s_a"}), "a")
        .join(sets.withColumnsRenamed({"node": "b", "shingles": "s_b"}), "b")
        .where(den * shared >= num * union)
        .select("a", "b")
    )


def _prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """node, part, n, at, s: the first n - ceil(n * num / den) + 1 shingles of each set (node, part, shingles), rarest first.

    Alike sets share one of these, and at the first they share enough must be left of both
    (Bayardo et al. 2007, Xiao et al. 2008).
    """
    rows = sets.select("node", "part", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    common = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    order = F.array_sort(F.collect_list(F.struct("df", "s")))
    length = F.col("n") - F.ceil(F.col("n") * num / den).cast("int") + 1
    return stored(
        rows.join(common, "s")
        .groupBy("node", "part", "n")
        .agg(order.alias("o"))
        .select("node", "part", "n", F.posexplode(F.slice("o", F.lit(1), length)).alias("at", "x"))
        .select("node", "part", "n", "at", "x.s"),
        "prefixes",
    )


def _meetings(prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """s, pa < pb: parts whose prefixes share the shingle s, where the best of their members could share enough."""
    places = prefixes.groupBy("s", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("at")).alias("left"))
    one = places.withColumnsRenamed({"part": "pa", "lo": "lo_a", "hi": "hi_a", "left": "left_a"})
    two = places.withColumnsRenamed({"part": "pb", "lo": "lo_b", "hi": "hi_b", "left": "left_b"})
    sizes = (den * F.col("hi_a") >= num * F.col("lo_b")) & (den * F.col("hi_b") >= num * F.col("lo_a"))
    enough = F.least("left_a", "left_b") * (num + den) >= num * (F.col("lo_a") + F.col("lo_b"))
    return one.join(two, "s").where((F.col("pa") < F.col("pb")) & sizes & enough).select("s", "pa", "pb")


def _overlap(a: str, b: str) -> tuple[Column, Column]:
    """Sizes of what two sets share and of their union."""
    shared = F.size(F.array_intersect(a, b))
    return shared, F.size(a) + F.size(b) - shared


def _between(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that join parts, and pairs (a, b) that have to be tested, of sets (node, part, shingles).

    Parts meet before their members. The Jaccard distance is a metric: where the pivots of two
    parts are farther apart than the threshold and both parts' reaches together, no members are
    linked; where the pivots are linked, the parts are one and no more is asked. Only between
    those, and only for members that are far enough from their pivots, pairs are listed.
    """
    prefixes = _prefixes(sets, num, den)
    meets = stored(_meetings(prefixes, num, den), "meetings")
    first = sets.groupBy("part").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("size"))
    pivots = stored(sets.join(first, ["part", "node"]).withColumnsRenamed({"node": "pivot", "shingles": "core"}), "pivots")
    shared, union = _overlap("shingles", "core")
    off = F.when(F.col("size") > 1, 1 - shared / union).otherwise(0.0)
    members = stored(sets.join(pivots, "part").select("node", "part", off.alias("off")), "members")
    about = pivots.select("part", "pivot", "size").join(members.groupBy("part").agg(F.max("off").alias("reach")), "part")
    pairs = meets.select("pa", "pb").distinct()
    for end, side in (("a", "pa"), ("b", "pb")):
        pairs = pairs.join(about.toDF(side, end, f"size_{end}", f"reach_{end}"), side)
    pairs = stored(pairs, "part-pairs")
    alone = (F.col("size_a") == 1) & (F.col("size_b") == 1)
    met = pairs.where(~alone)
    for end, side in (("a", "pa"), ("b", "pb")):
        met = met.join(pivots.select(F.col("part").alias(side), F.col("core").alias(f"core_{end}")), side)
    shared, union = _overlap("core_a", "core_b")
    beyond = (1 - shared / union) - (1 - num / den)
    met = stored(met.select("pa", "pb", "a", "b", "reach_a", "reach_b", beyond.alias("beyond"), (den * shared >= num * union).alias("linked")), "pivot-pairs")
    links = met.where("linked").select("a", "b")
    one = connected_components(met.where("linked").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    close = met.where(~F.col("linked") & (F.col("beyond") <= F.col("reach_a") + F.col("reach_b") + _ROUNDING))
    for side in ("pa", "pb"):
        close = close.join(one.toDF(side, f"top_{side}"), side, "left")
    close = close.where(F.coalesce("top_pa", "pa") != F.coalesce("top_pb", "pb")).select("pa", "pb", "beyond", "reach_b")
    rows = prefixes.join(members, ["node", "part"]).select("s", "part", "node", "n", (F.col("n") - F.col("at")).alias("left"), "off")
    left, right = (rows.toDF("s", f"p{x}", x, f"n{x}", f"left_{x}", f"off_{x}") for x in ("a", "b"))
    alike = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
    enough = F.least("left_a", "left_b") * (num + den) >= num * (F.col("na") + F.col("nb"))
    some = close.join(meets, ["pa", "pb"]).join(left, ["s", "pa"]).where(F.col("off_a") + F.col("reach_b") >= F.col("beyond") - _ROUNDING)
    some = some.join(right, ["s", "pb"]).where(alike & enough & (F.col("off_a") + F.col("off_b") >= F.col("beyond") - _ROUNDING))
    return links, pairs.where(alone).select("a", "b").union(some.select("a", "b")).distinct()


def _nodes(sketch: DataFrame) -> DataFrame:
    """node, id, set_hash, text_key, sig: one row for each distinct set, named by its smallest id.

    Where one id stands for several sets, the first of them is named by the id and the others
    by a hash of both, so that each set is a node of its own. text_key names a text that has
    the set.
    """
    first = F.min(F.struct("id", "text_key")).alias("first")
    sets = sketch.where("set_hash is not null and id is not null").groupBy("set_hash").agg(first, F.max("sig").alias("sig"))
    sets = sets.select("set_hash", "first.id", "first.text_key", "sig")
    several = sets.groupBy("id").agg(F.min("set_hash").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "lead")
    name = F.when(F.col("lead") != F.col("set_hash"), F.xxhash64("id", "set_hash")).otherwise(F.col("id"))
    return sets.join(several, "id", "left").select(name.alias("node"), "id", "set_hash", "text_key", "sig")


def _classes(sketch: DataFrame, base: DataFrame, width: int, num: int, den: int, bands: int, rows: int) -> DataFrame:
    """set_hash, component_id, lead_hash: the smallest id of each set's component, and which of its sets is the first."""
    n = bands * rows
    reps = stored(_nodes(sketch), "representatives")
    band = F.explode(
        F.array(*(F.xxhash64(F.lit(i), F.substring("sig", 4 * rows * i + 1, 4 * rows)) for i in range(bands)))
    )
    keyed = reps.select("node", band.alias("bucket"))
    ends = (
        keyed.groupBy("bucket")
        .agg(F.min("node").alias("first"), F.max("node").alias("last"))
        .where("first < last")
    )
    members = stored(keyed.join(ends, "bucket"), "buckets")
    seen = reps.join(members.select("node").distinct(), "node", "left_semi").select("node", "id", "text_key")
    run, schema = _sets(width)
    texts = base.join(seen, ["id", "text_key"]).select("node", "text")
    sets = stored(texts.mapInArrow(lean(run), schema).dropDuplicates(["node"]), "sets")  # one text's set is as good as its copy's
    tested = (
        members.select(F.col("first").alias("a"), F.col("node").alias("b"))
        .union(members.select(F.col("node").alias("a"), F.col("last").alias("b")))
        .where("a < b")
        .distinct()
    )
    links = stored(_verified(tested, reps, sets, num, den, n), "links")
    parts = connected_components(links).withColumnRenamed("id", "node")
    placed = members.join(parts, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part"))
    mixed = (
        placed.groupBy("bucket")
        .agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
        .where("lo < hi")
        .select("bucket")
    )
    rest = placed.join(mixed, "bucket", "left_semi").select("node", "part").distinct()
    sure, others = _between(stored(sets.join(rest, "node").select("node", "part", "shingles"), "mixed-sets"), num, den)
    more = stored(sure.union(_verified(others, reps, sets, num, den, n)), "more-links")
    if not more.isEmpty():
        parts = connected_components(links.union(more)).withColumnRenamed("id", "node")
    linked = reps.join(parts, "node").select("component", "id", "set_hash")
    tops = linked.groupBy("component").agg(F.min(F.struct("id", "set_hash")).alias("top"))
    moved = linked.join(tops, "component").select("set_hash", F.col("top.id").alias("top_id"), F.col("top.set_hash").alias("top_hash"))
    return reps.select("set_hash", "id").join(moved, "set_hash", "left").select(
        "set_hash", F.coalesce("top_id", "id").alias("component_id"), F.coalesce("top_hash", "set_hash").alias("lead_hash")
    )


def near_duplicate_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    num: int = 80,
    den: int = 100,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, text_key.

    A-Z are lower-cased, words are runs without ASCII white space. A text's set holds its
    distinct shingles of ``width`` words; a text of fewer words has its whole sequence as
    its one shingle; null and texts without words have the empty set and stay alone.
    Texts are linked when den * shared >= num * union. component_id is the smallest id
    that can be reached. ids are integers. Rows that repeat an id are told apart by their
    texts: of the sets under a component's smallest id one is kept, and rows that repeat both
    id and text share their result. Rows with a null id are left out of the search and stay;
    component_id is that of their set, if others have it. text_key is xxhash64 of the text, null for null. An empty table gives no rows; other
    columns are ignored.
    """
    run, schema = _sketches(width, bands * rows)
    base = docs.select(F.col(id_col).cast("long").alias("id"), _text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    sketch = stored(base.mapInArrow(lean(run), schema), "sketches")
    classes = _classes(sketch, base, width, num, den, bands, rows)
    top = F.coalesce("component_id", "id")
    lone = F.col("set_hash").isNull() | F.col("id").isNull()
    return sketch.join(classes, "set_hash", "left").select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        top.alias("component_id"),
        (lone | ((F.col("id") == top) & (F.col("set_hash") == F.col("lead_hash")))).alias("kept"),
        "text_key",
    )


def _text_key(text_col: str) -> Column:
    """A hash that tells the texts of one id apart."""
    return F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, one of each component, with all their columns.

    Rows go by id and text, so of rows that repeat an id each is judged by its own text. Rows
    with a null id or without words stay; an empty table stays empty.
    """
    gone_id, gone_key = unused(docs, "gone_id"), unused(docs, "gone_key")
    gone = near_duplicate_classes(docs, id_col, text_col, **options).where("not kept")
    gone = gone.select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key))
    same = (F.col(id_col).cast("long") == F.col(gone_id)) & (_text_key(text_col) == F.col(gone_key))
    return docs.join(gone, same, "left_anti")
