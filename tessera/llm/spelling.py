"""Spelling variants: words one edit apart, each led to the more frequent form.

Two words are near if common prefix and common suffix together reach the longer length m minus
one. Then the longer half is common, at the front or at the end; so words meet in groups that
share m and the first half, or m and the last half, and a near pair meets once: behind the
last half only if the first differs. A group over GROUP words is split the same way on what
its words don't share yet, until one free place is left, where no more words than letters
can meet. Groups stand one behind the other in blocks, and block pairs that share a group are
compared as tiles of padded code-point matrices, column by column.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import stored

RUN = r"[A-Za-zÀ-ÿ]+"
#: One occurrence in so many loses a letter; length and occurrences of a word; how many times as frequent a form is.
ONE_IN, LEAST_LENGTH, LEAST_COUNT, TIMES = 97, 5, 3, 2
#: Words of a group before it is split, and of a block.
GROUP, BLOCK = 512, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A group: longer length, letters shared at the front and at the end, and the common prefix from which another group has the pair.
_KEY = ["m", "front", "back", "cap", "head", "tail"]
_PAIR = "word string, n long, near string, near_n long"


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n of the words that occur LEAST_COUNT times or more and have LEAST_LENGTH letters or more.

    One occurrence in ONE_IN, by the CRC-32 of ``id:word``, loses one letter. Null and empty texts have no
    words; a row without an id counts with an empty one. Counts are combined before they are shuffled.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(text_col, _UPPER, _LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.length("run") >= LEAST_LENGTH)
    h = F.crc32(F.concat("id", F.lit(":"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row in the group of its next first half and in that of its next last half."""
    free = F.col("m") - F.col("front") - F.col("back")
    first = F.floor(free / 2).cast("int")  # half of free - 1, rounded up
    groups = F.array(
        F.struct((F.col("front") + first).alias("front"), F.col("back"), F.col("cap")),
        F.struct(F.col("front"), (F.col("back") + free - first).alias("back"), F.least("cap", F.col("front") + first).alias("cap")),
    )
    halves = rows.select("word", "n", "m", F.explode(groups).alias("g")).select("word", "n", "m", "g.*")
    size = F.length("word")
    head, tail = F.substring("word", F.lit(1), F.col("front")), F.substring("word", size - F.col("back") + 1, F.col("back"))
    return halves.select("word", "n", *_KEY[:4], head.alias("head"), tail.alias("tail"))


def grouped(words: DataFrame) -> DataFrame:
    """The words, each in all its groups; no group that can be split has more than GROUP of them."""
    size = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("m"), F.lit(0).alias("front"), F.lit(0).alias("back"), (size + 2).alias("cap"))
    rows, settled = stored(_halved(whole.withColumn("cap", F.col("m") + 1)), "groups"), []
    while True:
        sizes = rows.groupBy(*_KEY).agg(F.count("*").alias("size"), F.count(F.when(F.length("word") == F.col("m"), 1)).alias("longer"))
        sizes = sizes.where("size > 1 and longer > 0")
        large = F.expr(f"size > {GROUP} and m - front - back > 1")
        sizes = stored(sizes.select(*_KEY, large.alias("large")), "group-sizes")
        settled.append(rows.join(sizes.where("not large").drop("large"), _KEY, "left_semi"))
        more = sizes.where("large").drop("large")
        if more.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        rows = stored(_halved(rows.join(more, _KEY, "left_semi")), "groups")


def _matrices(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points as columns, padded with 0 at the end, and padded at the front."""
    at = starts[None, :] + np.arange(m)[:, None]
    left = points[np.minimum(at, len(points) - 1)]
    right = points[np.maximum(at - (m - sizes)[None, :], 0)]
    left[-1, sizes < m] = 0
    right[0, sizes < m] = 0
    return left, right


def _common(one: np.ndarray, other: np.ndarray, together: np.ndarray) -> np.ndarray:
    """How many columns, from the first on, agree for each pair."""
    alive = together.copy()
    total = np.zeros(alive.shape, np.int32)
    for a, b in zip(one, other, strict=True):
        alive &= a[:, None] == b[None, :]
        if not alive.any():
            break
        total += alive
    return total


def near_places(words: list[str], lengths: np.ndarray, groups: np.ndarray, caps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the near pairs of words with a common group: numbers that rise; lengths: the m of each word's group."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    points = points.astype(np.min_scalar_type(int(points.max())))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    ends = np.searchsorted(groups, groups, "right")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    borders = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(words)]
    for lo, hi in zip(borders, borders[1:], strict=False):
        m = int(lengths[lo])
        for a in range(lo, hi, BLOCK):
            one = np.arange(a, min(a + BLOCK, hi))
            left, right = _matrices(points, starts[one], sizes[one], m)
            for b in range(a, int(ends[one[-1]]), BLOCK):
                two = np.arange(b, min(b + BLOCK, hi))
                other = (left, right) if a == b else _matrices(points, starts[two], sizes[two], m)
                together = groups[one][:, None] == groups[two][None, :]
                together &= (sizes[one] == m)[:, None] | (sizes[two] == m)[None, :]
                if a == b:
                    together &= one[:, None] < two[None, :]
                if not together.any():
                    continue
                prefix, suffix = _common(left, other[0], together), _common(right[::-1], other[1][::-1], together)
                i, j = np.nonzero(together & (prefix + suffix >= m - 1) & (prefix < caps[one][:, None]))
                found.append((one[i], two[j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _near(rows: pa.Table) -> pa.RecordBatch:
    """Near pairs of whole groups, in both directions."""
    n = rows.num_rows
    changed = np.zeros(n, bool)
    for name in _KEY:
        column = rows[name].combine_chunks()
        changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    lengths, caps = rows["m"].to_numpy().astype(np.int64), rows["cap"].to_numpy()
    words = rows["word"].to_pylist()
    i, j = near_places(words, lengths, np.cumsum(changed), caps)
    one, two = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
    word, count = rows["word"].combine_chunks(), rows["n"].combine_chunks()
    columns = [word.take(one), count.take(one), word.take(two), count.take(two)]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n", "near", "near_n"])


def _last_start(rows: pa.Table) -> int:
    """Where the last group begins."""
    start = 0
    for name in _KEY:
        column = rows[name].combine_chunks()
        other = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(other)
        start = max(start, int(at[-1]) + 1 if len(at) else 0)
    return start


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted rows; only the last group of a batch waits for the next one."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        at = _last_start(rows)
        if at:
            yield _near(rows.slice(0, at))
        kept = rows.slice(at)
    if kept is not None and kept.num_rows:
        yield _near(kept)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: each pair of words that one insertion, deletion or replacement parts, in both directions."""
    rows = grouped(words)
    return rows.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_near_pairs, _PAIR)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last by doubling; a form is twice as frequent, so few rounds do."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.drop("moved")
        now = step.drop("moved")


def variants(words: DataFrame) -> DataFrame:
    """word, n, form, root, n_near, form_n for a table of distinct words and their counts, word and n.

    form: the most frequent near word, the smallest of equals in code-point order, if it is TIMES as frequent;
    root: the last form of forms, or the word. A word without near words has n_near 0. An empty table gives none.
    """
    words = stored(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(words).groupBy("word").agg(F.first("n").alias("own"), F.count("*").alias("n_near"), best.alias("best"))
    strong = -F.col("best.less") >= TIMES * F.col("own")
    form, form_n = F.when(strong, F.col("best.near")), F.when(strong, -F.col("best.less"))
    forms = stored(near.select("word", "n_near", form.alias("form"), form_n.alias("form_n")), "forms")
    roots = _roots(forms.where("form is not null"))
    return (
        words.join(forms, "word", "left").join(roots, "word", "left")
        .select("word", "n", "form", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
    )


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """variants() of the words of all documents, see counted_words()."""
    return variants(counted_words(docs, id_col, text_col))
