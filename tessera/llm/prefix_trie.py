"""Prefix trie of conversations by bursting containers.

A turn is an id of 24 bytes: 16 of a SHA-256 over role and text, 8 for the text's bytes. A
conversation is its turns' ids; equal ones become one sequence with a count. A container holds
the suffixes of the sequences below a head, at first all below the root. One that is oversized
bursts: the turns that all its suffixes share become a chain of nodes, and each next turn id
heads a container of its own. Containers that are small enough are dealt to shards, sorted,
and swept: a stack holds the path of the current suffix, and nodes are complete when they
leave it. What burst nodes need from below, sums over containers, is added up by their ids,
which each container carries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import stored

#: Turns in the suffixes of a container of several sequences, before it bursts.
CONTAINER_TURNS = 2000
#: Every LEADERS-th conversation lends its first turns, fewer than SHARED.
LEADERS, SHARED = 5, 9
NO_ENDS = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODE_NAMES = [x.split()[0] for x in _NODE.split(", ")]


def turn_sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: the conversations' turn ids in order of turn, null first, then role, then id.

    Null role and text are empty. Rows without a conversation id belong to no conversation. A repeated row is
    a turn of its own. A conversation is a row of 24 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turn_id = F.concat(F.substring(digest, 1, 16), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).alias("turn"), role.alias("role"), turn_id.alias("id")).alias("t"),
    )
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["id"]).alias("turns"))


def with_shared_starts(sequences: DataFrame) -> DataFrame:
    """Each conversation's first turns become those of its leader, as many as the CRC-32 of its id says."""
    lent = sequences.select(F.col("conv_id").alias("leader"), F.slice("turns", 1, SHARED - 1).alias("lent"))
    own = sequences.withColumn("leader", F.col("conv_id") - F.col("conv_id") % LEADERS)
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    start = F.coalesce(F.slice("lent", F.lit(1), h), F.expr("cast(array() as array<binary>)"))
    return own.join(lent, "leader", "left").select("conv_id", F.concat(start, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids that stand behind each other in a group as one text."""
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        runs = list(zip(cuts, [*cuts[1:], len(keys)], strict=True))
        texts = [",".join(map(str, ids[a:b])) for a, b in runs]
        yield pa.RecordBatch.from_pydict({"sequence": [keys[a] for a, _ in runs], "low": pa.array([ids[a] for a, _ in runs], pa.int64()), "part": texts})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 over each group's texts as they come by."""
    key, state = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for k, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(part.encode())
            else:
                state.update(b"," + part.encode())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in ([k for k, _ in done], [d for _, d in done])], names=["sequence", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_pydict({"sequence": [key], "ends": [state.hexdigest()]})


def id_digests(members: DataFrame) -> DataFrame:
    """sequence, ends: SHA-256 of the comma-joined ids of each sequence, ascending; members: sequence, conv_id.

    Ids are sorted and joined range by range; only their texts meet, and are hashed as they stream by.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = members.select("sequence", "conv_id").repartitionByRange(n, "sequence", "conv_id").sortWithinPartitions("sequence", "conv_id")
    parts = ordered.mapInArrow(_packed, "sequence string, low long, part string")
    return parts.repartition(n, "sequence").sortWithinPartitions("sequence", "low").mapInArrow(_hashed, "sequence string, ends string")


def distinct_sequences(rebuilt: DataFrame) -> DataFrame:
    """suffix, n, low, ends: each distinct sequence, its conversations' number, smallest id and digest of ids."""
    named = stored(rebuilt.withColumn("sequence", F.sha2(F.array_join(F.transform("turns", F.hex), ""), 256)), "sequences")
    counts = named.groupBy("sequence").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    one = named.drop("sequence").join(counts, "conv_id")
    return one.join(id_digests(named), "sequence").select(F.col("turns").alias("suffix"), "n", F.col("conv_id").alias("low"), "ends")


def _burst(rows: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The burst containers, those of their sequences that end at the burst node, and the rows in their new containers."""
    inside = rows.join(large, "head", "left_semi")
    same = [F.first(c).alias(c) for c in ("depth", "entry", "parent_conv", "path")]
    found = inside.groupBy("head").agg(F.min("suffix").alias("lo"), F.max("suffix").alias("hi"), F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"), *same)
    apart = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), False)
    bursts = stored(found.withColumn("shared", (apart - 1).cast("int")).withColumn("chain", F.slice("lo", F.lit(1), F.col("shared"))).drop("lo", "hi"), "bursts")
    moved = inside.join(bursts.select("head", "shared", F.col("conv_id").alias("above")), "head")
    ended = moved.where("size(suffix) = shared").select("head", "ends")
    entry = F.element_at("suffix", F.col("shared") + 1)
    further = moved.where("size(suffix) > shared").select(
        F.sha2(F.concat(F.col("head"), F.hex(entry)), 256).alias("head"),
        (F.col("depth") + F.col("shared") + 1).alias("depth"),
        entry.alias("entry"),
        F.col("above").alias("parent_conv"),
        F.array_append("path", F.col("head")).alias("path"),
        F.slice("suffix", F.col("shared") + 2, F.size("suffix")).alias("suffix"),
        "n", "low", "ends",
    )
    return bursts, ended, further


def containers(sequences: DataFrame) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """The rows of all containers that stay, and for each round the burst ones with the sequences that end there."""
    rows = sequences.select(
        F.lit("").alias("head"), F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("entry"), F.lit(None).cast("long").alias("parent_conv"),
        F.expr("cast(array() as array<string>)").alias("path"), "suffix", "n", "low", "ends",
    )
    settled, burst = [], []
    while True:
        rows = stored(rows, "suffixes")
        sizes = rows.groupBy("head").agg(F.count("*").alias("rows"), F.sum(F.size("suffix")).alias("turns"))
        large = stored(sizes.where(f"rows > 1 and turns > {CONTAINER_TURNS}").select("head"), "oversized")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*settled, rows]), burst
        settled.append(rows.join(large, "head", "left_anti"))
        bursts, ended, rows = _burst(rows, large)
        burst.append((bursts, ended))


def text_bytes(turn_id: bytes | None) -> int:
    return int.from_bytes(turn_id[16:], "big") if turn_id else 0


def swept(depth: int, entry: bytes | None, above: int | None, rows: list[tuple[list[bytes], int, int, str]]) -> list[tuple]:
    """The nodes of a container, its head first, from its sorted suffixes (turns, conversations, smallest id, digest).

    A node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    parent, low, count, children, leaves, saved, size, ends = [-1], [None], [0], [0], [0], [0], [text_bytes(entry)], [NO_ENDS]
    depths, stack, before = [depth], [0], []

    def leave(down_to: int) -> None:
        while len(stack) > down_to:
            at = stack.pop()
            leaves[at] = leaves[at] or 1
            saved[at] += (count[at] - 1) * size[at]
            up = parent[at]
            if up >= 0:
                count[up] += count[at]
                low[up] = low[at] if low[up] is None else min(low[up], low[at])
                children[up] += 1
                leaves[up] += leaves[at]
                saved[up] += saved[at]

    for turns, n, smallest, digest in rows:
        common = 0
        while common < len(before) and common < len(turns) and before[common] == turns[common]:
            common += 1
        leave(common + 1)
        for i in range(common, len(turns)):
            parent.append(stack[-1])
            stack.append(len(depths))
            depths.append(depth + i + 1)
            for column, value in ((low, None), (count, 0), (children, 0), (leaves, 0), (saved, 0), (size, text_bytes(turns[i])), (ends, NO_ENDS)):
                column.append(value)
        at = stack[-1]
        count[at] += n
        low[at] = smallest if low[at] is None else min(low[at], smallest)
        ends[at] = digest
        before = turns
    leave(0)
    above_of = [above if p < 0 else low[p] for p in parent]
    return list(zip(low, depths, above_of, count, children, leaves, saved, ends, strict=True))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted containers; one container at a time is held."""
    names = [*_NODE_NAMES, "head", "path"]
    schema = pa.schema([*((n, pa.string() if n == "ends_sha256" else pa.int64()) for n in _NODE_NAMES), ("head", pa.string()), ("path", pa.list_(pa.string()))])
    head, first, rows = None, None, []

    def nodes() -> list[tuple]:
        found = swept(first["depth"], first["entry"], first["parent_conv"], rows)
        return [(*node, *((head, first["path"]) if i == 0 else (None, None))) for i, node in enumerate(found)]

    def out(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: [x[i] for x in found] for i, n in enumerate(names)}, schema=schema)

    for batch in batches:
        found: list[tuple] = []
        for row in batch.to_pylist():
            if row["head"] != head:
                found += nodes() if rows else []
                head, first, rows = row["head"], row, []
            rows.append((row["suffix"], row["n"], row["low"], row["ends"]))
        yield out(found)
    if rows:
        yield out(nodes())


def _burst_nodes(bursts: DataFrame, ended: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes of the burst containers' chains; tops: path, n_leaves and saved_tokens of all containers."""
    down = tops.select("n_leaves", "saved_tokens", F.size("path").alias("n"), F.posexplode("path").alias("i", "head"))
    below = down.groupBy("head").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"), F.count(F.when(F.col("i") == F.col("n") - 1, 1)).alias("heads")
    )
    chain = bursts.select("*", F.posexplode(F.concat(F.array("entry"), "chain")).alias("i", "turn")).join(below, "head").join(ended, "head", "left")
    onward = Window.partitionBy("head").orderBy(F.col("i").desc())
    last = F.col("i") == F.col("shared")
    return chain.select(
        "conv_id",
        (F.col("depth") + F.col("i")).cast("long").alias("depth"),
        F.when(F.col("i") == 0, F.col("parent_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("heads")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved") + F.sum(_own_saving("turn")).over(onward)).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def _own_saving(turn: str) -> Column:
    size = F.conv(F.hex(F.substring(turn, 17, 8)), 16, 10).cast("long")
    return (F.col("n_convs") - 1) * F.coalesce(size, F.lit(0))


def trie_of(sequences: DataFrame) -> DataFrame:
    """The trie's nodes from distinct sequences, see distinct_sequences(); columns as prefix_trie() says."""
    settled, rounds = containers(sequences)
    small = settled.repartition("head").sortWithinPartitions("head", "suffix").mapInArrow(_sweep, f"{_NODE}, head string, path array<string>")
    small = stored(small, "nodes")
    nodes = small.drop("head", "path")
    if not rounds:
        return nodes
    bursts, ended = (reduce(DataFrame.unionByName, x) for x in zip(*rounds, strict=True))
    turns = F.concat(F.array("entry"), "chain")
    own = F.aggregate(turns, F.lit(0).cast("long"), lambda total, t: total + F.coalesce(F.conv(F.hex(F.substring(t, 17, 8)), 16, 10).cast("long"), F.lit(0)))
    tops = small.where("head is not null").select("path", "n_leaves", "saved_tokens")
    tops = tops.unionByName(bursts.select("path", F.lit(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * own).alias("saved_tokens")))
    return nodes.unionByName(_burst_nodes(bursts, ended, tops))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are rebuilt, see turn_sequences() and with_shared_starts(); turnless ones end at the root. An
    empty table has no nodes, not even a root. Further columns are of no account, whatever they are called.
    """
    sequences = stored(turn_sequences(conversations), "conversations")
    return trie_of(distinct_sequences(with_shared_starts(sequences)))
