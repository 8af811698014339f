"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant in turn, the
last an assistant's. For each turn the repair keeps it, relabels it, merges it into the
message before, or puts an empty message before it; a dynamic programme over the automaton
finds the cheapest repair. The step for a turn is a small min-plus matrix over the
automaton's states, and such matrices multiply: so a conversation that is spread over many
blocks is repaired exactly, block by block, and no conversation has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import stored

#: States: nothing yet, or the role of the last message.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: Names that stand for a role, in lower case.
ALIASES = {
    "system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "customer": USER,
    "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT,
}
UNKNOWN = 4
#: What may follow each state.
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs: joining two turns, another label, a label where there was none, an empty message.
MERGE, RELABEL, LABEL, INSERT = 2, 3, 1, 4
#: Turns of a block, about.
BLOCK_TURNS = 20_000
_FAR = 1 << 40


def _actions() -> dict[int, list[list[tuple[int, str, int]]]]:
    """For a declared role: [state][next state] -> (cost, action, inserted role or 0), the cheapest, first of equals."""
    out = {}
    for role in (SYSTEM, USER, ASSISTANT, UNKNOWN):
        table = [[(_FAR, "", 0)] * 4 for _ in range(4)]
        for s in range(4):
            for t in (SYSTEM, USER, ASSISTANT):
                label = 0 if t == role else LABEL if role == UNKNOWN else RELABEL
                word = "keep" if t == role else "relabel"
                options = [(label, word, 0)] if t in FOLLOWS[s] else []
                if s == t:
                    options.append((MERGE + label, "merge" if t == role else "relabel_merge", 0))
                options += [(INSERT + label, f"insert_{word}", m) for m in FOLLOWS[s] if t in FOLLOWS[m]]
                if options:
                    table[s][t] = min(options, key=lambda x: x[0])
        out[role] = table
    return out


ACTIONS = _actions()
COSTS = {role: np.array([[x[0] for x in row] for row in table]) for role, table in ACTIONS.items()}
#: Ending after a user or a system message takes empty ones behind it.
END_COST = [0, 2 * INSERT, INSERT, 0]


def role_of(name: str | None) -> int:
    return ALIASES.get((name or "").strip().lower(), UNKNOWN)


def product(roles: list[int]) -> np.ndarray:
    """Cheapest cost from each state to each over the turns; min-plus product of their matrices."""
    total = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for role in roles:
        total = np.minimum((total[:, :, None] + COSTS[role][None, :, :]).min(axis=1), _FAR)
    return total


def repaired(roles: list[int], entry: int, leave: int | None) -> list[tuple[int, int]]:
    """(state before, state after) of each turn on the cheapest path; of equal paths, the one with the smallest last states.

    leave: the state to end in, or None at the conversation's end.
    """
    best = [0 if s == entry else _FAR for s in range(4)]
    back = []
    for role in roles:
        costs = COSTS[role]
        came = [min(range(4), key=lambda s: best[s] + costs[s, t]) for t in range(4)]  # noqa: B023
        best = [min(_FAR, best[s] + int(costs[s, t])) for t, s in enumerate(came)]
        back.append(came)
    state = leave if leave is not None else min(range(4), key=lambda s: best[s] + END_COST[s])
    out = []
    for came in reversed(back):
        out.append((came[state], state))
        state = came[state]
    return out[::-1]


def opened(role: int) -> str:
    return f"<|{NAMES[role]}|>\n"


CLOSED = "<|end|>\n"


def rendered(role: int, text: str | None, before: int, after: int, last: bool) -> tuple[str, str, int]:
    """A turn's action, its part of the rendered conversation, and the inserted role or 0."""
    _, action, inserted = ACTIONS[role][before][after]
    if action.endswith("merge"):
        out = "\n" + (text or "")
    else:
        out = CLOSED if before != START else ""
        if inserted:
            out += opened(inserted) + CLOSED
        out += opened(after) + (text or "")
    if last:
        out += CLOSED
        if after == SYSTEM:
            out += opened(USER) + CLOSED
        if after in (SYSTEM, USER):
            out += opened(ASSISTANT) + CLOSED
    return action, out, inserted


_EDGE = "conv_id long, block int, costs array<long>"
_OUT = "conv_id long, turn long, role string, place long, new_role string, action string, inserted string, cost long, rendered string"


def _segments(turns: pd.DataFrame) -> Iterator[tuple[int, int, int]]:
    ids = turns["conv_id"].to_numpy()
    cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else []
    for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
        yield int(ids[a]), int(a), int(b)


#: text_key is a hash: the order of turns is sampled on the driver, which texts would flood.
_ORDER = ["conv_id", "turn", "role", "text_key"]


def _edges(turns: pd.DataFrame) -> pd.DataFrame:
    """Min-plus products of the first and the last conversation of a block, which may go on in others."""
    turns = turns.sort_values(_ORDER, kind="stable", na_position="first")
    found = list(_segments(turns))
    roles, block = turns["role"].map(role_of).tolist(), int(turns["block"].iloc[0])
    ends = [found[0], *found[1:][-1:]]
    return pd.DataFrame(
        {"conv_id": [c for c, _, _ in ends], "block": block, "costs": [product(roles[a:b]).ravel().tolist() for _, a, b in ends]}
    )


def _bounds(parts: pd.DataFrame) -> pd.DataFrame:
    """States in which the cheapest path enters and leaves each block of a conversation."""
    parts = parts.sort_values("block").reset_index(drop=True)
    best, back = np.array([0, _FAR, _FAR, _FAR]), []
    for costs in parts["costs"]:
        step = best[:, None] + np.array(costs).reshape(4, 4)
        back.append(step.argmin(axis=0))
        best = np.minimum(step.min(axis=0), _FAR)
    state = int((best + END_COST).argmin())
    leaves, enters = [], []
    for came in reversed(back):
        leaves.append(state)
        state = int(came[state])
        enters.append(state)
    last = [False] * (len(parts) - 1) + [True]
    return pd.DataFrame({"conv_id": parts["conv_id"], "block": parts["block"], "entry": enters[::-1], "leave": leaves[::-1], "last": last})


def _repair(key, turns: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
    given = {r.conv_id: r for r in bounds.itertuples()}
    turns = turns.sort_values([*_ORDER, "text"], kind="stable", na_position="first")
    roles, texts = turns["role"].map(role_of).tolist(), turns["text"].tolist()
    rows = []
    for conv, a, b in _segments(turns):
        entry, leave, ends = START, None, True
        if conv in given:
            entry, leave, ends = int(given[conv].entry), int(given[conv].leave), bool(given[conv].last)
        for i, (before, after) in enumerate(repaired(roles[a:b], entry, leave), a):
            role, last = roles[i], ends and i == b - 1
            action, part, inserted = rendered(role, texts[i], before, after, last)
            cost = int(COSTS[role][before, after]) + (END_COST[after] if last else 0)
            rows.append((NAMES[after], action, NAMES.get(inserted), cost, part))
    out = turns[["conv_id", "turn", "role"]].reset_index(drop=True)
    out["place"] = (int(key[0]) << 32) + np.arange(len(out))
    more = pd.DataFrame(rows, columns=["new_role", "action", "inserted", "cost", "rendered"])
    return pd.concat([out, more], axis=1)


def repaired_turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per turn: conv_id, turn, role, place, new_role, action, inserted, cost, rendered.

    The turns' rendered parts, put together in the order of place, are the repaired
    conversation; costs add up to the least there is. Order is by turn, then role, nulls first,
    then a hash of the text; so repeated turns stand one behind the other and are merged or
    answered like any others. place rises in this order, but is not the same in every run. Roles are
    read in any case and under their usual other names; other roles and null are free to label.
    Null text is empty. Rows without a conversation id are one conversation, -1.
    """
    rows = conversations.select(
        F.coalesce(F.col(conv_col).cast("long"), F.lit(-1)).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
        F.col(text_col).alias("text"),
    )
    n = max(1, -(-rows.count() // BLOCK_TURNS), int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = stored(rows.repartitionByRange(n, *_ORDER).withColumn("block", F.spark_partition_id()), "turns")
    edges = blocks.drop("text").groupBy("block").applyInPandas(_edges, _EDGE)
    spread = stored(edges, "turn-edges")
    several = spread.groupBy("conv_id").count().where("count > 1").select("conv_id")
    bounds = (
        spread.join(several, "conv_id", "left_semi")
        .groupBy("conv_id")
        .applyInPandas(_bounds, "conv_id long, block int, entry int, leave int, last boolean")
    )
    return blocks.groupBy("block").cogroup(bounds.groupBy("block")).applyInPandas(_repair, _OUT)


def rendered_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, cost, rendered: whole conversations, for such as fit into a row."""
    parts = F.array_sort(F.collect_list(F.struct("place", "rendered")))
    return turns.groupBy("conv_id").agg(
        F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("rendered")
    )
