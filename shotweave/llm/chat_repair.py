"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with the
assistant. Each turn of a table may keep its role, be relabelled, be merged into the turn before it (if that now has
the same role), or follow an inserted empty turn; each has a cost. The states of the automaton are the role
written last. Dynamic programming from the end gives the cheapest cost to go from every state; the walk from the
start then takes, at each turn, the first action in the fixed order keep, merge, relabel, insert (then user
before assistant before system) that reaches it, so ties are settled alike wherever a conversation is cut.

Rows are dealt to tasks by ranges of (conversation, turn) and swept in order. Conversations inside a range are repaired
on the spot. A conversation that crosses ranges, however long, is never gathered: each of its segments is reduced to a
4 x 4 matrix of costs between states, the few matrices of a conversation give the cost to go at each segment's
end and then the state each segment starts from, and every segment is repaired on its own with these.

The result has one row per input row with the text it renders to; a conversation's rendering is the concatenation
of its rows' pieces in order.

Defined results: turns are ordered by turn (null last), role, text; unknown or null roles must be relabelled; a null text
counts as empty; equal rows each stay a turn; rows with a null conv_id are left out; a conversation of system turns
only gets an empty user and assistant turn; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.llm.common import durable

ROLES = ["system", "user", "assistant"]
START, SYSTEM, USER, ASSISTANT = 3, 0, 1, 2
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
COST = {"keep": 0, "merge": 1, "relabel": 2, "insert": 3}
ROWS_PER_RANGE = 50_000
INF = 1 << 40

OUT = ("conv_id long, turn long, role string, new_role string, action string, cost int, piece string")


def _actions(role: int) -> list[list[tuple[int, int, str, tuple[int, ...]]]]:
    """For each state: (cost, state after, name, inserted roles) of what a turn of ``role`` (3: unknown) can do, in order
    of preference among equal totals."""
    table = []
    for state in range(4):
        rows = []
        for target in (USER, ASSISTANT, SYSTEM):
            change = 0 if target == role else COST["relabel"]
            if target in FOLLOWS[state]:
                rows.append((change, target, "relabel" if change else "keep", ()))
            if target == state:
                rows.append((change + COST["merge"], target, "relabel+merge" if change else "merge", ()))
            for between in FOLLOWS[state]:
                if between != SYSTEM and target in FOLLOWS[between]:
                    rows.append((change + COST["insert"], target, "insert+relabel" if change else "insert", (between,)))
        order = ["keep", "merge", "relabel", "relabel+merge", "insert", "insert+relabel"]
        table.append(sorted(rows, key=lambda r: order.index(r[2])))
    return table


ACTIONS = [_actions(r) for r in range(4)]
#: What ends a conversation in each state: (cost, inserted roles).
CLOSING = {START: (0, ()), SYSTEM: (2 * COST["insert"], (USER, ASSISTANT)), USER: (COST["insert"], (ASSISTANT,)), ASSISTANT: (0, ())}


def role_code(role) -> int:
    name = role.strip().lower() if isinstance(role, str) else ""
    return ROLES.index(name) if name in ROLES else 3


def costs_to_go(roles: list[int], end: list[int]) -> list[list[int]]:
    """Cheapest cost from every state in front of each turn (and behind the last one, ``end``)."""
    rows = [end]
    for r in reversed(roles):
        after = rows[-1]
        rows.append([min((c + after[t] for c, t, *_ in ACTIONS[r][s]), default=INF) for s in range(4)])
    return rows[::-1]


def walk(roles: list[int], state: int, end: list[int]) -> tuple[list[tuple], int]:
    """(the action of every turn, state behind the last one) of the repair that starts in ``state``."""
    to_go = costs_to_go(roles, end)
    out = []
    for i, r in enumerate(roles):
        action = next(a for a in ACTIONS[r][state] if a[0] + to_go[i + 1][a[1]] == to_go[i][state])
        out.append(action)
        state = action[1]
    return out, state


def matrix(roles: list[int]) -> list[list[int]]:
    """Cheapest cost from every state to every state over a segment."""
    return np.array([costs_to_go(roles, [0 if s == t else INF for s in range(4)])[0] for t in range(4)]).T.tolist()


def _head(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


def render(rows: list[tuple], actions: list[tuple], last: bool, state: int) -> list[tuple]:
    """Output rows of ``(conv_id, turn, role, text)`` rows: every turn's piece, the closing turns with the last one."""
    out = []
    for (conv, turn, role, text), (cost, target, name, inserted) in zip(rows, actions, strict=True):
        text = text if isinstance(text, str) else ""
        piece = "".join(_head(x) + "\n" for x in inserted)
        piece += ("\n" + text + "\n") if name.endswith("merge") else (_head(target) + text + "\n")
        out.append([conv, turn, role, ROLES[target], name, cost, piece])
    if last and out:
        cost, extra = CLOSING[state]
        out[-1][5] += cost
        out[-1][6] += "".join(_head(x) + "\n" for x in extra)
    return [tuple(r) for r in out]


CLOSED = [CLOSING[s][0] for s in range(4)]


def repair(rows: list[tuple]) -> list[tuple]:
    """The repaired rows of one whole conversation."""
    actions, state = walk([role_code(r[2]) for r in rows], START, CLOSED)
    return render(rows, actions, True, state)


def repair_chats(conversations: DataFrame) -> DataFrame:
    """Repaired rows of ``conversations(conv_id, turn, role, text)``: ``conv_id, turn, role, new_role, action string,
    cost int, piece string``."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"),
                                F.col("text").cast("string").alias("text")).where("conv_id is not null")
    spark = rows.sparkSession
    ranges = max(1, -(-rows.count() // ROWS_PER_RANGE), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.asc("conv_id"), F.asc_nulls_last("turn"), F.asc("role"), F.xxhash64("text").asc(), F.asc("text")]
    dealt = (rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
             .withColumn("seg", F.spark_partition_id()).withColumn("ord", F.monotonically_increasing_id()))

    def sweep(batches):
        """Conversations strictly inside the range are repaired; the first and the last one may cross it and stay raw."""
        held: list[tuple] = []
        first = True

        def done(rows):
            return [(*r, False, None, None, None) for r in repair([r[:4] for r in rows])]

        def raw(rows):
            return [(c, t, r, None, None, 0, None, True, s, o, x) for c, t, r, x, s, o in rows]

        def frame(rows):
            return pd.DataFrame(rows, columns=["conv_id", "turn", "role", "new_role", "action", "cost", "piece", "edge",
                                               "seg", "ord", "text"])

        for b in batches:
            out = []
            turns = b["turn"].astype(object).where(b["turn"].notna(), None)
            for row in zip(b["conv_id"].tolist(), turns.tolist(), b["role"].tolist(), b["text"].tolist(), b["seg"].tolist(),
                           b["ord"].tolist(), strict=True):
                if held and held[0][0] != row[0]:
                    out += raw(held) if first else done(held)
                    held, first = [], False
                held.append(row)
            if out:
                yield frame(out)
        if held:
            yield frame(raw(held))

    swept = durable(dealt.mapInPandas(sweep, OUT + ", edge boolean, seg int, ord long, text string"), "chats")
    edges = swept.where("edge").select("conv_id", "turn", "role", "text", "seg", "ord")
    inside = swept.where("not edge").select(*[c.split()[0] for c in OUT.split(", ")])
    return inside.unionByName(_across(edges))


def _across(edges: DataFrame) -> DataFrame:
    """Repair of conversations given in segments ``seg``."""

    def reduce_segment(key, pdf):
        roles = [role_code(r) for r in pdf.sort_values("ord")["role"]]
        return pd.DataFrame([(*key, sum(matrix(roles), []))], columns=["conv_id", "seg", "m"])

    def ends(key, pdf):
        """The cost to go behind each segment."""
        pdf = pdf.sort_values("seg")
        after, out = CLOSED, []
        for seg, m in reversed(list(zip(pdf["seg"], pdf["m"], strict=True))):
            out.append((key[0], int(seg), [int(x) for x in after]))
            m = np.asarray(m).reshape(4, 4)
            after = [int(x) for x in np.minimum((m + np.array(after)).min(1), INF)]
        return pd.DataFrame(out, columns=["conv_id", "seg", "after"])

    def exits(key, pdf):
        """The state each segment ends in, for every state it may start from."""
        roles = [role_code(r) for r in pdf.sort_values("ord")["role"]]
        after = [int(x) for x in pdf["after"].iloc[0]]
        go = costs_to_go(roles, after)[0]
        return pd.DataFrame([(*key, [walk(roles, s, after)[1] if go[s] < INF else -1 for s in range(4)])],
                            columns=["conv_id", "seg", "exit"])

    def entries(key, pdf):
        state, out = START, []
        segs = sorted(zip(pdf["seg"], pdf["exit"], strict=True), key=lambda x: x[0])
        for i, (seg, exit_) in enumerate(segs):
            out.append((key[0], int(seg), state, i == len(segs) - 1))
            state = int(exit_[state])
        return pd.DataFrame(out, columns=["conv_id", "seg", "entry", "last"])

    def finish(key, pdf):
        pdf = pdf.sort_values("ord")
        after = [int(x) for x in pdf["after"].iloc[0]]
        turns = pdf["turn"].astype(object).where(pdf["turn"].notna(), None)
        rows = list(zip(pdf["conv_id"].tolist(), turns.tolist(), pdf["role"].tolist(), pdf["text"].tolist(), strict=True))
        actions, state = walk([role_code(r[2]) for r in rows], int(pdf["entry"].iloc[0]), after)
        return pd.DataFrame(render(rows, actions, bool(pdf["last"].iloc[0]), state), columns=[c.split()[0] for c in OUT.split(", ")])

    at = ["conv_id", "seg"]
    parts = edges.groupBy(*at).applyInPandas(reduce_segment, "conv_id long, seg int, m array<long>")
    # a conversation has at most one segment per range
    after = durable(parts.groupBy("conv_id").applyInPandas(ends, "conv_id long, seg int, after array<long>"), "after")
    out = edges.join(after, at).groupBy(*at).applyInPandas(exits, "conv_id long, seg int, exit array<int>")
    enter = durable(out.groupBy("conv_id").applyInPandas(entries, "conv_id long, seg int, entry int, last boolean"), "entry")
    return edges.join(after, at).join(enter, at).groupBy(*at).applyInPandas(finish, OUT)
