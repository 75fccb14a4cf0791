"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with assistant. Each turn may
keep its role or be relabelled, be merged into the turn before, or have an empty turn put before it; dynamic programming
over the automaton's states finds the cheapest way. A turn is a 4 x 4 matrix of costs between states, and matrices of
neighbouring stretches combine by min and plus. So a conversation of any length is cut where its rows are cut: turns
are sorted over all tasks, every task gives one matrix for each conversation that it has a stretch of, the stretches'
costs at their edges are combined for each conversation, and then every stretch is repaired by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .graph import by_group, edges

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
RELABEL, MERGE, INSERT, UNKNOWN = 2.0, 1.0, 3.0, 1.0
INF = float("inf")
#: For each state and new state: the role put before, as an empty turn, or 0 if none; absent if it can't be.
STEPS = {(START, SYSTEM): 0, (START, USER): 0, (SYSTEM, USER): 0, (ASSISTANT, USER): 0, (USER, ASSISTANT): 0, (START, ASSISTANT): USER, (SYSTEM, ASSISTANT): USER, (ASSISTANT, ASSISTANT): USER, (USER, USER): ASSISTANT}
END = "<|end|>\n"


def options(role: str | None) -> dict[tuple[int, int], tuple[float, str, int]]:
    """For each state before and after a turn of `role`: the cheapest (cost, action, role put before).

    Of equal costs, the first of keep, relabel, merge wins. Any role but the three, or none, is relabelled at less cost.
    """
    own = ROLES.index(role) + 1 if role in ROLES else 0
    out: dict[tuple[int, int], tuple[float, str, int]] = {}
    for (s, t), put in STEPS.items():
        change = 0.0 if t == own else RELABEL if own else UNKNOWN
        out[s, t] = (change + (INSERT if put else 0.0), "keep" if t == own else "relabel", put)
    for s in (SYSTEM, USER, ASSISTANT):
        cost = MERGE + (0.0 if s == own else RELABEL if own else UNKNOWN)
        if (s, s) not in out or cost < out[s, s][0]:
            out[s, s] = (cost, "merge", 0)
    return out


_OPTIONS = {r: options(r) for r in (*ROLES, None)}


def matrix(role: str | None) -> np.ndarray:
    m = np.full((4, 4), INF)
    for k, (cost, _, _) in _OPTIONS[role if role in ROLES else None].items():
        m[k] = cost
    return m


_MATRICES = {r: matrix(r) for r in (*ROLES, None)}
#: What it costs to end in each state, and the empty turns that it takes.
FINAL = np.array([INF, 2 * INSERT, INSERT, 0.0])
TAIL = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(1)


def known(role: str | None) -> str | None:
    r = role.strip().lower() if role else None
    return r if r in ROLES else None


def repair(roles: list[str | None], before: np.ndarray, last: int | None) -> list[tuple[str, str, int]]:
    """(role, action, role put before) of each turn of a stretch; `before` are the costs of the states it starts from.

    It ends in the state `last`, or in the cheapest when None. Of equal costs, the lower state is taken, from the end.
    """
    costs, came = np.array(before, float), []
    for r in roles:
        step = costs[:, None] + _MATRICES[r]
        came.append(step.argmin(0))
        costs = step.min(0)
    t = int((costs + FINAL).argmin()) if last is None else last
    out = []
    for r, back in zip(reversed(roles), reversed(came), strict=True):
        s = int(back[t])
        _, action, put = _OPTIONS[r][s, t]
        out.append((ROLES[t - 1], action, put))
        t = s
    return out[::-1]


def header(role: str) -> str:
    return f"<|{role}|>\n"


def piece(text: str, role: str, action: str, put: int, first: bool, final: bool) -> str:
    """What a turn adds to the rendered conversation: the pieces in order, joined, are the whole."""
    head = "" if first else "\n" if action == "merge" else END
    if put:
        head += header(ROLES[put - 1]) + END
    if action != "merge":
        head += header(role)
    tail = END + "".join(header(ROLES[t - 1]) + END for t in TAIL[ROLES.index(role) + 1]) if final else ""
    return head + text + tail


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, part, n, m) for each stretch, n its turns: rows come by part and place."""
    key, m, n, out = None, None, 0, []

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3].ravel().tolist() for r in rows], pa.list_(pa.float64()))], names=["conv", "part", "n", "m"])

    for batch in batches:
        for conv, part, role in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "role")), strict=True):
            step = _MATRICES[known(role)]
            if key == (conv, part):
                m, n = combine(m, step), n + 1
            else:
                if key:
                    out.append((*key, n, m))
                key, m, n = (conv, part), step, 1
        if len(out) > 4096:
            yield batch_of(out)
            out = []
    if key:
        out.append((*key, n, m))
    if out:
        yield batch_of(out)


def _edges(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each stretch: the turns and the costs of the states before it, the state after it, and whether it is first or last."""
    size = t.column("n").to_numpy()
    conv, part = t.column("conv").to_numpy(), t.column("part").to_numpy()
    ms = t.column("m").combine_chunks().flatten().to_numpy().reshape(-1, 4, 4)
    rows = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        order = lo + np.argsort(part[lo:hi], kind="stable")
        costs = [np.array([0.0, INF, INF, INF])]
        for k in order:
            costs.append((costs[-1][:, None] + ms[k]).min(0))
        state, ahead = int((costs[-1] + FINAL).argmin()), np.cumsum(size[order]) - size[order]
        for at in range(len(order) - 1, -1, -1):
            k = order[at]
            rows.append((conv[k], part[k], costs[at].tolist(), state, at == 0, at == len(order) - 1, int(ahead[at])))
            state = int((costs[at] + ms[k][:, state]).argmin())
    if rows:
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.bool_(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv", "part", "before", "after", "head", "tail", "ahead"])


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part and place; a stretch's roles are held until it ends, its texts in the batches they came in."""
    held: list[pa.RecordBatch] = []

    def solve(t: pa.Table) -> pa.RecordBatch:
        conv, part = t.column("conv").to_numpy(), t.column("part").to_numpy()
        cols = {c: t.column(c).to_pylist() for c in ("role", "text", "before", "after", "head", "tail", "ahead")}
        new, did, empty, out, place = [], [], [], [], []
        cuts = np.flatnonzero((conv[1:] != conv[:-1]) | (part[1:] != part[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(conv)], strict=True):
            fixed = repair([known(r) for r in cols["role"][lo:hi]], np.array(cols["before"][lo]), cols["after"][lo])
            for k, (role, action, put) in zip(range(lo, hi), fixed, strict=True):
                place.append(cols["ahead"][lo] + k - lo + 1)
                new.append(role)
                did.append(action)
                empty.append(int(bool(put)))
                out.append(piece(cols["text"][k] or "", role, action, put, k == lo and cols["head"][k], k == hi - 1 and cols["tail"][k]))
        return pa.RecordBatch.from_arrays([t.column("conv_id").combine_chunks(), t.column("turn").combine_chunks(), pa.array(place, pa.int64()), pa.array(new), pa.array(did), pa.array(empty, pa.int32()), pa.array(out)], names=["conv_id", "turn", "place", "role", "action", "n_inserted", "piece"])

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < 2048:
            continue
        t = pa.Table.from_batches(held)
        cut = int(edges(t.column("conv").to_numpy())[-2])
        if cut:
            yield solve(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield solve(pa.Table.from_batches(held))


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, place, role, action, n_inserted and piece of every row of `turns`; other columns are not read.

    Turns are in order of turn (null first), then role as given, then a hash of the text; equal rows are interchangeable.
    place counts from 1 in that order in each conversation. Roles are taken without blanks at their ends and in lower case.
    The pieces of a conversation by place, joined, are its rendering. Null text is empty. Rows with a null conv_id are one conversation. An empty table gives an empty result.
    Among repairs of equal cost, one is taken by fixed rules; reruns over the same files agree.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")
    ).withColumn("conv", F.coalesce("conv_id", F.lit(-(2**63) + 1).cast("long"))).withColumn("h", F.xxhash64("text"))
    order = ["conv", "turn", "role", "h"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()).drop("h"), "turns")
    stretch = placed.select("conv", "part", "place", "role").repartition("part").sortWithinPartitions("part", "place")
    parts = written(stretch.mapInArrow(_fold, "conv long, part int, n long, m array<double>"), "stretches")
    ends = written(by_group(parts, "conv", _edges, "conv long, part int, before array<double>, after int, head boolean, tail boolean, ahead long"), "edges")
    ready = placed.join(ends, ["conv", "part"]).repartition("part").sortWithinPartitions("part", "place")
    return ready.mapInArrow(_repair, "conv_id long, turn long, place long, role string, action string, n_inserted int, piece string")


def op2_chat(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    return format_chats(table(spark, sf_dir, "conversations"))
