"""Chat formatting with minimum-cost repair of the roles.

A legal conversation is an optional system turn, then user and assistant in turn, the assistant
last. Reading the turns in order, each may be kept, merged into the turn before, relabelled, or
preceded by empty turns, at the costs below; a dynamic programme over the role of the last written
turn finds the cheapest repair. Of repairs of one cost, a kept turn is preferred over a merged
one, then the smaller role number.

A stretch of turns acts on the four states as a matrix of costs, and such matrices multiply
(minimum for sum, sum for product). So a conversation is cut into chunks of ``CHUNK`` turn
numbers; tasks make one matrix per chunk, a chain of these small matrices fixes where each chunk
begins and ends, and tasks then trace every chunk for itself. No task needs a whole conversation.

Defined cases: turns are ordered by turn, role and text, null turn numbers last; repeated rows
count once; a null or unknown role fits none and is relabelled; a null text is empty; a
null conversation id is a conversation of its own; an empty table gives an empty result. Columns
other than the four named ones are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from towerlens.session import materialise

ROLES = ("system", "user", "assistant")
MERGE, RELABEL, INSERT = 1, 3, 2
CHUNK = 1024
START = 3
_FAR = 1 << 40
# Empty turns to write before a turn of the second role when the last one had the first.
_BETWEEN = {
    (START, 0): (), (START, 1): (), (START, 2): (1,),
    (0, 1): (), (0, 2): (1,),
    (1, 1): (2,), (1, 2): (),
    (2, 1): (), (2, 2): (1,),
}
# Empty turns to write behind the last turn.
_BEHIND = {0: (1, 2), 1: (2,), 2: (), START: ()}

TURNS = "conv_id long, turn long, role string, out_role string, merged boolean, inserted int, cost int, rendered string"


def steps(role):
    """All (from, to, cost, merged) by which a turn of ``role`` can be written."""
    out = []
    for before in range(4):
        for to in range(3):
            relabel = RELABEL * (role != ROLES[to])
            if before == to:
                out.append((before, to, MERGE + relabel, True))
            if (before, to) in _BETWEEN:
                out.append((before, to, INSERT * len(_BETWEEN[before, to]) + relabel, False))
    return sorted(out, key=lambda s: (s[2], s[3], s[1], s[0]))


_STEPS = {r: steps(r) for r in (*ROLES, None)}


def _steps(role):
    return _STEPS[role if role in ROLES else None]


def _role_matrix(role):
    out = np.full((4, 4), _FAR, np.int64)
    for before, to, cost, _ in _steps(role):
        out[before, to] = min(out[before, to], cost)
    return out


_MATRIX = {r: _role_matrix(r) for r in (*ROLES, None)}


def product(a, b):
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), _FAR)


def ends(matrix):
    """(cost, state) of the cheapest end of a whole conversation."""
    return min((int(matrix[s]) + INSERT * len(_BEHIND[s]), s) for s in range(4))


def trace(roles, enter, leave):
    """The cheapest steps through ``roles`` from state ``enter`` to state ``leave``."""
    best = np.full(4, _FAR, np.int64)
    best[enter] = 0
    back = []
    for role in roles:
        now, how = np.full(4, _FAR, np.int64), [None] * 4
        for step in _steps(role):
            cost = best[step[0]] + step[2]
            if cost < now[step[1]]:
                now[step[1]], how[step[1]] = cost, step
        best = now
        back.append(how)
    out, state = [], leave
    for how in reversed(back):
        out.append(how[state])
        state = how[state][0]
    return out[::-1]


def render(step, text, last):
    """The piece of the final string that a turn writes; pieces are joined in order."""
    before, to, _, merged = step
    if merged:
        piece = f"\n{text}"
    else:
        close = "" if before == START else "<|end|>\n"
        empty = "".join(f"<|{ROLES[r]}|>\n<|end|>\n" for r in _BETWEEN[before, to])
        piece = f"{close}{empty}<|{ROLES[to]}|>\n{text}"
    if last:
        piece += "<|end|>\n" + "".join(f"<|{ROLES[r]}|>\n<|end|>\n" for r in _BEHIND[to])
    return piece


def _chunks(batches):
    """Yield (conv_id, chunk, columns as lists) of sorted batches whose first columns are these."""
    held, head = None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != head:
                if held:
                    yield (*head, held)
                held, head = [], row[:2]
            held.append(row[2:])
    if held:
        yield (*head, held)


def _ordered(frame):
    return frame.repartition("conv_id", "chunk").sortWithinPartitions(
        F.asc_nulls_last("conv_id"), "chunk", F.asc_nulls_last("turn"), "role", "text"
    )


def repaired(turns):
    """One row per turn, in TURNS; ``rendered`` pieces in order of turns make the conversation."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(_FAR)).cast("long").alias("chunk"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    rows = materialise(_ordered(rows))

    def matrices(batches):
        out = []
        for conv, chunk, held in _chunks(batches):
            made = _MATRIX[held[0][1] if held[0][1] in ROLES else None]
            for turn in held[1:]:
                made = product(made, _MATRIX[turn[1] if turn[1] in ROLES else None])
            out.append((conv, chunk, made.ravel().tolist()))
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out):
        conv, chunk, made = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(conv, pa.int64()), pa.array(chunk, pa.int64()), pa.array(made, pa.list_(pa.int64()))],
            names=["conv_id", "chunk", "matrix"],
        )

    def chain(batches):
        names = ["conv_id", "chunk", "enter", "leave", "final"]
        for batch in batches:
            out = []
            for conv, parts in zip(*(c.to_pylist() for c in batch.columns)):
                made = [np.array(p["matrix"], np.int64).reshape(4, 4) for p in parts]
                cost = np.full(4, _FAR, np.int64)
                cost[START] = 0
                sums = [cost]
                for m in made:
                    sums.append(np.minimum((sums[-1][:, None] + m).min(0), _FAR))
                _, leave = ends(sums[-1])
                path = [leave]
                for m, before in zip(reversed(made), reversed(sums[:-1])):
                    path.append(int(np.argmin(before + m[:, path[-1]])))
                path.reverse()
                for i, part in enumerate(parts):
                    out.append((conv, part["chunk"], path[i], path[i + 1], i + 1 == len(parts)))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def write(batches):
        names = [x.split()[0] for x in TURNS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
        out = []
        for conv, _, held in _chunks(batches):
            enter, leave, final = held[0][3:6]
            done = trace([t[1] for t in held], enter, leave)
            for i, (step, (turn, role, text, *_)) in enumerate(zip(done, held)):
                last = final and i + 1 == len(held)
                empty = 0 if step[3] else len(_BETWEEN[step[0], step[1]])
                behind = len(_BEHIND[step[1]]) if last else 0
                out.append(
                    (conv, turn, role, ROLES[step[1]], step[3], empty + behind,
                     step[2] + INSERT * behind, render(step, text, last))
                )
            if len(out) >= 2_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    made = rows.mapInArrow(matrices, "conv_id long, chunk long, matrix array<long>")
    lists = made.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "matrix"))).alias("parts"))
    states = lists.mapInArrow(chain, "conv_id long, chunk long, enter int, leave int, final boolean")
    same = rows["conv_id"].eqNullSafe(states["conv_id"]) & (rows["chunk"] == states["chunk"])
    joined = rows.join(states, same).select(
        rows["conv_id"], rows["chunk"], "turn", "role", "text", "enter", "leave", "final"
    )
    return _ordered(joined).mapInArrow(write, TURNS)
