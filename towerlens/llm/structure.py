"""Repair of damaged conversations by the cheapest edits, with a Viterbi search in parallel chunks.

A conversation is legal if its role initials read ``(s?(ua)+)?``. Rows may be kept, given the role
user or assistant, or deleted, and empty user or assistant turns may be inserted anywhere; blank
and repeated rows must be deleted, and a truncated row that is not deleted costs more.

The search runs backward: a vector holds, for each of four states of the roles written so far,
what the rest of the conversation costs. Conversations are cut into chunks of ``CHUNK`` rows, and
all chunks start at once, from a speculated vector (that of an ended conversation). The vector at
the start of a chunk is then given to the chunk before it, and a chunk whose vector was wrong runs
again, until the new and the old vectors of a row differ by one number for all states: all rows
before it keep theirs up to that number, as few vectors suffice to tell states apart. Passes end
when no vector at a border differs by more than such a number. With the vectors of all chunks the
audit is traced forward the same way: from a speculated state, with passes that put right the
chunks entered in another.

Among edits of equal cost the audit that comes first in ASCII is taken. An audit and the rows it
is for leave no choice of roles open.

Defined cases: rows are ordered by turn (null first), role and digest; a null conversation id is a
conversation of its own; a null role or text is one space; a role's first character counts, so a
role that has none fits nowhere; an empty table gives an empty result. Rows that are equal in role
and text to an earlier one of their conversation are duplicates, wherever they stand. Other columns
are not used.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from towerlens.llm import turns
from towerlens.session import materialise, work_folder

DELETE, INSERT, RELABEL, CUT_OFF = 4, 3, 3, 3
CHUNK = 4096

# Faults in the order in which they count.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
# Nothing written; a system turn; a user turn; an assistant turn written last.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
_FAR = 1 << 30

# A symbol is one byte for the fault and the initial of a row: 4 * fault + (0 to 2, 3 for others).
ENDED = (0, 2 * INSERT, INSERT, 0)


def _after_insertions(best):
    """What the states cost at most if empty turns are written first, in ``best``."""
    for _ in range(3):
        best = [min(best[s], INSERT + best[_NEXT[s]]) for s in range(4)]
    return best


def _choices(symbol, state):
    """(cost, letter, next state) of the edits that take a row, in ASCII order."""
    fault, initial = divmod(symbol, 4)
    yield DELETE, "D", state
    if fault in (BLANK, DUPLICATE):
        return
    more = CUT_OFF if fault == TRUNCATED else 0
    if initial < 3:
        to = (SYSTEM, USER, ASSISTANT)[initial]
        if to == _NEXT[state] or (to == SYSTEM and state == START):
            yield more, "K", to
    yield RELABEL + more, "R", _NEXT[state]


class Steps:
    """The steps of the search, each worked out once: vectors that differ by a number are one."""

    def __init__(self):
        self._back, self._edits = {}, {}

    def back(self, vector, symbol):
        """The vector before a row from the vector behind it, both less their least value."""
        found = self._back.get((vector, symbol))
        if found is None:
            best = [min(cost + vector[to] for cost, _, to in _choices(symbol, s)) for s in range(4)]
            best = _after_insertions(best)
            found = self._back[vector, symbol] = tuple(b - min(best) for b in best)
        return found

    def edits(self, behind, symbol, state):
        """(letters, state after the row): the edits up to and with a row, first in ASCII of the
        cheapest; ``behind`` is the vector behind the row."""
        found = self._edits.get((behind, symbol, state))
        if found is None:
            best = [min(cost + behind[to] for cost, _, to in _choices(symbol, s)) for s in range(4)]
            best = _after_insertions(best)
            letters, at = "", state
            while True:
                options = list(_choices(symbol, at))
                steps = sorted([(letter, cost + behind[to], to) for cost, letter, to in options]
                               + [("I", INSERT + best[_NEXT[at]], _NEXT[at])])
                letter, _, to = next(s for s in steps if s[1] == best[at])
                letters, at = letters + letter, to
                if letter != "I":
                    break
            found = self._edits[behind, symbol, state] = (letters, at)
        return found


def closing(state):
    """Insertions behind the last row."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


def least(vector):
    low = min(vector)
    return tuple(int(v) - low for v in vector)


def run_back(steps, symbols, vector):
    """The vector in front of a chunk from the one behind it."""
    for symbol in reversed(symbols):
        vector = steps.back(vector, symbol)
    return vector


def mend_back(steps, symbols, old, old_front, new):
    """As ``run_back`` from ``new``, where ``old`` gave ``old_front``: stops where both agree."""
    for symbol in reversed(symbols):
        if old == new:
            return old_front
        old, new = steps.back(old, symbol), steps.back(new, symbol)
    return new


def vectors(steps, symbols, vector):
    """The vector behind each row."""
    out = []
    for symbol in reversed(symbols):
        out.append(vector)
        vector = steps.back(vector, symbol)
    return out[::-1]


def trace(steps, symbols, vector, state):
    """(letters of each row, state behind the chunk) from a state in front of it."""
    out = []
    for behind, symbol in zip(vectors(steps, symbols, vector), symbols):
        letters, state = steps.edits(behind, symbol, state)
        out.append(letters)
    return out, state


# ---- the search over all conversations ----------------------------------------------------------

_CHUNKS = "conv_id long, chunk long, symbols binary, last boolean"


def _grouped(batches):
    """Yield (conv_id, chunk, rows) of sorted batches whose first columns are these."""
    head, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != head:
                if held:
                    yield (*head, held)
                head, held = row[:2], []
            held.append(row[2:])
    if held:
        yield (*head, held)


def faults(rows):
    """Turns in order with their rank, initial and first fault; written once.

    ``rows`` has (conv_id, turn, role, text); the result has no other columns than these and
    ``rank``, ``fault``, ``initial``.
    """
    filled = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("digest", turns.digest("role", "text"))
    placed = turns.placed(filled, turns.turn_order())
    ranked = turns.with_rank(placed, turns.carries(placed)[0]).drop("part", "local", "l1", "l2")
    first = ranked.groupBy("conv_id", "digest").agg(F.min("rank").alias("rank"))
    first = first.select(F.col("conv_id").alias("_conv"), F.col("rank").alias("_rank"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("rank") == F.col("_rank"))
    solid = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    end = F.substring(solid, -1, 1)
    initial = F.substring("role", 1, 1)
    fault = (
        F.when(solid == "", BLANK)
        .when(F.col("_rank").isNull(), DUPLICATE)
        .when(~end.isin(".", "!", "?"), TRUNCATED)
        .otherwise(FINE)
    )
    return materialise(
        ranked.join(first, same, "left").select(
            "conv_id", "turn", "role", "text", "rank", fault.alias("fault"),
            F.when(F.length(initial) == 0, 3)
            .otherwise(F.coalesce(F.nullif(F.instr(F.lit(INITIALS), initial), F.lit(0)) - 1, F.lit(3)))
            .alias("initial"),
        )
    )


def _chunks(found):
    """Symbols of every chunk in one row of ``CHUNK`` bytes at most, written once."""
    rows = found.select(
        "conv_id", F.floor((F.col("rank") - 1) / CHUNK).cast("long").alias("chunk"), "rank",
        (F.col("fault") * 4 + F.col("initial")).cast("int").alias("symbol"),
    )
    rows = rows.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "rank")

    def run(batches):
        out = []
        for conv, chunk, held in _grouped(batches):
            out.append((conv, chunk, bytes(s for _, s in held)))
            if len(out) >= 5_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out):
        kinds = [pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "chunk", "symbols"]
        )

    made = materialise(rows.mapInArrow(run, "conv_id long, chunk long, symbols binary"))
    ends = made.groupBy("conv_id").agg(F.max("chunk").alias("_last"))
    # One row per conversation on both sides of most joins here, and one per chunk at most.
    known = ends.withColumnRenamed("conv_id", "_conv")
    joined = made.join(known, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return joined.select("conv_id", "chunk", "symbols", (F.col("chunk") == F.col("_last")).alias("last"))


def _neighbour(frame, step, **columns):
    """``frame`` with ``columns`` (new name = old name) of the chunk ``step`` away."""
    other = frame.select(
        F.col("conv_id").alias("_conv"), (F.col("chunk") - step).alias("_chunk"),
        *[F.col(old).alias(new) for new, old in columns.items()],
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk"))
    return frame.join(other, same, "left").drop("_conv", "_chunk")


def _mapped(frame, names, kinds, schema, work):
    """Call ``work(steps, row)`` per row; its results are rows of ``schema``."""

    def run(batches):
        steps = Steps()
        for batch in batches:
            out = [work(steps, row) for row in zip(*(batch.column(n).to_pylist() for n in names))]
            columns = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=[s.split()[0] for s in schema.split(", ")]
            )

    return frame.mapInArrow(run, schema)


_LONGS = pa.list_(pa.int64())
_VECTORS = f"{_CHUNKS}, behind array<long>, front array<long>"
_STATES = f"{_VECTORS}, enter long, leave long"
_HEAD = [pa.int64(), pa.int64(), pa.binary(), pa.bool_()]


def _passes(chunks, names, kinds, schema, start, mend, step, given):
    """Run ``start`` on all chunks, then ``mend`` with column ``given`` of the chunk ``step`` away,
    until a pass changes nothing. Returns the chunks and the number of passes that changed some.

    Every pass is a table in the shared folder, so the next one plans with its real size.
    """
    spark, folder = chunks.sparkSession, work_folder(chunks.sparkSession)
    kinds, schema = [*kinds, pa.bool_()], f"{schema}, changed boolean"

    def stored(frame, n):
        frame.write.parquet(f"{folder}/{n}")
        return spark.read.parquet(f"{folder}/{n}")

    made, passes = stored(_mapped(chunks, names, kinds, schema, start), 0), 1
    if made.filter("NOT last").isEmpty():
        return made.drop("changed"), passes
    held = [c.split()[0] for c in schema.split(", ")][:-1]
    while True:
        after = _neighbour(made.drop("changed"), step, given=given)
        made = stored(_mapped(after, [*held, "given"], kinds, schema, mend), passes)
        if made.filter("changed").isEmpty():
            return made.drop("changed"), passes
        passes += 1


def backward(chunks):
    """Chunks with the vectors behind and in front of them, right up to a number; and the passes."""

    def start(steps, row):
        front = run_back(steps, row[2], least(ENDED))
        return *row, list(least(ENDED)), list(front), True

    def mend(steps, row):
        *head, behind, front, given = row
        changed = given is not None and given != behind
        if changed:
            front = list(mend_back(steps, head[2], tuple(behind), tuple(front), tuple(given)))
            behind = given
        return *head, behind, front, changed

    names = [c.split()[0] for c in _CHUNKS.split(", ")]
    return _passes(chunks, names, [*_HEAD, _LONGS, _LONGS], _VECTORS, start, mend, 1, "front")


def forward(chunks):
    """Chunks with the states in which the cheapest edits enter and leave them; and the passes."""

    def start(steps, row):
        # What follows a chunk's start is entered as behind an assistant turn, but for the first.
        enter = START if row[1] == 0 else ASSISTANT
        return *row, enter, trace(steps, row[2], tuple(row[4]), enter)[1], True

    def mend(steps, row):
        *head, enter, leave, given = row
        changed = given is not None and given != enter
        if changed:
            leave = trace(steps, head[2], tuple(head[4]), given)[1]
            enter = given
        return *head, enter, leave, changed

    names = [c.split()[0] for c in _VECTORS.split(", ")]
    kinds = [*_HEAD, _LONGS, _LONGS, pa.int64(), pa.int64()]
    return _passes(chunks, names, kinds, _STATES, start, mend, -1, "leave")


_EDITS = "conv_id long, rank long, letters string, enter long, closing string"


def edits(states):
    """(conv_id, rank, letters, enter, closing) of each row: its edits in order, the state in front
    of them, and the insertions behind the last row of a conversation."""

    def run(batches):
        steps = Steps()
        for batch in batches:
            for conv, chunk, symbols, last, behind, _, enter, _ in zip(*(c.to_pylist() for c in batch.columns)):
                made, leave = trace(steps, symbols, tuple(behind), enter)
                at, before = enter, []
                for letters, symbol in zip(made, symbols):
                    before.append(at)
                    at = _written(letters, symbol, at)[1]
                end = [""] * len(made)
                if last:
                    end[-1] = closing(leave)
                n = len(made)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv] * n, pa.int64()), pa.array(np.arange(n) + chunk * CHUNK + 1),
                     pa.array(made), pa.array(before, pa.int64()), pa.array(end)],
                    names=[c.split()[0] for c in _EDITS.split(", ")],
                )

    return states.mapInArrow(run, _EDITS)


def _written(letters, symbol, state):
    """([(letter, role or None for the row's own)], state after) of the edits of one row."""
    out = []
    for letter in letters:
        if letter == "D":
            out.append((letter, None))
        elif letter == "K":
            state = SYSTEM + symbol % 4
            out.append((letter, None))
        else:
            state = _NEXT[state]
            out.append((letter, _ROLE[state]))
    return out, state


REPAIRED = (
    "conv_id long, rank long, step int, turn long, edit string, role string, text string, cost long, "
    "fault int"
)


def repaired(found):
    """One row per edit, in the order of (rank, step): what was done, and the turn it gives.

    ``found`` is of ``faults``. Deleted rows have a null role; inserted turns have an empty text
    and no turn number. ``cost`` is that of the edit.
    """
    states, _ = forward(backward(_chunks(found))[0])
    # A byte of a chunk becomes a row: the chunks are dealt to all tasks, and the rows are shuffled,
    # as Spark takes their size for that of the chunks.
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = edits(states.repartition(tasks, "conv_id", "chunk")).hint("merge")
    made = made.withColumnsRenamed({"conv_id": "_conv", "rank": "_rank"})
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("rank") == F.col("_rank"))
    rows = found.join(made, same).select(
        "conv_id", "rank", "turn", "role", "text", "fault", "initial", "letters", "enter", "closing"
    )
    schema = REPAIRED

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32()]

        def batch_of(out):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in schema.split(", ")]
            )

        for batch in batches:
            out, size = [], 0
            for conv, rank, turn, role, text, fault, initial, letters, enter, end in zip(*(c.to_pylist() for c in batch.columns)):
                steps, state = _written(letters, fault * 4 + initial, enter)
                more = CUT_OFF if fault == TRUNCATED else 0
                for n, (letter, to) in enumerate(steps):
                    if letter == "D":
                        row = (turn, "D", None, None, DELETE, fault)
                    elif letter == "I":
                        row = (None, "I", to, "", INSERT, None)
                    else:
                        row = (turn, letter, to or role, text, more + (RELABEL if letter == "R" else 0), fault)
                    out.append((conv, rank, n, *row))
                for n, letter in enumerate(end):
                    state = _NEXT[state]
                    out.append((conv, rank, len(steps) + n, None, "I", _ROLE[state], "", INSERT, None))
                size += len(text)
                if size > 1 << 22:
                    yield batch_of(out)
                    out, size = [], 0
            if out:
                yield batch_of(out)

    return rows.mapInArrow(run, schema)


def transcripts(edited):
    """(conv_id, audit, repaired_sha256) per conversation of ``repaired`` rows.

    The hash is of ``role:text`` joined by line feeds, one stream by its nature: a task reads the
    turns of a conversation in order and holds none of them.
    """
    order = ["conv_id", "rank", "step"]
    rows = edited.select(*order, "edit", F.concat_ws(":", "role", "text").alias("line"))
    rows = rows.withColumn("line", F.when(F.col("edit") != "D", F.col("line")))
    rows = rows.repartition("conv_id").sortWithinPartitions(*order)

    def run(batches):
        name, audit, made, empty = (), [], None, True
        out = []

        def close():
            out.append((*name, "".join(audit), made.hexdigest()))

        def batch_of():
            kinds = [pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "audit", "repaired_sha256"]
            )

        for batch in batches:
            for conv, _, _, letter, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv,) != name:
                    if name:
                        close()
                    name, audit, made, empty = (conv,), [], hashlib.sha256(), True
                audit.append(letter)
                if line is not None:
                    made.update((line if empty else "\n" + line).encode())
                    empty = False
            if out:
                yield batch_of()
                out.clear()
        if name:
            close()
            yield batch_of()

    return rows.mapInArrow(run, "conv_id long, audit string, repaired_sha256 string")


def illegal(found):
    """(conv_id, illegal): neighbours whose role initials are not su, ua or au."""
    rows = found.select("conv_id", "rank", "initial")
    after = rows.select(F.col("conv_id").alias("_conv"), (F.col("rank") - 1).alias("_rank"), F.col("initial").alias("_then"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("rank") == F.col("_rank"))
    pair = F.col("initial") * 4 + F.col("_then")
    wrong = ~pair.isin(0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1)
    return rows.join(after, same).groupBy("conv_id").agg(F.count_if(wrong).alias("illegal"))


def summary(found, edited):
    """One row per conversation of ``found``: gaps, counts of faults, cost, audit, hash."""
    numbers = found.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    counts = found.groupBy("conv_id").agg(
        *[F.count_if(F.col("fault") == f).alias(n) for f, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))]
    )
    costs = edited.groupBy("conv_id").agg(F.sum("cost").alias("cost"))
    out = counts
    for other in (numbers, illegal(found), costs, transcripts(edited)):
        renamed = other.withColumnRenamed("conv_id", "_conv")
        out = out.join(renamed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return out.fillna(0, ["illegal"]).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )
