"""Turns of conversations in order, numbered over all tasks.

Rows are sorted over tasks by conversation and order, so a conversation of any number of turns lies
in as many tasks as it needs. Each task numbers its rows for itself; only the last row of every
task meets on the driver, and gives the tasks behind it what a conversation had before.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from towerlens.llm.words import mix
from towerlens.session import materialise

# Bases of the two lanes of a prefix digest.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
DIGEST_BYTES = 16


def digest(*columns):
    """16 bytes that tell apart any two lists of strings; none may be null."""
    parts = [p for c in columns for p in (F.octet_length(c).cast("string"), F.lit(":"), F.col(c))]
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, DIGEST_BYTES)


def ordered_turns(conversations, *more):
    """(conv_id, turn, role, digest, size, ...) of all turns; a null role or text is empty.

    ``size`` is the number of UTF-8 bytes of the text.
    """
    filled = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return filled.select(
        "conv_id", "turn", "role", digest("role", "text").alias("digest"),
        F.octet_length("text").cast("long").alias("size"), *more,
    )


def turn_order():
    """The order of turns: null numbers first; turns of one number by role and digest."""
    return [F.asc_nulls_first("turn"), "role", "digest"]


def runs(conv, known, before):
    """Where runs of equal conversations begin in a batch, and if the first goes on from ``before``."""
    fresh = np.ones(len(conv), bool)
    fresh[1:] = (conv[1:] != conv[:-1]) | (known[1:] != known[:-1])
    if before is not None and len(conv):
        fresh[0] = (conv[0], known[0]) != before
    return fresh


def conversation_ids(column):
    """(numbers, which are known) of an Arrow column; a null counts as 0 and unknown."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False), known


def powers(base, start, count):
    """base ** (start + 1 .. start + count) modulo 2 ** 64."""
    first = np.uint64(pow(int(base), start + 1, 1 << 64))
    out = np.full(count, base, np.uint64)
    if count:
        out[0] = first
    return np.multiply.accumulate(out)


def placed(frame, order):
    """``frame`` sorted by conversation and ``order``, written once, with three kinds of columns more.

    ``part`` is the number of a task's range; ``local`` counts the rows of a conversation inside
    it from 1; ``l1`` and ``l2`` are polynomials of the digests up to the row, likewise.
    """
    ordered = frame.repartitionByRange(F.asc_nulls_first("conv_id"), *order)
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("conv_id"), *order)
    at = frame.columns.index("digest")
    schema = T.StructType(
        [*frame.schema.fields]
        + [T.StructField("part", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("local", "l1", "l2")]
    )

    def run(batches):
        part = TaskContext.get().partitionId()
        before, count, sums = None, 0, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, known = conversation_ids(batch.column(0))
            fresh = runs(conv, known, before)
            starts = np.flatnonzero(fresh)
            if not fresh[0]:
                starts = np.concatenate([[0], starts])
            length = np.diff(np.append(starts, len(conv)))
            held = np.zeros(len(starts), np.int64)
            if not fresh[0]:
                held[0] = count
            local = np.arange(len(conv)) - np.repeat(starts, length) + np.repeat(held, length) + 1
            raw = b"".join(batch.column(at).to_pylist())
            lanes = np.frombuffer(raw, "<u8").reshape(-1, 2)
            out = []
            for lane, base in enumerate(BASES):
                table = powers(base, 0, int(length.max()))
                inside = np.arange(len(conv)) - np.repeat(starts, length)
                scale = np.ones(len(starts), np.uint64)
                scale[0] = np.uint64(pow(int(base), int(held[0]), 1 << 64))
                terms = mix(lanes[:, lane]) * table[inside] * np.repeat(scale, length)
                total = np.cumsum(terms, dtype=np.uint64)
                offset = np.zeros(len(starts), np.uint64)
                offset[1:] = total[starts[1:] - 1]
                total = total - np.repeat(offset, length)
                if not fresh[0]:
                    total[: length[0]] += np.uint64(sums[lane])
                sums[lane] = int(total[-1])
                out.append(pa.array(total.view(np.int64)))
            before, count = (conv[-1], known[-1]), int(local[-1])
            yield pa.RecordBatch.from_arrays(
                batch.columns
                + [pa.array(np.full(len(conv), part, np.int32)), pa.array(local)]
                + out,
                names=[f.name for f in schema.fields],
            )

    return materialise(ordered.mapInArrow(run, schema))


def carries(frame):
    """{part: (conversation, rows before, l1, l2, next)} of conversations that go on from the part
    before; ``frame`` comes from ``placed``. One row per part comes to the driver.

    Also returns {part: the part behind it} for those whose last conversation goes on.
    """
    key = F.struct(F.col("conv_id").isNotNull(), "conv_id", "local")
    last = frame.groupBy("part").agg(
        F.max_by(F.struct("conv_id", "local", "l1", "l2"), key).alias("last"),
        F.min_by(F.struct("conv_id"), key).alias("first"),
    )
    found, onward = {}, {}
    held = None
    mask = (1 << 64) - 1
    for row in sorted(last.collect(), key=lambda r: r["part"]):
        part, end = row["part"], row["last"]
        if held is not None and row["first"]["conv_id"] == held[1]:
            found[part] = held[1:]
            onward[held[0]] = part
        count, lanes = end["local"], [end["l1"] & mask, end["l2"] & mask]
        if part in found and end["conv_id"] == held[1]:
            lanes = [
                (before + pow(int(base), held[2], 1 << 64) * lane) & mask
                for before, base, lane in zip(held[3:], BASES, lanes)
            ]
            count += held[2]
        held = (part, end["conv_id"], count, *lanes)
    return found, onward


def with_rank(frame, found):
    """Add ``rank``: the place of a row in its conversation, from 1. ``found`` is of ``carries``."""
    if not found:
        return frame.withColumn("rank", F.col("local"))
    rows = [(part, held[0], held[1]) for part, held in found.items()]
    known = frame.sparkSession.createDataFrame(rows, "_part int, _conv long, _base long")
    # One row per part at most.
    same = (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv"))
    joined = frame.join(F.broadcast(known), same, "left")
    return joined.withColumn("rank", F.col("local") + F.coalesce("_base", F.lit(0))).drop(
        "_part", "_conv", "_base"
    )
