"""Best-fit packing of token pieces into fixed-length sequences by minimum bin slack.

For each bin, a bitset subset-sum dynamic programme over the lengths that are still available
finds the fullest combination that holds the longest of them; it is then removed. The next bin
finds the same combination again as long as every length in it lasts, so it is removed that many
times at once. The programme only needs how often each length occurs, at most ``capacity``
numbers however many pieces there are; the pieces themselves are placed where they lie.

Defined cases: a null text counts as empty and is one piece that holds the end id; repeated rows
are packed each for itself; an empty table gives an empty result. Columns of the input other
than the key and the text are dropped by ``pieces`` and kept by ``place``.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from towerlens.llm.tokens import tokenizer_for
from towerlens.session import materialise

# Rows of one block in which pieces of a length are numbered.
BLOCK_ROWS = 4000

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def piece_bounds(n_tokens, capacity):
    """(piece, start, length) arrays and the document of each piece; only the first is shorter."""
    count = np.maximum(1, -(-n_tokens // capacity))
    head = n_tokens - (count - 1) * capacity
    doc = np.repeat(np.arange(len(n_tokens)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, head[doc], capacity)


def pieces(docs, tokenizer, capacity=2048, key="doc_id", text="text"):
    """Token pieces of at most ``capacity`` ids: key, piece, start, length, ids.

    ``ids`` holds little-endian unsigned 32-bit ids; the end id 0 closes each document.
    """

    def run(batches):
        encoder = tokenizer_for(tokenizer)
        for batch in batches:
            keys = batch.column(0)
            for first, ids, counts in encoder.blocks(batch.column(1)):
                doc, piece, start, length = piece_bounds(counts, capacity)
                ends = np.cumsum(length)
                data = pa.py_buffer(ids.astype("<u4").tobytes())
                offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
                binary = pa.Array.from_buffers(
                    pa.binary(), len(length), [None, pa.py_buffer(offsets.tobytes()), data]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(doc + first)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start.astype(np.int64)),
                        pa.array(length.astype(np.int64)),
                        binary,
                    ],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, PIECES)


def fill_bins(counts, capacity):
    """Bins as (how often, {length: uses}); ``counts`` maps length to number of pieces."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left, reverse=True)
    bins = []
    while left:
        lengths = [n for n in lengths if n in left]
        seed = lengths[0]
        room = capacity - seed
        mask = (1 << (room + 1)) - 1
        reach, steps = 1, []
        for n in lengths:
            if n > room:
                continue
            copies = min(left[n] - (n == seed), room // n)
            part = 1
            while copies > 0 and not reach >> room & 1:
                take = min(part, copies)
                steps.append((n, take, reach))
                reach |= reach << (take * n) & mask
                copies -= take
                part *= 2
            if reach >> room & 1:
                break
        at = reach.bit_length() - 1
        uses = {seed: 1}
        for n, take, before in reversed(steps):
            if not before >> at & 1:
                at -= take * n
                uses[n] = uses.get(n, 0) + take
        times = min(left[n] // u for n, u in uses.items())
        bins.append((times, uses))
        for n, u in uses.items():
            left[n] -= times * u
            if not left[n]:
                del left[n]
    return bins


def _slots(bins):
    """For each run of equal-length slots: sorted by (length, first rank) for binary search."""
    rows, used, sequence = [], {}, 0
    for times, uses in bins:
        offset = 0
        for n, u in sorted(uses.items(), reverse=True):
            rank = used.get(n, 0)
            rows.append((n, rank, sequence, u, offset))
            used[n] = rank + times * u
            offset += n * u
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(pieces, capacity=2048, length="length"):
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens.

    The input is written once to the checkpoint folder, so its row numbers are fixed. Pieces of
    one length are numbered in blocks of rows, so a length that a third of all pieces have is
    numbered by many tasks; only the block totals of a length meet.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    size = F.col("_length")
    rows = materialise(
        pieces.select(*[F.col(c).alias(f"p{i}") for i, c in enumerate(names)],
                      F.col(length).cast("long").alias("_length"))
    )
    counts = {r["_length"]: r["n"] for r in rows.groupBy("_length").agg(F.count("*").alias("n")).collect()}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    slots = spark.sparkContext.broadcast(_slots(fill_bins(counts, capacity)))

    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_block", F.floor(F.col("_row") / BLOCK_ROWS))
    within = Window.partitionBy("_length", "_block")
    ranked = rows.withColumn("_rank", F.row_number().over(within.orderBy("_row")) - 1)
    totals = rows.groupBy("_length", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_length").orderBy("_block")
    totals = totals.select(
        "_length", "_block", (F.sum("_n").over(before) - F.col("_n")).alias("_before")
    )
    ranked = ranked.join(totals, ["_length", "_block"]).select(
        *[f"p{i}" for i in range(len(names))],
        size,
        (F.col("_rank") + F.col("_before")).alias("_rank"),
    )

    def run(batches):
        table = slots.value
        shift = 1 << 44
        first = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            n = batch.column(batch.num_columns - 2).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            hit = table[np.searchsorted(first, n * shift + rank, side="right") - 1]
            inside = rank - hit[:, 1]
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-2]
                + [
                    pa.array(hit[:, 2] + inside // hit[:, 3]),
                    pa.array(hit[:, 4] + inside % hit[:, 3] * n),
                ],
                names=[*[f"p{i}" for i in range(len(names))], "sequence_id", "offset"],
            )

    schema = T.StructType(
        [T.StructField(f"p{i}", f.dataType) for i, f in enumerate(pieces.schema.fields)]
        + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    kept = [f"p{i}" for i in range(len(names))]
    placed = ranked.mapInArrow(run, schema)
    free = [c for c in ("sequence_id", "offset") if c not in names]
    return placed.select(
        *[F.col(k).alias(c) for k, c in zip(kept, names)],
        *[F.col(c) for c in free],
        *[F.col(c).alias(f"{c}_packed") for c in ("sequence_id", "offset") if c in names],
    )


def sequences(placed):
    """Whole sequences from placed pieces with ids: sequence_id, n_tokens, ids, doc_ids."""
    order = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    made = placed.groupBy("sequence_id").agg(order.alias("parts"))
    return made.select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("n_tokens"),
        F.aggregate(
            "parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])
        ).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
    )
