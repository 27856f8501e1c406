"""The prefix tree of conversations, with count-min screening of prefix digests.

Every prefix of a conversation has a 128-bit digest. A count-min sketch of all digests never counts
too few, so an estimate of one proves that no other conversation shares the prefix, nor any longer
one: from there on a conversation is a tail, whose nodes are written where they are found. Only
prefixes before the tail, which may be shared, are shuffled and grouped by their whole digest.

Sums over subtrees need no walk over the tree. A node is put on the account of its smallest member,
and every member of a node adds up what its own account holds at that depth and below.

The sketch has four cells a prefix in each of two rows, 2**26 at most; where prefixes outgrow it,
fewer tails are proven and more is grouped, with the same result. What tasks need of it is one bit a
cell, so 16 MiB at most are broadcast.

Defined cases: an empty table has no node, not even a root. A null conversation id is a conversation
of its own; it counts as a member, but gives no number to ``conv_id`` and ``ends_sha256``, so a
node of its tail has a null ``conv_id``. Equal turns repeated in a conversation are turns each. The
hash over ends is one stream by its nature: pieces of up to 64 KiB are made in all tasks, and one
task per node reads them in order without holding them. Other columns are not used.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from towerlens.llm import turns
from towerlens.llm.words import mix
from towerlens.session import materialise

ROWS = 2
MAX_CELLS = 1 << 26
BLOCK = 1 << 16
# Prefixes whose cells a task counts before it passes them on.
FLUSH = 1 << 20
PIECE_BYTES = 1 << 16
# A parent of more children is looked up by broadcast; fewer than CHILDREN_SHARE nodes have more
# than that share of all children.
CHILDREN_FLOOR = 100_000
CHILDREN_SHARE = 10_000

_MASK = (1 << 64) - 1
_PREFIXES = (
    "conv_id long, part int, depth long, g1 long, g2 long, p1 long, p2 long, size long, "
    "last boolean, tail boolean, top boolean, onward boolean"
)


def cell_count(prefixes):
    return min(MAX_CELLS, max(BLOCK, 1 << (4 * prefixes - 1).bit_length()))


def cells(g1, g2, row, count):
    """The cell of each digest in a row of the sketch of ``count`` cells, a power of two."""
    return mix(g1 + np.uint64(row + 1) * mix(g2)) & np.uint64(count - 1)


def _resolved(batch, found, at):
    """(conversations, which are known, depths, digests) of a batch of a placed frame."""
    conv, known = turns.conversation_ids(batch.column(at["conv_id"]))
    depth = batch.column(at["local"]).to_numpy(zero_copy_only=False).copy()
    part = batch.column(at["part"]).to_numpy(zero_copy_only=False)
    lanes = [batch.column(at[n]).to_numpy(zero_copy_only=False).view(np.uint64).copy() for n in ("l1", "l2")]
    if len(part) and (held := found.get(int(part[0]))):
        same = known & (conv == held[0]) if held[0] is not None else ~known
        depth[same] += held[1]
        for lane, base, before in zip(lanes, turns.BASES, held[2:]):
            scale = np.uint64(pow(int(base), held[1], 1 << 64))
            lane[same] = lane[same] * scale + np.uint64(before)
    return conv, known, depth, lanes[0], lanes[1]


def sketch(frame, found, count):
    """Packed bits of all cells that count two or more, (ROWS, count / 8) bytes."""
    at = {n: i for i, n in enumerate(frame.columns)}

    def packed(row, held):
        kinds, times = np.unique(np.concatenate(held), return_counts=True)
        block = (kinds // np.uint64(BLOCK)).astype(np.int64)
        low = (kinds % np.uint64(BLOCK)).astype(np.uint16)
        edges = np.flatnonzero(np.diff(block)) + 1
        names = block[np.concatenate([[0], edges])] + row * (count // BLOCK)
        ones = [x.tobytes() for x in np.split(low, edges)]
        more = [x[t > 1].tobytes() for x, t in zip(np.split(low, edges), np.split(times, edges))]
        return pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array(ones, pa.binary()), pa.array(more, pa.binary())],
            names=["block", "cells", "twice"],
        )

    def count_cells(batches):
        held, rows = [[] for _ in range(ROWS)], 0
        for batch in batches:
            _, _, _, g1, g2 = _resolved(batch, found, at)
            rows += len(g1)
            for row in range(ROWS):
                held[row].append(cells(g1, g2, row, count))
            if rows >= FLUSH:
                for row in range(ROWS):
                    yield packed(row, held[row])
                held, rows = [[] for _ in range(ROWS)], 0
        if rows:
            for row in range(ROWS):
                yield packed(row, held[row])

    def merge(batches):
        name, seen = None, None

        def bits():
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([np.packbits(seen > 1, bitorder="little").tobytes()])],
                names=["block", "bits"],
            )

        for batch in batches:
            for block, ones, more in zip(*(c.to_pylist() for c in batch.columns)):
                if block != name:
                    if name is not None:
                        yield bits()
                    name, seen = block, np.zeros(BLOCK, np.uint8)
                for low in (ones, more):
                    low = np.frombuffer(low, np.uint16)
                    seen[low] = np.minimum(seen[low] + 1, 2)
        if name is not None:
            yield bits()

    made = frame.mapInArrow(count_cells, "block long, cells binary, twice binary")
    merged = made.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, bits binary")
    out = np.zeros((ROWS * count // BLOCK, BLOCK // 8), np.uint8)
    # One bit a cell, 16 MiB at most.
    for row in merged.collect():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(ROWS, count // 8)


def proven_single(table, g1, g2):
    """Which digests the sketch estimates at one."""
    count = table.shape[1] * 8
    shared = np.ones(len(g1), bool)
    for row in range(ROWS):
        cell = cells(g1, g2, row, count)
        shared &= (table[row][cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return ~shared


def prefixes(frame):
    """One row per conversation and depth from 0, in _PREFIXES, and the conversations in many parts.

    ``tail`` marks nodes proven to have one member, ``top`` the first of them, ``onward`` the
    prefix before it; ``last`` marks the end of a conversation.
    """
    spark = frame.sparkSession
    found, onward = turns.carries(frame)
    count = cell_count(frame.count())
    table = spark.sparkContext.broadcast(sketch(frame, found, count))
    at = {n: i for i, n in enumerate(frame.columns)}
    spread = sorted({held[0] for held in found.values()}, key=lambda c: (c is not None, c))

    def first_tail(batches):
        least = {}
        for batch in batches:
            conv, known, depth, g1, g2 = _resolved(batch, found, at)
            single = proven_single(table.value, g1, g2)
            for c, k, d in zip(conv[single].tolist(), known[single].tolist(), depth[single].tolist()):
                c = c if k else None
                least[c] = min(d, least.get(c, d))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(least), pa.int64()), pa.array(list(least.values()), pa.int64())],
            names=["conv_id", "depth"],
        )

    tails = {}
    if spread:
        listed = spark.createDataFrame([(c,) for c in spread], "_conv long")
        rows = frame.join(F.broadcast(listed), F.col("conv_id").eqNullSafe(F.col("_conv"))).select(*frame.columns)
        least = rows.mapInArrow(first_tail, "conv_id long, depth long")
        tails = {r[0]: r[1] for r in least.groupBy("conv_id").agg(F.min("depth")).collect()}

    def in_many_parts(part):
        """Conversations of a part that lie in other parts too: two at most."""
        return {found[p][0] for p in (part, onward.get(part)) if p in found}

    def run(batches):
        before, tail_before, held, done, part = None, False, None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(at["part"])[0].as_py()
            conv, known, depth, g1, g2 = _resolved(batch, found, at)
            size = batch.column(at["size"]).to_numpy(zero_copy_only=False)
            place = np.arange(len(conv))
            fresh = turns.runs(conv, known, before)
            begin = np.maximum.accumulate(np.where(fresh, place, -1))
            hit = np.maximum.accumulate(np.where(proven_single(table.value, g1, g2), place, -1))
            tail = (hit >= begin) & (hit >= 0)
            if tail_before:
                tail |= begin < 0
            for c in in_many_parts(part):
                same = known & (conv == c) if c is not None else ~known
                tail[same] = depth[same] >= tails.get(c, np.iinfo(np.int64).max)
            if held is None and depth[0] > 1:
                fresh[0] = False  # it began in an earlier part
            before, tail_before = (conv[-1], known[-1]), bool(tail[-1])
            columns = (conv, known, depth, g1, g2, size, fresh, tail)
            if held is not None:
                columns = tuple(np.concatenate(pair) for pair in zip(held, columns))
            # The newest row waits, as its successor is unknown.
            yield from _rows(columns, done, len(columns[0]) - 1, part, False)
            held = tuple(c[-2:].copy() for c in columns)
            done = len(held[0]) - 1
        if held is not None:
            yield from _rows(held, done, len(held[0]), part, True)

    def _rows(columns, start, stop, part, at_end):
        if stop <= start:
            return
        conv, known, depth, g1, g2, size, fresh, tail = (c[start:stop] for c in columns)
        n = stop - start
        held = found.get(part)
        follows, next_tail = np.zeros(n, bool), np.zeros(n, bool)
        inner = min(stop, len(columns[0]) - 1) - start
        follows[:inner] = ~columns[6][start + 1 : start + 1 + inner]
        next_tail[:inner] = columns[7][start + 1 : start + 1 + inner]
        if at_end and part in onward:
            name = int(conv[-1]) if known[-1] else None
            follows[-1] = True
            next_tail[-1] = int(depth[-1]) + 1 >= tails.get(name, _MASK)
        p1, p2, over = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, bool)
        back = 1 if start == 0 else 0
        p1[back:], p2[back:] = columns[3][start - 1 + back : stop - 1], columns[4][start - 1 + back : stop - 1]
        over[back:] = columns[7][start - 1 + back : stop - 1]
        if start == 0 and not fresh[0]:
            p1[0], p2[0] = held[2], held[3]
            over[0] = int(depth[0]) - 1 >= tails.get(held[0], _MASK)
        p1[fresh], p2[fresh], over[fresh] = 0, 0, False
        roots = np.flatnonzero(fresh)
        none, zero = np.zeros(len(roots), bool), np.zeros(len(roots), np.int64)
        lists = [
            (depth, zero), (g1.view(np.int64), zero), (g2.view(np.int64), zero),
            (p1.view(np.int64), zero), (p2.view(np.int64), zero), (size, zero),
            (~follows, none), (tail, none), (tail & ~over, none), (follows & next_tail & ~tail, tail[roots]),
        ]
        ids = pa.array(np.concatenate([conv, conv[roots]]), mask=~np.concatenate([known, known[roots]]))
        parts = pa.array(np.full(n + len(roots), part, np.int32))
        yield pa.RecordBatch.from_arrays(
            [ids, parts, *(pa.array(np.concatenate(pair)) for pair in lists)],
            names=[c.split()[0] for c in _PREFIXES.split(", ")],
        )

    return materialise(frame.mapInArrow(run, _PREFIXES)), spread


def _looked_up(children, nodes):
    """``children`` with ``parent_conv_id``: the smallest member of the node (p1, p2)."""
    reps = nodes.select(F.col("g1").alias("p1"), F.col("g2").alias("p2"), F.col("rep").alias("parent_conv_id"), "n_children")
    total = nodes.agg(F.sum("n_children")).first()[0] or 0
    many = max(CHILDREN_FLOOR, total // CHILDREN_SHARE)
    if total <= many:
        return children.join(reps.drop("n_children"), ["p1", "p2"], "left")
    wide = reps.filter(F.col("n_children") > many).select("p1", "p2", F.col("parent_conv_id").alias("_wide"), F.lit(True).alias("_is_wide"))
    marked = children.join(F.broadcast(wide), ["p1", "p2"], "left")
    rest = marked.filter("_is_wide IS NULL").drop("_wide", "_is_wide").join(reps.drop("n_children"), ["p1", "p2"], "left")
    return rest.unionByName(
        marked.filter("_is_wide").withColumnRenamed("_wide", "parent_conv_id").drop("_is_wide")
    )


def _account_sums(shared, nodes, tops, spread):
    """(g1, g2, n_leaves, saved_tokens) of shared nodes."""
    own = nodes.select(
        F.col("rep").alias("_conv"), F.col("depth").alias("_depth"),
        (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("size")).alias("saved"),
    ).unionAll(
        # The leaf at the end of a tail stands at the last prefix that was grouped.
        tops.select("conv_id", F.col("depth") - 1, F.lit(1).cast("long"), F.lit(0).cast("long"))
    )
    own = own.groupBy("_conv", "_depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("depth") == F.col("_depth"))
    sums = ("leaves", "saved")
    rows = shared.select("conv_id", "part", "depth", "g1", "g2").join(own, same, "left").drop("_conv", "_depth")
    rows = rows.fillna(0, list(sums))
    down = Window.partitionBy("conv_id", "part").orderBy(F.desc("depth"))
    total = rows.withColumns({c: F.sum(c).over(down) for c in sums})
    if spread:
        # What a conversation holds in later parts; it has one row per part.
        listed = F.broadcast(rows.sparkSession.createDataFrame([(c,) for c in spread], "_conv long"))
        per = rows.join(listed, F.col("conv_id").eqNullSafe(F.col("_conv"))).groupBy("_conv", "part")
        per = per.agg(*[F.sum(c).alias(c) for c in sums])
        later = Window.partitionBy("_conv").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
        per = per.select("_conv", F.col("part").alias("_part"), *[F.sum(c).over(later).alias(f"_{c}") for c in sums])
        there = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
        total = total.join(F.broadcast(per), there, "left").withColumns(
            {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in sums}
        )
    return total.groupBy("g1", "g2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _end_hashes(ends):
    """(g1, g2, ends_sha256) of nodes at which conversations end, from (g1, g2, conv_id)."""
    order = ["g1", "g2", "conv_id"]

    def pieces(batches):
        name, first, held, size = None, None, [], 0
        out = []
        for batch in batches:
            for g1, g2, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (g1, g2) != name or size >= PIECE_BYTES:
                    if held:
                        out.append((*name, first, ",".join(held)))
                    name, first, held, size = (g1, g2), conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            if len(out) >= 1000:
                yield _table(out)
                out = []
        if held:
            out.append((*name, first, ",".join(held)))
        if out:
            yield _table(out)

    def _table(out):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[*order, "piece"]
        )

    def hashes(batches):
        name, made = None, None
        for batch in batches:
            out = []
            for g1, g2, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (g1, g2) != name:
                    if made is not None:
                        out.append((*name, made.hexdigest()))
                    name, made = (g1, g2), hashlib.sha256(piece.encode())
                else:
                    made.update(b"," + piece.encode())
            yield _hashed(out)
        if made is not None:
            yield _hashed([(*name, made.hexdigest())])

    def _hashed(out):
        kinds = [pa.int64(), pa.int64(), pa.string()]
        columns = zip(*out) if out else [()] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["g1", "g2", "ends_sha256"]
        )

    made = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    made = made.mapInArrow(pieces, "g1 long, g2 long, conv_id long, piece string")
    made = made.repartition("g1", "g2").sortWithinPartitions(*order)
    return made.mapInArrow(hashes, "g1 long, g2 long, ends_sha256 string")


def nodes(rows, members, order):
    """All nodes of the prefix tree, one row each.

    ``rows`` are turns (conv_id, ..., digest, size) in the ``order`` given, as of
    ``turns.ordered_turns``; ``members`` holds every conversation once, also those without turns.
    A node is named by its smallest member and its depth.
    """
    found, spread = prefixes(turns.placed(rows, order))
    shared, tails = found.filter("NOT tail"), found.filter("tail")
    with_turns = found.filter("depth = 0").select(F.col("conv_id").alias("_conv"))
    bare = members.join(with_turns, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_anti")
    zero = F.lit(0).cast("long")
    bare = bare.select(
        "conv_id", F.lit(-1).alias("part"), *[zero.alias(c) for c in ("depth", "g1", "g2", "p1", "p2", "size")],
        F.lit(True).alias("last"), *[F.lit(False).alias(c) for c in ("tail", "top", "onward")],
    )
    shared = shared.unionByName(bare)
    tops = tails.filter("top")
    grouped = materialise(
        shared.groupBy("g1", "g2", "depth", "p1", "p2").agg(
            F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.max("size").alias("size"),
            F.count_if("onward").alias("tops"),
        )
    )
    kids = grouped.filter("depth > 0").groupBy(F.col("p1").alias("g1"), F.col("p2").alias("g2"))
    kids = kids.agg(F.count("*").alias("kids"))
    known = materialise(
        grouped.join(kids, ["g1", "g2"], "left")
        .withColumn("n_children", F.coalesce("kids", F.lit(0)) + F.col("tops"))
        .drop("kids", "tops")
    )
    sums = _account_sums(shared, known, tops, spread)
    ends = _end_hashes(shared.filter("last AND conv_id IS NOT NULL").select("g1", "g2", "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    inner = known.join(sums, ["g1", "g2"]).join(ends, ["g1", "g2"], "left").select(
        F.col("rep").alias("conv_id"), "depth", "p1", "p2", F.col("n").alias("n_convs"), "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
    own = F.when(F.col("last") & F.col("conv_id").isNotNull(), F.sha2(F.col("conv_id").cast("string"), 256))
    single = tails.select(
        "conv_id", "depth", "p1", "p2", F.lit(1).cast("long").alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"),
        F.coalesce(own, F.lit(none)).alias("ends_sha256"), "top",
    )
    children = inner.filter("depth > 0").unionByName(single.filter("top").drop("top"))
    columns = [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    ]
    no_parent = F.lit(None).cast("long").alias("parent_conv_id")
    return (
        _looked_up(children, known).select(columns)
        .unionByName(inner.filter("depth = 0").withColumn("parent_conv_id", no_parent).select(columns))
        .unionByName(single.filter("NOT top").withColumn("parent_conv_id", F.col("conv_id")).select(columns))
    )
