"""Near-duplicate join on the Jaccard similarity of word shingles, with Bayesian pruning.

1. Each text becomes its set of shingles (``width`` words); equal sets are one node.
2. Nodes that share a MinHash band are candidates. With 30 bands of 4 values a pair of
   similarity 0.8 shares none with probability 1.4e-7.
3. Candidates compare their MinHash values step by step. After each step a pair is dropped when
   the posterior probability that its similarity reaches the threshold is below ``TOLERANCE``.
   Surviving pairs join their nodes into groups; only a spanning forest leaves a task.
4. All pairs inside a group are verified exactly on the shingle sets. A task returns the number
   of links per node and a spanning forest of the links, never the pairs.

Bands and groups of more than ``BLOCK_NODES`` nodes are cut into blocks, and each pair of blocks
is a piece of work of its own, so one that a third of all rows fall in is shared by many tasks.

Defined cases: a text without a word is alike to none, also not to another such text; a text of
one to four words has one shingle; a null text has no words; copies and repeated rows count as
links of each other; null keys get the class of their text (a null class for a class of null
keys only). Other columns are ignored by ``links`` and kept by ``representatives``.
"""

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from towerlens.llm import words
from towerlens.llm.components import components
from towerlens.session import materialise

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 4
HASHES = BANDS * ROWS
STEP = 20
TOLERANCE = 1e-7
BLOCK_NODES = 256
# Shingle columns of one dense block of the exact comparison.
BLOCK_SHINGLES = 4096

_A = words.mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_B = words.mix(np.arange(1001, HASHES + 1001, dtype=np.uint64))

SKETCH = "doc_id long, digest binary, n int, keys array<long>, sig binary"


def shingle_sets(column, width=WIDTH):
    """Yield (first row, sorted distinct shingles, shingles per text) over an Arrow column."""
    for first, data, offsets in words.text_blocks(column):
        starts, ends, counts = words.word_bounds(data, offsets)
        values, per = words.shingles(words.word_hashes(data, starts, ends), counts, width)
        values, per = words.distinct_per_text(values, per)
        yield first, values, per


def minhashes(values, per):
    """(texts with a shingle, HASHES) MinHash values of 32 bits."""
    at = (np.cumsum(per) - per)[per > 0]
    out = np.empty((HASHES, len(at)), np.uint32)
    work = np.empty_like(values)
    for k in range(HASHES):
        np.multiply(values, _A[k], out=work)
        work += _B[k]
        work >>= np.uint64(32)
        out[k] = np.minimum.reduceat(work, at)
    return np.ascontiguousarray(out.T)


def band_keys(hashes):
    """(texts, BANDS) 64-bit keys; the band is part of the key."""
    wide = hashes.astype(np.uint64).reshape(len(hashes), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = np.repeat(key[None, :], len(hashes), 0)
    for r in range(ROWS):
        key = words.mix(key + wide[:, :, r])
    return key.view(np.int64)


def _digests(values, per):
    ends = np.cumsum(per)
    data = memoryview(values.tobytes())
    return [hashlib.blake2b(data[8 * (e - n) : 8 * e], digest_size=16).digest() for e, n in zip(ends, per)]


def sketches(docs, key="doc_id", text="text", width=WIDTH):
    """doc_id, digest of the shingle set, its size, band keys and short MinHash values."""

    def run(batches):
        for batch in batches:
            for first, values, per in shingle_sets(batch.column(1), width):
                rows = np.flatnonzero(per)
                if len(rows) == 0:
                    continue
                hashes = minhashes(values, per)
                short = hashes.astype(np.uint16)
                keys = band_keys(hashes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows + first)),
                        pa.array(_digests(values, per[rows]), pa.binary()),
                        pa.array(per[rows].astype(np.int32)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())
                        ),
                        pa.array([s.tobytes() for s in short], pa.binary()),
                    ],
                    names=["doc_id", "digest", "n", "keys", "sig"],
                )

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, SKETCH)


def least_matches(threshold=THRESHOLD, tolerance=TOLERANCE):
    """After each step, the fewest equal MinHash values with which a pair stays.

    With a uniform prior the similarity has, after m equal values of n, the posterior
    Beta(m + 1, n - m + 1); it exceeds t with the probability that n + 1 draws of chance t give
    at most m hits.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def surviving(sig, left, right, least):
    """Which pairs (rows of ``sig``) pass every step."""
    alive = np.arange(len(left))
    equal = np.zeros(len(left), np.int32)
    for step, need in enumerate(least):
        cols = slice(step * STEP, (step + 1) * STEP)
        a, b = left[alive], right[alive]
        equal[alive] += (sig[a, cols] == sig[b, cols]).sum(1, dtype=np.int32)
        alive = alive[equal[alive] >= need]
    return alive


def forest(count, left, right):
    """For each of ``count`` rows the smallest row it is linked to, directly or not."""
    label = np.arange(count)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def group_pairs(side, low, high):
    """Row pairs of one piece of work: inside a block, or between its two blocks."""
    if low == high:
        return np.triu_indices(len(side), 1)
    a, b = np.flatnonzero(side == low), np.flatnonzero(side == high)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def work_groups(batches, names):
    """Yield tables of whole pieces of work from batches sorted by group, low and high."""
    held = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names]
        cut = 1 + np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        head = [k[0] for k in keys]
        if held and held[0][1] != head:
            yield pa.Table.from_batches([b for b, _ in held])
            held = []
        bounds = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a:
                yield pa.Table.from_batches([x for x, _ in held])
                held = []
            held.append((batch.slice(a, b - a), [k[a] for k in keys]))
    if held:
        yield pa.Table.from_batches([b for b, _ in held])


def blocked(rows, group, block_nodes=BLOCK_NODES):
    """Repeat each row for the pieces of work it takes part in, and bring these together.

    ``rows`` have ``group``, its number of nodes ``m`` and ``node``.
    """
    blocks = F.ceil(F.col("m") / block_nodes)
    rows = rows.withColumn("side", F.pmod(F.xxhash64("node", F.lit(7)), blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    rows = rows.withColumn("other", other).withColumns(
        {"low": F.least("side", "other"), "high": F.greatest("side", "other")}
    )
    return (
        rows.drop("other", "m")
        .repartition(group, "low", "high")
        .sortWithinPartitions(group, "low", "high", "side", "node")
    )


def candidate_edges(nodes, threshold=THRESHOLD):
    """Spanning edges (a, b) of the candidate pairs that Bayesian pruning leaves."""
    bands = nodes.select("node", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    rows = bands.join(shared, "key").join(nodes.select("node", "sig"), "node")
    least = least_matches(threshold)

    def run(batches):
        left, right = [], []
        for table in work_groups(batches, ["key", "low", "high"]):
            node = table["node"].to_numpy()
            side = table["side"].to_numpy()
            data = b"".join(table["sig"].to_pylist())
            sig = np.frombuffer(data, np.uint16).reshape(len(node), HASHES)
            a, b = group_pairs(side, table["low"][0].as_py(), table["high"][0].as_py())
            kept = surviving(sig, a, b, least)
            if len(kept):
                root = forest(len(node), a[kept], b[kept])
                linked = np.flatnonzero(root != np.arange(len(node)))
                left.append(node[linked])
                right.append(node[root[linked]])
            if len(left) > 1000:
                yield pa.RecordBatch.from_arrays([np.concatenate(left), np.concatenate(right)], names=["a", "b"])
                left, right = [], []
        if left:
            yield pa.RecordBatch.from_arrays([np.concatenate(left), np.concatenate(right)], names=["a", "b"])

    return blocked(rows, "key").mapInArrow(run, "a long, b long")


def intersections(sets, a, b):
    """Sizes of the intersections of the sorted arrays ``sets[i]`` and ``sets[j]``."""
    count = len(sets)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    column = np.cumsum(fresh) - 1
    common = np.bincount(column)[column] > 1
    column, owner = column[common], owner[common]
    out = np.zeros(len(a), np.int64)
    if len(column) == 0:
        return out
    _, column = np.unique(column, return_inverse=True)
    for first in range(0, int(column[-1]) + 1, BLOCK_SHINGLES):
        lo, hi = np.searchsorted(column, [first, first + BLOCK_SHINGLES])
        dense = np.zeros((count, min(BLOCK_SHINGLES, int(column[-1]) + 1 - first)), np.float32)
        dense[owner[lo:hi], column[lo:hi] - first] = 1
        out += np.rint(dense @ dense.T).astype(np.int64)[a, b]
    return out


def verified(docs, members, key, text, width, threshold):
    """node, links, root from exact comparison of all pairs in each group of ``members``."""

    def read(batches):
        for batch in batches:
            node, comp, m, copies, digest = (batch.column(i) for i in range(5))
            for first, values, per in shingle_sets(batch.column(5), width):
                mine = digest.slice(first, len(per)).to_pylist()
                right = [i for i, d in enumerate(_digests(values, per)) if d == mine[i]]
                ends = np.cumsum(per)
                sets = [values[ends[i] - per[i] : ends[i]].tobytes() for i in right]
                rows = pa.array(np.array(right, np.int64) + first)
                yield pa.RecordBatch.from_arrays(
                    [node.take(rows), comp.take(rows), m.take(rows), copies.take(rows), pa.array(sets, pa.binary())],
                    names=["node", "component", "m", "copies", "set"],
                )

    def run(batches):
        for table in work_groups(batches, ["component", "low", "high"]):
            node, first = np.unique(table["node"].to_numpy(), return_index=True)
            side = table["side"].to_numpy()[first]
            copies = table["copies"].to_numpy()[first]
            packed = table["set"].take(pa.array(first)).to_pylist()
            sets = [np.frombuffer(s, np.uint64) for s in packed]
            size = np.array([len(s) for s in sets])
            a, b = group_pairs(side, table["low"][0].as_py(), table["high"][0].as_py())
            near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
            a, b = a[near], b[near]
            both = intersections(sets, a, b)
            linked = both >= threshold * (size[a] + size[b] - both) - 1e-9
            a, b = a[linked], b[linked]
            links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
            root = forest(len(node), a, b)
            yield pa.RecordBatch.from_arrays(
                [node, links.astype(np.int64), node[root]], names=["node", "links", "root"]
            )

    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text"))
    rows = members.join(texts, members["rep"].eqNullSafe(texts["rep"])).select(
        "node", "component", "m", "copies", "digest", "text"
    )
    sets = rows.mapInArrow(read, "node long, component long, m long, copies long, set binary")
    return blocked(sets, "component").mapInArrow(run, "node long, links long, root long")


def links(docs, key="doc_id", text="text", width=WIDTH, threshold=THRESHOLD):
    """doc_id, class_id, n_links, copies, n_shingles: one row per row of ``docs``.

    ``n_links`` counts the other rows of at least ``threshold`` similarity; a class is a connected
    component of links, named by its smallest key.
    """
    sketch = materialise(sketches(docs, key, text, width))
    # Band keys and values follow from the set, so any row of a set has the right ones.
    same = sketch.groupBy("digest", "n").agg(
        F.min("doc_id").alias("rep"),
        F.count("*").alias("copies"),
        F.first("keys").alias("keys"),
        F.first("sig").alias("sig"),
    )
    nodes = materialise(same).withColumn("node", F.monotonically_increasing_id())
    groups = materialise(components(candidate_edges(nodes, threshold)))
    sizes = groups.groupBy("component").agg(F.count("*").alias("m"))
    members = groups.join(sizes, "component").join(nodes.select("node", "rep", "digest", "copies"), "node")
    found = materialise(verified(docs, members, key, text, width, threshold))
    edges = found.filter("root != node").select(F.col("node").alias("a"), F.col("root").alias("b"))
    linked = components(edges)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    slim = (
        nodes.select("node", "digest", "rep", "copies")
        .join(counts, "node", "left")
        .join(linked, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    names = slim.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = slim.join(names, "component").select(
        "digest", "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    all_docs = sketch.select("doc_id", "digest", "n").join(named, "digest")
    wordless = docs.filter(~F.coalesce(F.col(text), F.lit("")).rlike("[^\\x20\\x09-\\x0D]"))
    return all_docs.select("doc_id", "class_id", "n_links", "copies", F.col("n").alias("n_shingles")).unionAll(
        wordless.select(
            F.col(key).cast("long").alias("doc_id"),
            F.col(key).cast("long").alias("class_id"),
            F.lit(0).cast("long").alias("n_links"),
            F.lit(1).cast("long").alias("copies"),
            F.lit(0).alias("n_shingles"),
        )
    )


def representatives(docs, key="doc_id", text="text", width=WIDTH, threshold=THRESHOLD):
    """The rows of ``docs`` that represent their class: of each class the smallest key.

    Texts without a word and rows with a null key all stay. A key stands for one text; of rows that
    repeat it, the least by all columns stays.
    """
    names = docs.columns
    found = links(docs, key, text, width, threshold)
    dropped = found.filter("doc_id != class_id").select(F.col("doc_id").alias("_dropped")).distinct()
    kept = docs.join(dropped, docs[key] == dropped["_dropped"], "left_anti")
    twice = found.filter("doc_id = class_id and copies > 1").select(F.col("doc_id").alias("_again")).distinct()
    flat = kept.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{names.index(key)}"
    alone = flat.join(twice, flat[at] == twice["_again"], "left_anti")
    again = flat.join(twice, flat[at] == twice["_again"], "left_semi").groupBy(at).agg(
        F.min(F.struct(*flat.columns)).alias("row")
    )
    return alone.unionAll(again.select("row.*")).toDF(*names)
