"""Mixing sources to target weights by fixed-length blocks.

1. The words of each source, document after document, form blocks of ``block_words`` words.
2. Targets follow from the weights; a source's quota is its target in blocks. A source of at most
   64 blocks has its short block at the end of every permutation and gives part of its last slot's
   block, so it meets its target to the word; larger ones meet it to less than a block.
3. Every output shard draws how many of its slots each source gets, multinomially with the
   quotas as chances. Draws beyond a source's quota are withdrawn and what is missing is spread
   over the shards, so each source gets exactly its quota of slots.
4. The k-th slot of a source takes the block at place k of a pseudorandom permutation of the
   source's block numbers, a new one each time all its blocks have been used. So no block is
   taken more than twice while targets are at most twice the source.
5. Slots and blocks meet in a join on source and block number. Blocks are of one size, so the
   join is even however large a source is.

Shares of a source in the shards are summed up by groups of shards, then dealt to all tasks before
they unfold into slots, so no task holds the slots of one source.

Documents are numbered inside a source by groups of their key's hash, so numbering a source that
holds a third of all rows is shared by many tasks. Everything follows from the rows and ``seed``.

Defined cases: a null text has no words, size 0 and is never taken; null sources form one source,
the last; repeated rows are documents of their own; an empty table gives an empty result. One row
per source and the draws per shard and source are all that is gathered.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from towerlens.llm import words
from towerlens.llm.memory import checked

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 256
SHARD_SLOTS = 4096
# Sources of at most this many blocks meet their targets to the word.
CUT_BLOCKS = 64
# Shards whose draws are summed up together, and those whose slots one task makes.
SHARD_GROUP = 1024
TASK_SHARDS = 8
# Documents of one group in which they are numbered.
GROUP_ROWS = 2000
WORD = "[^\\x20\\x09-\\x0D]+"

_ROW = ["source_no", "group_no", "row_no"]


def targets(sizes, weights, total, most=MOST):
    """Share ``total`` by weight; what exceeds ``most`` times a size is shared by the others."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        unit = total / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if weights[i] * unit > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = most * sizes[i]
            total -= out[i]
            open_.remove(i)
    return out


def permuted(index, count, key):
    """The place of each of ``index`` (0 to count - 1) under a keyed permutation of that range.

    A four-round Feistel network on the next even number of bits; numbers that fall outside are
    sent through again, which keeps it a permutation.
    """
    half = np.uint64(max(1, -(-int(count - 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for turn in range(4):
            salt = words.mix(np.array([key, turn], np.uint64)).sum(dtype=np.uint64)
            left, right = right, left ^ (words.mix(right + salt) & mask)
        x = (left << half) | right
        out[todo] = x
        todo = todo[x >= count]
    return out.astype(np.int64)


def sized(docs, key="doc_id", text="text", source="source"):
    """The columns that mixing needs, in front of all columns of ``docs``."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).cast("long").alias("_key"),
        F.col(source).cast("string").alias("_source"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("_size"),
        F.xxhash64(body).alias("_hash"),
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)],
    )


class Plan:
    """Sizes, targets and quotas per source of ``docs`` (the output of ``sized``)."""

    def __init__(self, rows, weights=WEIGHTS, share=SHARE, most=MOST, block_words=BLOCK_WORDS):
        self.spark = rows.sparkSession
        self.block_words = block_words
        found = rows.groupBy("_source").agg(F.count("*").alias("n"), F.sum("_size").alias("size")).collect()
        found.sort(key=lambda r: (r["_source"] is None, r["_source"]))
        self.names = [r["_source"] for r in found]
        self.sizes = [int(r["size"]) for r in found]
        self.groups = sum(r["n"] for r in found) // GROUP_ROWS + 1
        weight = [weights[i % len(weights)] for i in range(len(found))]
        self.targets = targets(self.sizes, weight, share * sum(self.sizes), most)
        self.blocks = [-(-s // block_words) for s in self.sizes]
        quotas = [self._quota(*x, most) for x in zip(self.sizes, self.targets, self.blocks)]
        self.quotas = [q for q, _ in quotas]
        # Words that a source's last slot takes of its block.
        self.cuts = [cut for _, cut in quotas]

    def _quota(self, size, target, blocks, most):
        if blocks > CUT_BLOCKS:
            return min(int(most) * blocks, round(target * blocks / size)), self.block_words
        turns, rest = divmod(min(int(most * size), round(target)), size) if size else (0, 0)
        more = -(-rest // self.block_words)
        return turns * blocks + more, rest - (more - 1) * self.block_words if more else self.block_words

    def table(self):
        schema = "source_no int, _source string, source_size long, target double"
        rows = zip(range(len(self.names)), self.names, self.sizes, self.targets)
        return self.spark.createDataFrame(list(rows), schema)


class Known:
    """What a task needs of a plan."""

    def __init__(self, plan):
        self.blocks, self.quotas, self.cuts, self.block_words = plan.blocks, plan.quotas, plan.cuts, plan.block_words


def numbered(rows, plan):
    """``rows`` with source_no, group_no, row_no and first, the words of the source before it."""
    table = plan.table()
    rows = rows.join(checked(table, len(plan.names)), rows["_source"].eqNullSafe(table["_source"])).drop(table["_source"])
    rows = rows.withColumn("group_no", F.pmod(F.xxhash64("_key", F.lit(11)), F.lit(plan.groups)))
    group = Window.partitionBy("source_no", "group_no")
    order = group.orderBy("_key", "_size", "_hash")
    totals = rows.groupBy("source_no", "group_no").agg(F.sum("_size").alias("n"))
    before = Window.partitionBy("source_no").orderBy("group_no")
    totals = totals.select("source_no", "group_no", (F.sum("n").over(before) - F.col("n")).alias("base"))
    rows = rows.withColumns(
        {
            "row_no": F.row_number().over(order),
            "first": F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"),
        }
    )
    rows = rows.join(totals, ["source_no", "group_no"])
    return rows.withColumn("first", F.col("first") + F.col("base")).drop("base")


def _sum_before(rows, value, name):
    """``rows`` with the sum of ``value`` over the shards of the source before, by groups of shards."""
    rows = rows.withColumn("_group", F.floor(F.col("shard") / SHARD_GROUP))
    groups = rows.groupBy("source_no", "_group").agg(F.sum(value).alias("_n"))
    earlier = Window.partitionBy("source_no").orderBy("_group")
    groups = groups.select("source_no", "_group", (F.sum("_n").over(earlier) - F.col("_n")).alias("_base"))
    inside = Window.partitionBy("source_no", "_group").orderBy("shard")
    rows = rows.withColumn(name, F.sum(value).over(inside) - F.col(value))
    rows = rows.join(groups, ["source_no", "_group"])
    return rows.withColumn(name, F.col(name) + F.col("_base")).drop("_group", "_base")


def draws(plan, seed, shard_slots=SHARD_SLOTS):
    """source_no, shard, slot (the first of its slots in the source) and count."""
    total = sum(plan.quotas)
    shards = max(1, -(-total // shard_slots))
    chance = np.array(plan.quotas, np.float64) / max(total, 1)
    if not total:
        return plan.spark.createDataFrame([], "source_no int, shard long, slot long, count long")

    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                slots = min(shard_slots, total - shard * shard_slots)
                got = np.random.default_rng([seed, shard]).multinomial(slots, chance)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(len(got), dtype=np.int32)),
                        pa.array(np.full(len(got), shard, np.int64)),
                        pa.array(got.astype(np.int64)),
                    ],
                    names=["source_no", "shard", "drawn"],
                )

    drawn = plan.spark.range(shards).mapInArrow(run, "source_no int, shard long, drawn long")
    quota = plan.spark.createDataFrame(list(enumerate(plan.quotas)), "source_no int, quota long")
    totals = drawn.groupBy("source_no").agg(F.sum("drawn").alias("all_drawn"))
    quota = totals.join(quota, "source_no")
    drawn = _sum_before(drawn, "drawn", "before").join(checked(quota, len(plan.quotas)), "source_no")
    kept = F.greatest(F.lit(0), F.least(F.col("drawn"), F.col("quota") - F.col("before")))
    missing = F.greatest(F.lit(0), F.col("quota") - F.col("all_drawn"))
    extra = F.floor(missing / shards) + (F.col("shard") < missing % shards).cast("long")
    drawn = drawn.select("source_no", "shard", (kept + extra).alias("count")).filter("count > 0")
    return _sum_before(drawn, "count", "slot").select("source_no", "shard", "slot", "count")


def blocks_of(plan, source, slots, seed):
    """(block, turn) of the given slots of a source, numbers from 0 to its quota."""
    count = plan.blocks[source]
    turn, place = slots // count, slots % count
    # The short block of a small source stays at the end.
    moved = count - 1 if 1 < count <= CUT_BLOCKS else count
    block = place.copy()
    for t in np.unique(turn):
        of = (turn == t) & (place < moved)
        key = (seed * 1_000_003 + source) * 1_000_003 + int(t)
        block[of] = permuted(place[of], moved, key & (2**64 - 1))
    return block, turn


def slots(plan, seed, shard_slots=SHARD_SLOTS):
    """source_no, block, shard, turn and most_words of every slot of the mix."""
    known = Known(plan)

    def run(batches):
        for batch in batches:
            for source, shard, slot, count in zip(*(c.to_pylist() for c in batch.columns)):
                k = np.arange(slot, slot + count)
                block, turn = blocks_of(known, source, k, seed)
                last = k == known.quotas[source] - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(count, source, np.int32)),
                        pa.array(block),
                        pa.array(np.full(count, shard, np.int64)),
                        pa.array(turn.astype(np.int32)),
                        pa.array(np.where(last, known.cuts[source], known.block_words).astype(np.int64)),
                    ],
                    names=["source_no", "block", "shard", "turn", "most_words"],
                )

    shards = -(-sum(plan.quotas) // shard_slots)
    dealt = draws(plan, seed, shard_slots).repartition(max(1, -(-shards // TASK_SHARDS)), "source_no", "shard")
    return dealt.mapInArrow(run, "source_no int, block long, shard long, turn int, most_words long")


def block_pieces(rows, plan):
    """One row per document and block: _ROW, _key, _size, block, from_word, n_words."""
    size = plan.block_words
    last = F.floor((F.col("first") + F.greatest(F.col("_size"), F.lit(1)) - 1) / size)
    at = F.explode(F.sequence(F.floor(F.col("first") / size), last))
    rows = rows.select(*_ROW, "_key", "_size", "source_size", "target", "first", at.alias("block"))
    start = F.greatest(F.col("first"), F.col("block") * size)
    stop = F.least(F.col("first") + F.col("_size"), (F.col("block") + 1) * size)
    return rows.select(
        *_ROW, "_key", "_size", "source_size", "target", "block",
        (start - F.col("first")).alias("from_word"),
        (stop - start).alias("n_words"),
        (start - F.col("block") * size).alias("in_block"),
    )


def spans(docs, seed=0, plan=None, shard_slots=SHARD_SLOTS, key="doc_id", text="text", source="source"):
    """All that the mix takes: shard, turn, block and the words [from_word, + n_words) of a row.

    Rows of ``docs`` of which nothing is taken have one row with a null shard and turn.
    """
    rows = sized(docs, key, text, source).select("_key", "_source", "_size", "_hash")
    plan = plan or Plan(rows)
    pieces = block_pieces(numbered(rows, plan), plan)
    # The size of the slots can't be seen from the draws they come from, so it is not left to Spark
    # to broadcast them.
    taken_by = slots(plan, seed, shard_slots).hint("merge")
    found = pieces.join(taken_by, ["source_no", "block"], "left")
    left = F.greatest(F.lit(0), F.coalesce("most_words", F.lit(plan.block_words)) - F.col("in_block"))
    return found.withColumn("n_words", F.least("n_words", left)).drop("in_block", "most_words")


def taken(docs, seed=0, **kw):
    """doc_id, size, source_size, target and taken words of every row of ``docs``."""
    found = spans(docs, seed, **kw)
    return (
        found.groupBy(*_ROW, "_key", "_size", "source_size", "target")
        .agg(F.sum(F.when(F.col("shard").isNotNull(), F.col("n_words")).otherwise(0)).alias("taken"))
        .select(F.col("_key").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", "taken")
    )


def cut_texts(texts, spans_of):
    """The text of each row's word spans, merged where they touch, one line break between."""
    out = []
    for first, data, offsets in words.text_blocks(texts):
        starts, ends, counts = words.word_bounds(data, offsets)
        base = np.cumsum(counts) - counts
        raw = data.tobytes()
        for i in range(len(counts)):
            runs = []
            for a, n in spans_of[first + i]:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = a + n
                else:
                    runs.append([a, a + n])
            if len(runs) == 1 and runs[0] == [0, counts[i]]:
                out.append(raw[offsets[i] : offsets[i + 1]].decode())
                continue
            parts = [raw[starts[base[i] + a] : ends[base[i] + b - 1]].decode() for a, b in runs]
            out.append("\n".join(parts))
    return out


def mixed_documents(docs, seed=0, key="doc_id", text="text", source="source"):
    """The mix as documents: for each turn of a row, its columns with the text the turn takes."""
    rows = sized(docs, key, text, source)
    plan = Plan(rows)
    found = spans(docs, seed, plan, key=key, text=text, source=source).filter("shard is not null and n_words > 0")
    span = F.array_sort(F.collect_list(F.struct("from_word", "n_words")))
    chosen = found.groupBy(*_ROW, "turn").agg(span.alias("spans"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    full = numbered(rows, plan).join(chosen, _ROW).select(*names, "spans")
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            todo = [[(s["from_word"], s["n_words"]) for s in x] for x in batch.column(len(names)).to_pylist()]
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(cut_texts(columns[at], todo), pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)])
    made = full.mapInArrow(run, schema).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return made
