"""User-id sets in two forms: sorted 16-bit offsets where a bucket is thin, bits where it is full.

A set is rows ``(keys..., bucket, n, ids)``. ``n`` counts the ids of the bucket. Fewer than THIN_IDS
are kept as sorted little-endian 16-bit offsets, two bytes each; more as 4,096 bytes of bits, as
in ``bitmaps``. Both forms use Spark's bucket numbers, so ``from_bitmaps`` and ``to_bitmaps`` change
no row. A count of a set is a sum of ``n`` and reads no ids.

Null ids are ignored; keys may be null; an id given twice counts once; a set without ids has no rows.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from towerlens.operators.skew import fits_broadcast

# Workers get this module by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

IDS_PER_BUCKET = 32768
BUCKET_BYTES = IDS_PER_BUCKET // 8
# From this many ids on, the offsets would need as many bytes as the bits.
THIN_IDS = BUCKET_BYTES // 2
# Ids of a bucket that are gathered together.
PART_IDS = 2048
# Buckets decoded at once: a full one gives 32,768 numbers.
CHUNK = 64

# A member of a chunk is one number: the row's place, then 15 bits of offset.
_SHIFT = 15


def _numbers(ids):
    """All members of a column of sets, ascending."""
    lengths = np.array([len(x) for x in ids], np.int64)
    data = np.frombuffer(b"".join(ids), np.uint8)
    full = lengths == BUCKET_BYTES
    of_byte = np.repeat(full, lengths)
    thin = np.flatnonzero(~full)
    offsets = data[~of_byte].view("<u2").astype(np.int64)
    out = (np.repeat(thin, lengths[thin] // 2) << _SHIFT) | offsets
    if full.any():
        bits = np.unpackbits(data[of_byte].reshape(-1, BUCKET_BYTES), axis=1, bitorder="little")
        row, place = np.nonzero(bits)
        out = np.concatenate([out, (np.flatnonzero(full)[row] << _SHIFT) | place])
        out.sort()
    return out


def _sets(numbers):
    """(places, n, ids) of ascending members: the inverse of ``_numbers`` for the rows that have any."""
    rows, starts = np.unique(numbers >> _SHIFT, return_index=True)
    stops = np.append(starts[1:], len(numbers))
    offsets = (numbers & (IDS_PER_BUCKET - 1)).astype("<u2")
    ids = []
    for start, stop in zip(starts, stops):
        if stop - start < THIN_IDS:
            ids.append(offsets[start:stop].tobytes())
        else:
            bits = np.zeros(IDS_PER_BUCKET, np.uint8)
            bits[offsets[start:stop]] = 1
            ids.append(np.packbits(bits, bitorder="little").tobytes())
    return rows, stops - starts, ids


def _table(keys, rows, n, ids):
    """Arrow columns of sets: key columns at ``rows``, then n and ids."""
    picked = pa.array(rows, pa.int64())
    return [c.take(picked) for c in keys] + [pa.array(n, pa.int32()), pa.array(ids, pa.binary())]


def _schema(frame, keys):
    fields = [frame.schema[key] for key in [*keys, "bucket"]]
    return T.StructType(fields + [T.StructField("n", T.IntegerType()), T.StructField("ids", T.BinaryType())])


def _chunks(batches, size=CHUNK):
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def build(members, keys, id_col="bitmap_id"):
    """Membership rows to sets, by one shuffle of the rows.

    A bucket is gathered in parts of at most PART_IDS ids, so batches on their way to Python stay
    small where buckets are full; the parts of a bucket are then merged inside the task.
    """
    names = [*keys, "bucket"]
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    present = members.where(F.col(id_col).isNotNull()).select(
        *keys,
        F.bitmap_bucket_number(id_col).alias("bucket"),
        F.bitmap_bit_position(id_col).cast("smallint").alias("_place"),
    )
    parts = present.repartition(partitions, *names).groupBy(*names, F.floor(F.col("_place") / PART_IDS).alias("_part"))
    gathered = parts.agg(F.array_sort(F.collect_set("_place")).alias("_places")).drop("_part")

    def run(batches):
        for part in _chunks(batches):
            places = part.column(part.num_columns - 1)
            rows = np.repeat(np.arange(part.num_rows), places.value_lengths().to_numpy())
            numbers = (rows << _SHIFT) | places.flatten().to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays(_table(part.columns[:-1], *_sets(numbers)), names=[*names, "n", "ids"])

    return _fold(gathered.mapInArrow(run, _schema(gathered, keys)).sortWithinPartitions(*names), keys)


def _fold(sets, keys):
    """Merge neighbouring rows of one key and bucket; what a task holds is one chunk and one set."""
    names = [*keys, "bucket", "n", "ids"]
    width = len(keys) + 1

    def run(batches):
        held = None
        for part in _chunks(batches):
            if held is not None:
                part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            starts = np.zeros(part.num_rows, np.int64)
            for column in part.columns[:width]:
                codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
                starts[1:] |= np.diff(codes) != 0
            group = np.cumsum(starts)
            numbers = _numbers(part.column(width + 1).to_pylist())
            merged = np.unique((group[numbers >> _SHIFT] << _SHIFT) | (numbers & (IDS_PER_BUCKET - 1)))
            places, n, ids = _sets(merged)
            first = np.searchsorted(group, places)
            out = pa.RecordBatch.from_arrays(_table(part.columns[:width], first, n, ids), names=names)
            held = out.slice(out.num_rows - 1)
            yield out.slice(0, out.num_rows - 1)
        if held is not None:
            yield held

    return sets.mapInArrow(run, _schema(sets, keys))


def union(sets, keys):
    """Merge all sets of one key, for example the hours of a day.

    Each task first merges its own rows, so of one key and bucket at most one row per task is sent
    on, however many sets the key has.
    """
    names = [*keys, "bucket"]
    rows = sets.select(*names, "n", "ids")
    own = _fold(rows.sortWithinPartitions(*names), keys)
    partitions = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _fold(own.repartition(partitions, *names).sortWithinPartitions(*names), keys)


def intersect(left, right, left_keys, right_keys):
    """Every left set AND every right set, bucket by bucket; empty results are left out.

    ``right`` is the side with fewer sets, such as the portraits: it is broadcast when its checked
    size allows, else both sides meet by bucket number.
    """
    other = right.select(*right_keys, "bucket", F.col("ids").alias("_right"))
    if fits_broadcast(other):
        other = F.broadcast(other)
    keys = [*left_keys, *right_keys]
    pairs = left.select(*left_keys, "bucket", F.col("ids").alias("_left")).join(other, "bucket")
    pairs = pairs.select(*keys, "bucket", "_left", "_right")
    names = [*keys, "bucket", "n", "ids"]

    def run(batches):
        for part in _chunks(batches):
            sides = [_numbers(part.column(len(keys) + i).to_pylist()) for i in (1, 2)]
            both = np.intersect1d(*sides, assume_unique=True)
            yield pa.RecordBatch.from_arrays(_table(part.columns[:-2], *_sets(both)), names=names)

    return pairs.mapInArrow(run, _schema(pairs, keys))


def cardinality(sets, keys, name="n_users"):
    """Number of ids per key, from the counts beside the sets."""
    return sets.groupBy(*keys).agg(F.sum("n").cast("bigint").alias(name))


def expand(sets, keys, id_col="bitmap_id"):
    """Sets back to one row per id."""
    rows = sets.select(*keys, "bucket", "ids")
    schema = T.StructType([rows.schema[key] for key in keys] + [T.StructField(id_col, T.LongType())])
    names = [*keys, id_col]
    width = len(keys)

    def run(batches):
        for part in _chunks(batches):
            numbers = _numbers(part.column(width + 1).to_pylist())
            row, place = numbers >> _SHIFT, numbers & (IDS_PER_BUCKET - 1)
            bucket = part.column(width).to_numpy(zero_copy_only=False)[row]
            # Bucket 0 holds id 0 alone; from bucket 1 on ids start at 1.
            ids = np.where(bucket == 0, 0, (bucket - 1) * IDS_PER_BUCKET + place + 1)
            picked = pa.array(row)
            columns = [part.column(i).take(picked) for i in range(width)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.int64())], names=names)

    return rows.mapInArrow(run, schema)


def from_bitmaps(bitmaps, keys):
    """Sets from the rows that ``bitmaps.build`` gives."""
    rows = bitmaps.select(*keys, "bucket", "bm")
    names = [*keys, "bucket", "n", "ids"]

    def run(batches):
        for part in _chunks(batches):
            numbers = _numbers(part.column(part.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(_table(part.columns[:-1], *_sets(numbers)), names=names)

    return rows.mapInArrow(run, _schema(rows, keys))


def to_bitmaps(sets, keys):
    """Rows as ``bitmaps.build`` gives them; thin buckets grow to 4,096 bytes."""
    rows = sets.select(*keys, "bucket", "ids")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("bm", T.BinaryType())])

    def run(batches):
        for part in _chunks(batches):
            numbers = _numbers(part.column(part.num_columns - 1).to_pylist())
            bits = np.zeros((part.num_rows, IDS_PER_BUCKET), np.uint8)
            bits[numbers >> _SHIFT, numbers & (IDS_PER_BUCKET - 1)] = 1
            packed = np.packbits(bits, axis=1, bitorder="little")
            maps = pa.array([row.tobytes() for row in packed], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], maps], names=[*keys, "bucket", "bm"])

    return rows.mapInArrow(run, schema)
