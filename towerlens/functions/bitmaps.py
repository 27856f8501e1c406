"""User-id sets as bucketed bitmaps.

One bucket is a 4,096-byte binary that covers 32,768 ids, so a set is a handful of rows
``(keys..., bucket, bm)``. Bucket and bit position come from Spark's own bitmap functions.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from towerlens.operators.skew import fits_broadcast

IDS_PER_BUCKET = 32768


def build(members, keys, id_col="bitmap_id"):
    """Distinct membership rows to bucketed bitmaps; null ids are ignored.

    The rows are shuffled before they are folded: a group has at most 32,768 rows of a few bytes,
    whereas bitmaps folded on the map side would send 4 KiB for every group each task has seen.
    The number of partitions is fixed, as bitmaps that are mostly zeros compress so well that
    Spark would otherwise merge them into too few partitions.
    """
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    present = members.where(F.col(id_col).isNotNull()).select(
        *keys,
        F.bitmap_bucket_number(id_col).alias("bucket"),
        F.bitmap_bit_position(id_col).alias("_position"),
    )
    return (
        present.repartition(partitions, *keys, "bucket")
        .groupBy(*keys, "bucket")
        .agg(F.bitmap_construct_agg("_position").alias("bm"))
    )


def union(bitmaps, keys):
    """Merge all bitmaps of one key, for example the hours of a day."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bm").alias("bm"))


def intersect(left, right, left_keys, right_keys):
    """Every left set AND every right set, bucket by bucket; buckets without a common id have no row.

    ``right`` is the side with fewer sets, such as the portraits. When its checked size allows, it
    is broadcast and the left rows stay where they are; otherwise both sides meet by bucket number.
    Each joined pair is intersected at once on Arrow batches: a pair never becomes two rows, and
    nothing is shuffled or folded behind the join.
    """
    keys = [*left_keys, *right_keys, "bucket"]
    return _intersected(left, right, keys, "bm", T.BinaryType(), lambda both, n: both)


def and_counts(left, right, left_keys, right_keys, name="n_users"):
    """Sizes of all intersections that are not empty, per left and right key.

    Each joined pair of buckets is intersected and counted at once on Arrow batches, so no pair
    is unfolded and no bitmap is sorted; pairs without a common id go no further.
    """
    keys = [*left_keys, *right_keys]
    counted = _intersected(left, right, keys, "_n", T.LongType(), lambda both, n: n)
    return counted.groupBy(*keys).agg(F.sum("_n").alias(name))


def _intersected(left, right, keys, name, kind, result):
    """``keys`` of each pair of buckets with a common id, and ``result`` of its bits and their number."""
    other = right.withColumnRenamed("bm", "_right")
    if fits_broadcast(right):
        other = F.broadcast(other)
    pairs = left.withColumnRenamed("bm", "_left").join(other, "bucket").select(*keys, "_left", "_right")
    schema = T.StructType([pairs.schema[key] for key in keys] + [T.StructField(name, kind)])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def bits(column):
            data = b"".join(column.to_pylist())
            return np.frombuffer(data, dtype=np.uint64).reshape(len(column), -1)

        def column(values):
            return pa.array([v.tobytes() for v in values], pa.binary()) if values.ndim == 2 else pa.array(values)

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                both = bits(part.column(len(keys))) & bits(part.column(len(keys) + 1))
                n = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
                kept = np.flatnonzero(n)
                rows = pa.array(kept)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).take(rows) for i in range(len(keys))] + [column(result(both[kept], n[kept]))],
                    names=[*keys, name],
                )

    return pairs.mapInArrow(run, schema)


def cardinality(bitmaps, keys, name="n_users"):
    """Number of ids per key, summed over the buckets."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("bm")).alias(name))


def expand(bitmaps, keys, id_col="bitmap_id"):
    """Bucketed bitmaps back to one row per id.

    Spark has no bitmap-to-ids function, so the bits are unpacked on Arrow batches with numpy.
    """
    kept = bitmaps.select(*keys, "bucket", "bm")
    schema = T.StructType(
        [kept.schema[key] for key in keys] + [T.StructField(id_col, T.LongType())]
    )
    key_names = list(keys)
    per_bucket = IDS_PER_BUCKET

    def unpack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            # A few dozen buckets at a time: a full one unpacks to 32,768 rows.
            for start in range(0, batch.num_rows, 32):
                part = batch.slice(start, 32)
                if part.num_rows == 0:
                    continue
                packed = np.frombuffer(
                    b"".join(part.column("bm").to_pylist()), dtype=np.uint8
                ).reshape(part.num_rows, -1)
                row, position = np.nonzero(np.unpackbits(packed, axis=1, bitorder="little"))
                bucket = part.column("bucket").to_numpy(zero_copy_only=False)[row]
                # Bucket 0 holds id 0 alone at position 0; from bucket 1 on ids start at 1.
                ids = np.where(bucket == 0, 0, (bucket - 1) * per_bucket + position + 1)
                picked = pa.array(row)
                columns = [part.column(name).take(picked) for name in key_names]
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array(ids, type=pa.int64())], names=key_names + [id_col]
                )

    return kept.mapInArrow(unpack, schema)
