"""Dense, stable integer ids for subscribers."""

from pyspark.sql import functions as F

from towerlens.session import materialise

# monotonically_increasing_id keeps the row number inside a partition in its low 33 bits.
_ROW_BITS = 33


def dense_ids(df, key="imsi", id_col="bitmap_id", first=1):
    """``(key, id)`` with ids first, first+1, ... in the order of the distinct keys.

    The distinct keys are range-partitioned and sorted, and each row notes its partition and its
    place there. That step is materialised, so later passes see the same range borders. One count
    per partition then gives each partition its starting id. No task sees more than one range.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    placed = materialise(
        keys.repartitionByRange(key)
        .sortWithinPartitions(key)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    partition = F.shiftright("_place", _ROW_BITS)
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))

    # One count per partition of the frame: a list as long as the number of partitions.
    counts = dict(placed.groupBy(partition.alias("p")).agg(F.max(row) + 1).collect())
    starts, start = [], first
    for number in range(max(counts, default=-1) + 1):
        starts.append(start)
        start += counts.get(number, 0)
    offset = F.get(F.lit(starts or [first]).cast("array<bigint>"), partition.cast("int"))
    return placed.select(key, (offset + row).alias(id_col))


def extend_ids(existing, df, key="imsi", id_col="bitmap_id"):
    """Ids for the keys of ``df`` that ``existing`` does not know; known ids do not move."""
    unseen = df.select(key).distinct().join(existing.select(key), key, "left_anti")
    last = existing.agg(F.max(id_col)).first()[0] or 0
    return dense_ids(unseen, key, id_col, first=last + 1)
