"""Region lists: adjacent de-duplication and a reproducible uniform sample."""

from pyspark.sql import functions as F

from towerlens.operators.skew import with_neighbour
from towerlens.session import materialise


def drop_adjacent_repeats(df, order, value, slices=None):
    """Drop rows whose value equals that of the row before, in the order of a column.

    ``order`` is any sortable column, such as a number or the struct of ``files.read_lines``. The
    order is global, so the rows are range-partitioned by it into slices of about equal size, which
    are written once to keep their borders; only the two border rows of each slice meet in one task.
    """
    ranged = df.repartitionByRange(order) if slices is None else df.repartitionByRange(slices, order)
    sliced = materialise(ranged.withColumn("_slice", F.spark_partition_id()))
    is_change = F.col("_before").isNull() | (F.col("_before") != F.col(value))
    kept = with_neighbour(
        sliced, [], [order], {"_before": value}, "previous", "_slice", is_change
    )
    return kept.drop("_before", "_slice")


def uniform_sample(df, k, id_cols, seed=0):
    """``k`` rows chosen uniformly and reproducibly (all rows when there are fewer).

    Rows are ranked by a hash of their identity, so each task keeps its own first k and only those
    meet for the final choice.
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed)))
    return df.orderBy(F.md5(text), *id_cols).limit(k)
