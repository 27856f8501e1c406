"""Newest row per key, newest n rows, and the two readings of the cell dimension."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def last_per_key(df, keys, order):
    """One row per key: the one with the greatest ``order`` (a column name or a list of them).

    This is what a keyed store keeps when rows are put one after the other.
    """
    order = [order] if isinstance(order, str) else list(order)
    values = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_row")
    )
    return newest.select(*keys, "_row.*").select(*df.columns)


def cell_map(region_cell, order):
    """The stream reading of the cell dimension: one region per cell, the last one listed.

    The batch jobs join ``region_cell`` itself instead, where a cell of two regions counts in both.
    """
    return last_per_key(region_cell, ["laccell"], order).select("laccell", "region_id")


def newest(df, n, order, where=None):
    """The newest ``n`` rows, optionally of the rows that satisfy ``where``."""
    kept = df if where is None else df.where(where)
    return kept.orderBy(*order).limit(n)


def newest_per_key(df, keys, n, order, rank="rank"):
    """The newest ``n`` rows of every key with their rank.

    The rank filter lets Spark cut each map task's rows to n per key before the shuffle.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
