"""Which subscribers were in which region in which hour."""

from pyspark.sql import functions as F

from towerlens.functions import columns as C
from towerlens.operators.skew import lookup_join


def region_hour_members(
    signal, region_cell, user_index, how="left", heavy_cells=None, fold_unknown=True, limit=None
):
    """``(region_id, produce_hour, bitmap_id)``, each row once.

    ``how='left'`` keeps signals of unmapped cells (null region) and of unknown users (null id);
    ``'inner'`` drops both. A cell that belongs to two regions counts in both.

    Signals shrink to one row per person, region and hour before they meet the user index, and
    that step combines on the map side. A person then has at most one row per region and hour, so
    the join on imsi has no unbounded key. With inner joins its result is already distinct; with
    left joins only the unknown users, who share the null id, have to be folded once more; callers
    that ignore null ids spare that shuffle with ``fold_unknown=False``.
    """
    seen = signal.select("imsi", "laccell", F.date_trunc("hour", "event_ts").alias("_hour"))
    if how == "inner":
        seen = seen.where(F.col("imsi").isNotNull())
    cells = region_cell.select("region_id", "laccell")
    placed = lookup_join(seen, cells, "laccell", how, heavy_cells, limit)
    people = placed.select("imsi", "region_id", "_hour").distinct()
    named = people.join(user_index, "imsi", how).select("region_id", "_hour", "bitmap_id")
    if how == "left" and fold_unknown:
        named = named.distinct()
    return named.select("region_id", C.hour_text("_hour").alias("produce_hour"), "bitmap_id")


def region_hour_counts(members):
    """Users per region and hour; a group of only unknown users counts 0."""
    return members.groupBy("region_id", "produce_hour").agg(
        F.count("bitmap_id").alias("n_users")
    )


def matrix(members, labelled, portrait_id_of):
    """Users per region, hour and portrait, for all of them at once.

    Each user's labels stay together in one row, so the join does not multiply the membership
    rows; the labels are unfolded after it, just before the map-side count.
    """
    known = members.where(F.col("bitmap_id").isNotNull())
    return (
        known.join(labelled, "bitmap_id")
        .select("region_id", "produce_hour", F.explode("portrait_values").alias("_value"))
        .groupBy("region_id", "produce_hour", "_value")
        .agg(F.count(F.lit(1)).alias("n_users"))
        .select(
            "region_id",
            "produce_hour",
            F.try_element_at(portrait_id_of, F.col("_value")).alias("portrait_id"),
            "n_users",
        )
    )
