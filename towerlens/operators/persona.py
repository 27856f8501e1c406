"""Audience make-up of regions over time windows; the same plan serves batch and stream."""

from pyspark.sql import functions as F

from towerlens.functions import columns as C
from towerlens.operators.skew import lookup_join


def enrich(signal, user_info, heavy_users=None, limit=None):
    """Signals with gender and age; signals of unknown users are dropped."""
    return lookup_join(
        signal, user_info.select("imsi", "gender", "age"), "imsi", heavy=heavy_users, limit=limit
    )


def place(enriched, cells, heavy_cells=None, limit=None):
    """Enriched signals with their region; signals of unmapped cells are dropped.

    ``cells`` has one region per cell (see ``latest.cell_map``).
    """
    return lookup_join(enriched, cells, "laccell", heavy=heavy_cells, limit=limit)


def user_region_flow(signal, user_info, cells, heavy_users=None, heavy_cells=None, limit=None):
    """Signals of known users in mapped cells: the input of all live operators.

    ``user_info`` has one row per user; ``latest.last_per_key`` makes it so for a feed of updates.
    The cell look-up comes first: its dimension is the smaller one, and what it drops need not
    travel to the user look-up. ``limit`` replaces the size below which a dimension is broadcast.
    """
    placed = place(signal, cells, heavy_cells, limit)
    return enrich(placed, user_info, heavy_users, limit)


def persona_windows(flow, length="60 seconds", distinct_users=False):
    """Counters per region and tumbling window.

    Counters are built-in aggregates, so each map task sends one row per region and window.
    ``distinct_users`` adds the exact number of different people (batch only).
    """
    counters = C.persona_counters()
    if distinct_users:
        counters.append(F.count_distinct("imsi").alias("distinct_users"))
    counted = flow.groupBy("region_id", F.window("event_ts", length).alias("_w")).agg(*counters)
    return counted.select(
        "region_id",
        F.col("_w.start").alias("window_start"),
        F.col("_w.end").alias("window_end"),
        *[c for c in counted.columns if c not in ("region_id", "_w")],
    )
