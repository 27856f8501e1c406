"""The read-side questions, each answered with a DataFrame."""

from pyspark.sql import functions as F

from towerlens.operators import latest

# The counters a heat map adds up over all regions.
TOTALLED = ("age_10_20", "age_20_40", "age_40", "man", "women")


def portrait_users(members, portrait_members, region_id, hour, portrait_id):
    """Ids of the users of one portrait who were in one region in one hour.

    ``members`` is the region-hour table and ``portrait_members`` the portrait table. The
    predicates reach the scans: the hour selects a partition folder of the stored table.
    """
    here = members.where(
        (F.col("region_id") == region_id) & (F.col("produce_hour") == hour)
    ).select("bitmap_id")
    group = portrait_members.where(F.col("portrait_id") == portrait_id).select("bitmap_id")
    return here.join(group, "bitmap_id")


def portrait_user_count(members, portrait_members, region_id, hour, portrait_id):
    """Their number; 0 when nobody matches, as the aggregate has no grouping."""
    users = portrait_users(members, portrait_members, region_id, hour, portrait_id)
    return users.agg(F.count(F.lit(1)).alias("n_users"))


def numeric_cells(stored, names):
    """Counters of a table that stores text: a cell that is no number becomes null.

    The sums below skip nulls, so such a cell adds nothing and fails nothing.
    """
    return stored.withColumns({n: F.trim(n).try_cast("bigint") for n in names})


def current_persona(persona):
    """The newest window of each region: what the live table holds."""
    return latest.last_per_key(persona, ["region_id"], "window_start")


def region_portrait(current, centers, region_id=None):
    """Current audience make-up of one region, or of all, with the region's name."""
    rows = current if region_id is None else current.where(F.col("region_id") == region_id)
    return rows.join(centers.select("region_id", "name"), "region_id", "left")


def region_stay_total(totals, region_id=None):
    return totals if region_id is None else totals.where(F.col("region_id") == region_id)


def latest_events(events, region_id, n=50):
    """The newest ``n`` events of a region."""
    return latest.newest(
        events,
        n,
        [F.desc("event_ts"), "imsi", "event_type"],
        where=F.col("region_id") == region_id,
    ).select("imsi", "gender", "age", "event_ts", "event_type")


def latest_events_per_region(events, n=50):
    """The newest ``n`` events of every region, ranked."""
    return latest.newest_per_key(
        events, ["region_id"], n, [F.desc("event_ts"), "imsi", "event_type"]
    )


def heatmap_totals(current):
    """Counters over all regions; zeros when there are no regions."""
    return current.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in TOTALLED])


def heatmap_regions(current, centers):
    """Number of signals per region with its centre and boundary, where known."""
    placed = current.select("region_id", "pep_cnt").join(
        centers.select("region_id", "center", "boundary"), "region_id", "left"
    )
    return placed.select("region_id", "pep_cnt", "center", "boundary")


def heatmap_flat(current, centers):
    """All counters per region with name, centre and boundary, where known."""
    return current.join(
        centers.select("region_id", "name", "center", "boundary"), "region_id", "left"
    )


def center_columns(df):
    """Centre and boundary as plain columns."""
    return df.withColumns(
        {
            "center_x": F.get("center", F.lit(0)),
            "center_y": F.get("center", F.lit(1)),
            "n_boundary_points": F.size("boundary").try_cast("int"),
        }
    ).drop("center", "boundary")
