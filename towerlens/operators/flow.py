"""Region visits in batch form: enter and leave events, long stays, running stay totals."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from towerlens.operators.skew import with_neighbour, with_slice

LEAVE, ENTER, STAY_BEGAN, STAY_ENDED = 0, 1, 2, 3

# Length of the time slices that spread the rows of one heavy subscriber over tasks.
HEAVY_SLICE_MS = 60_000

ORDER = ("event_ts", "event_id")


def region_changes(flow, heavy=None, slice_ms=HEAVY_SLICE_MS):
    """The rows at which a subscriber's region changes, with ``prev_region`` and ``exit_ts``.

    ``prev_region`` is null at the first sighting, ``exit_ts`` is null for the current visit.
    Both look-ups use the same partitioning by subscriber and sort order, hence one shuffle.
    Subscribers listed in ``heavy`` are spread over time slices.
    """
    slice_col = None
    if heavy is not None:
        flow = with_slice(flow, "imsi", "event_ts", heavy, slice_ms)
        slice_col = "_slice"
    is_change = F.col("prev_region").isNull() | (F.col("prev_region") != F.col("region_id"))
    changed = with_neighbour(
        flow, ["imsi"], ORDER, {"prev_region": "region_id"}, "previous", slice_col, is_change
    )
    visits = with_neighbour(changed, ["imsi"], ORDER, {"exit_ts": "event_ts"}, "next", slice_col)
    return visits.drop("_slice")


CARRIED = "imsi string, region_id string, gender string, age int, event_ts timestamp, event_id long, reported boolean"


def load_changes(flow, carried, heavy=None):
    """``region_changes`` of one load, going on from the visits that the loads before left open.

    ``carried`` has at most one row per subscriber (see ``carry_over``), which stands in front of
    the load's own rows. Loads follow each other in time. ``reported`` is null for rows of the load.
    """
    names = ("imsi", "region_id", "gender", "age", "event_ts", "event_id")
    own = flow.select(*names, F.lit(None).cast("boolean").alias("reported"))
    return region_changes(carried.select(*names, "reported").unionByName(own), heavy)


def load_flow_events(changes, targets=None):
    """Enter and leave events that a load adds; those of carried visits came with their own load."""
    return flow_events(changes.where(F.col("reported").isNull()), targets)


def load_stay_events(changes, threshold_ms, horizon, targets=None):
    """Stay events that a load adds. ``horizon`` is how far time has advanced with it."""
    rows = changes.where(~F.col("reported") | F.col("reported").isNull())
    began = stay_events(visits(rows, targets), threshold_ms, horizon)
    before = visits(changes.where("reported"), targets)
    return began.unionByName(
        before.where(F.col("exit_ts").isNotNull()).select(
            "imsi", F.lit(STAY_ENDED).alias("event_type"), "region_id", "gender", "age",
            F.col("exit_ts").alias("event_ts"),
        )
    )


def carry_over(changes, threshold_ms, horizon):
    """The open visit of every subscriber behind a load, in CARRIED; ``reported`` says whether its
    long stay has been told."""
    due = F.timestamp_micros(F.unix_micros("event_ts") + F.lit(threshold_ms * 1000))
    told = F.coalesce("reported", F.lit(False)) | F.coalesce(due <= horizon, F.lit(False))
    return changes.where(F.col("exit_ts").isNull()).select(
        "imsi", "region_id", "gender", "age", "event_ts", "event_id", told.alias("reported")
    )


def watched(df, targets):
    """Keep the rows of watched regions; no watch list means every region."""
    if targets is None:
        return df
    return df.join(targets.select("region_id"), "region_id", "left_semi")


def flow_events(changes, targets=None):
    """Leave (0) and enter (1) events of watched regions.

    A change of region gives a leave event for the old region and an enter event for the new one,
    each only if that region is watched; a first sighting gives an enter event alone.
    """
    shared = ("imsi", "gender", "age", "event_ts")
    steps = F.array(
        F.struct(F.lit(LEAVE).alias("event_type"), F.col("prev_region").alias("region_id")),
        F.struct(F.lit(ENTER).alias("event_type"), F.col("region_id").alias("region_id")),
    )
    events = (
        changes.select(*shared, F.explode(steps).alias("_e"))
        .select("imsi", "_e.event_type", "_e.region_id", "gender", "age", "event_ts")
        .where(F.col("region_id").isNotNull())
    )
    return watched(events, targets)


def visits(changes, targets=None):
    """Visits to watched regions: entry time and, once left, exit time."""
    rows = changes.select(
        "imsi", "region_id", "gender", "age", F.col("event_ts").alias("enter_ts"), "exit_ts"
    )
    return watched(rows, targets)


def stay_events(visit_rows, threshold_ms, horizon):
    """Long-stay events: 2 when a visit reaches the threshold, 3 when such a visit ends.

    A visit that ends exactly at the threshold counts as a long stay. ``horizon`` is a scalar
    column: how far time has advanced for visits that are still open.
    """
    due = F.timestamp_micros(F.unix_micros("enter_ts") + F.lit(threshold_ms * 1000))
    reached = F.col("_due") <= F.coalesce("exit_ts", horizon)
    steps = F.array(
        F.struct(F.lit(STAY_BEGAN).alias("event_type"), F.col("_due").alias("event_ts")),
        F.struct(F.lit(STAY_ENDED).alias("event_type"), F.col("exit_ts").alias("event_ts")),
    )
    return (
        visit_rows.withColumn("_due", due)
        .where(reached)
        .select("imsi", "region_id", "gender", "age", F.explode(steps).alias("_e"))
        .select("imsi", "_e.event_type", "region_id", "gender", "age", "_e.event_ts")
        .where(F.col("event_ts").isNotNull())
    )


def stay_deltas(events):
    """+1 for a stay that began, -1 for one that ended; other event types are dropped."""
    return events.where(F.col("event_type").isin(STAY_BEGAN, STAY_ENDED)).withColumn(
        "delta", F.when(F.col("event_type") == STAY_BEGAN, 1).otherwise(-1).cast("bigint")
    )


def stay_totals(deltas):
    """Current number of long stays per region, with the time of the last change."""
    return deltas.groupBy("region_id").agg(
        F.sum("delta").alias("stay_count"), F.max("event_ts").alias("ts")
    )


def running_stays(deltas, slice_ms=3_600_000):
    """Number of long stays per region after every change.

    A region may have any number of changes, so its running sum is split by time slice: rows are
    summed inside (region, slice), and each slice adds the total of the slices before it. Only one
    row per region and slice meets in the window over the region.
    """
    number = F.floor(F.unix_millis("event_ts") / F.lit(slice_ms)).cast("bigint")
    placed = deltas.withColumn("_slice", number)
    inside = (
        Window.partitionBy("region_id", "_slice")
        .orderBy("event_ts", "event_type", "imsi")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy("region_id")
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        placed.groupBy("region_id", "_slice")
        .agg(F.sum("delta").alias("_sum"))
        .select("region_id", "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    )
    summed = placed.withColumn("_inside", F.sum("delta").over(inside))
    return summed.join(starts, ["region_id", "_slice"]).select(
        "region_id",
        "event_ts",
        "imsi",
        "event_type",
        (F.col("_inside") + F.col("_start")).alias("stay_count"),
    )
