"""The batch jobs, from inputs to stored tables: user index, portraits, region hours, visits."""

from pyspark.sql import functions as F

from towerlens.operators import flow, portraits, region_hours, user_index
from towerlens.operators.skew import heavy_keys
from towerlens.session import materialise
from towerlens.sinks import tables as sink


def build_user_index(user_info, path, existing=None):
    """Write the index, or add the subscribers that ``existing`` (read from ``path``) lacks."""
    if existing is None:
        sink.overwrite(user_index.dense_ids(user_info), path)
    else:
        sink.append_index(user_index.extend_ids(existing, user_info), path)


def build_portraits(user_info, index, path, scheme=portraits.STANDARD):
    """Write portrait membership; the table is replaced as a whole."""
    labelled = portraits.user_portraits(user_info, index, scheme)
    sink.overwrite(portraits.portrait_members(labelled, scheme), path)


def build_region_hours(signal, region_cell, index, path, load, how="left", write=sink.overwrite_hours):
    """Write the region-hour membership that one load of signals gives.

    ``write`` is ``sink.overwrite_hours``, a folder per hour and load, which suits hourly loads, or
    ``sink.overwrite_load``, one folder of sorted ranges, which suits loads of many hours.
    """
    heavy = heavy_keys(signal, "laccell")
    members = region_hours.region_hour_members(signal, region_cell, index, how, heavy)
    write(members, path, load)


def build_visits(placed, path, load, after, threshold_ms, targets=None, heavy=None):
    """Write the flow and stay events that one load of placed signals adds, and what is carried over.

    ``after`` names the load before, or is None for the first. The job reads its own signals and
    the visits that load left open, one row per subscriber, and no older history. Each table has a
    folder per load, so a load that is run again replaces its own rows; loads behind it that have
    run already must then be run again too. Loads follow each other in time.
    """
    spark = placed.sparkSession
    carried = read_carried(spark, path, after)
    newest = placed.agg(F.max("event_ts")).first()[0]
    horizon = F.lit(newest).cast("timestamp")
    # Written once, as three tables come of it.
    changes = materialise(flow.load_changes(placed, carried, heavy))
    sink.overwrite(flow.load_flow_events(changes, targets), f"{path}/flow_events/load={load}")
    stays = flow.load_stay_events(changes, threshold_ms, horizon, targets)
    sink.overwrite(stays, f"{path}/stay_events/load={load}")
    sink.overwrite(flow.carry_over(changes, threshold_ms, horizon), f"{path}/carried/load={load}")


def read_carried(spark, path, load):
    """The visits that a load left open, in ``flow.CARRIED``; none for no load."""
    if load is None:
        return spark.createDataFrame([], flow.CARRIED)
    return spark.read.schema(flow.CARRIED).parquet(f"{path}/carried/load={load}")
