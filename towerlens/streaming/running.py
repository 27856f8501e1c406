"""The number of long stays per region after every change, as a second stateful step."""

import sys
from collections import namedtuple
from itertools import chain

from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from towerlens.operators.flow import STAY_BEGAN, STAY_ENDED
from towerlens.streaming.visits import SlicedRows, fields_of, micros, output_row

# As the tracker, this step travels to the Python workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNT_SCHEMA = "region_id string, event_us long, imsi string, event_type int, stay_count long"
_SLICE_SCHEMA = "start_us long, start_type long, piece long, n long"
_SLICE_VALUE = "event_us array<long>, fields binary"

_Change = namedtuple("_Change", "event_us event_type imsi")
_Count = output_row("_Count", "region_id event_us imsi event_type stay_count")


class RunningStays(SlicedRows, StatefulProcessor):
    """Counts one region's long stays, in the order of (event time, event type, imsi).

    Changes wait until the watermark has passed them, so the order does not depend on how the
    tracker in front was called; those of a busy region lie in slices of time.
    """

    record = _Change

    def init(self, handle):
        self.handle = handle
        self.count = handle.getValueState("count", "n long")
        self.pending = handle.getMapState("slices", _SLICE_SCHEMA, _SLICE_VALUE)

    def handleInputRows(self, key, rows, timerValues):
        self._take_in(_changes(iter(rows)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.count.get()
        before = count = 0 if held is None else held[0]
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        for change in self._due(self._slices(), now_us):
            count += 1 if change.event_type == STAY_BEGAN else -1
            yield _Count(key[0], change.event_us, change.imsi, change.event_type, count)
        if count != before or held is None:
            self.count.update((count,))

    def close(self):
        pass


def _changes(rows):
    """Rows with the fields of a change, or those of ``running_stays`` with a time and a text."""
    for first in rows:
        rows = chain([first], rows)
        if "change" not in first:
            yield from fields_of(rows, _Change._fields)
            return
        for time, text in fields_of(rows, ("event_ts", "change")):
            kind, named, imsi = text.partition(" ")
            yield micros(time), int(kind), imsi if named else None


def running_stays(events):
    """One row per change of a region's number of long stays, from chained ``visit_events``."""
    # As for the tracker, all but the time is one cell; a null imsi leaves the event type alone.
    change = F.concat_ws(" ", "event_type", "imsi").alias("change")
    changes = events.where(F.col("event_type").isin(STAY_BEGAN, STAY_ENDED)).select(
        "region_id", "event_ts", change
    )
    counts = changes.groupBy("region_id").transformWithState(
        statefulProcessor=RunningStays(),
        outputStructType=COUNT_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )
    return counts.select(
        "region_id", F.timestamp_micros("event_us").alias("event_ts"), "imsi", "event_type", "stay_count"
    )
