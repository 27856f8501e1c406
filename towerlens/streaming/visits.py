"""Enter, leave and long-stay events on a stream of placed signals.

Event types are those of the batch form: 0 leave, 1 enter, 2 long stay began, 3 long stay ended.
"""

import json
import pickle
import sys
from bisect import bisect_left, bisect_right
from collections import namedtuple
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from itertools import chain, islice
from operator import itemgetter

from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from towerlens.operators.flow import ENTER, LEAVE, STAY_BEGAN, STAY_ENDED

# The tracker travels to the Python workers by value, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENT_SCHEMA = "imsi string, event_type int, region_id string, gender string, age int, event_us long"

# One row holds the signals of one micro-batch as parallel arrays.
_PENDING_SCHEMA = (
    "event_us array<long>, event_id array<long>, region_id array<string>, "
    "watched array<boolean>, gender array<string>, age array<int>"
)
# A piece of a slice: the times, and the other fields as one pickled value. As arrays every field of
# every row would pass Spark's conversions of single values, which cost more than the tracking.
_SLICE_VALUE = "event_us array<long>, fields binary"
# Where a slice of time begins, the number of a piece of it, and the signals of that piece.
_SLICE_SCHEMA = "start_us long, start_id long, piece long, n long"
# The most signals of a slice; those of one subscriber, time and event id stay together.
SLICE = 1 << 15
# Descriptions of a place and person that a task keeps read.
_PERSONS = 1 << 12
_LEAST = (-(1 << 63), -(1 << 63))
_VISIT_SCHEMA = (
    "region_id string, watched boolean, due_us long, reported boolean, gender string, age int, "
    "seen_us long"
)

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

_Signal = namedtuple("_Signal", "event_us event_id region_id watched gender age")
_Visit = namedtuple("_Visit", "region_id watched due_us reported gender age seen_us")


def output_row(name, fields):
    """A row that a processor gives out. Spark asks it for its dictionary only, which ``Row`` makes
    by a walk through every value."""

    def as_dict(self, recursive=False):
        return dict(zip(self._fields, self))

    return type(name, (namedtuple(name, fields),), {"__slots__": (), "asDict": as_dict})


_Event = output_row("_Event", "imsi event_type region_id gender age event_us")
_TimedEvent = output_row("_TimedEvent", "imsi event_type region_id gender age event_us event_ts")


def fields_of(rows, names):
    """The named fields of rows of one schema; the places of the names are looked up once."""
    rows = iter(rows)
    for first in rows:
        if hasattr(first, "__fields__"):
            at = itemgetter(*map(first.__fields__.index, names))
            yield at(tuple(first))
            yield from map(at, map(tuple, rows))
        else:
            pick = itemgetter(*names)
            yield pick(first)
            yield from map(pick, rows)


class VisitTracker(StatefulProcessor):
    """Follows one subscriber through the regions.

    In event time, signals wait in ``pending`` until the watermark has passed them and are then
    handled in the order of (event time, event id), so the result does not depend on how the
    input was cut into micro-batches. In processing time they are handled as they arrive.

    A visit becomes a long stay at ``due_us``. Before any signal is handled, a visit that is
    already due is reported; a timer covers visits that see no further signal.

    In event time, ``expire_ms`` forgets a subscriber whose last signal lies that far behind the
    watermark: the state goes without an event, and the next signal counts as a first sighting.
    """

    def __init__(self, threshold_ms, event_time=True, ttl_ms=None, expire_ms=None, kinds=None):
        self.threshold_us = threshold_ms * 1000
        self.event_time = event_time
        self.ttl_ms = ttl_ms
        self.kinds = kinds
        self.expire_us = expire_ms * 1000 if event_time and expire_ms is not None else None

    def init(self, handle):
        self.handle = handle
        self.visit = handle.getValueState("visit", _VISIT_SCHEMA, self.ttl_ms)
        if self.event_time:
            self.pending = handle.getListState("pending", _PENDING_SCHEMA)

    def handleInitialState(self, key, initialState, timerValues):
        """Go on from a visit that batch loads left open (see ``open_visits``)."""
        visit = _Visit(*(initialState[name] for name in _Visit._fields))
        self.visit.update(tuple(visit))
        if visit.watched and not visit.reported:
            self._wake(visit.due_us)
        if self.expire_us is not None:
            self._wake(visit.seen_us + self.expire_us)

    def handleInputRows(self, key, rows, timerValues):
        arrived = [_Signal(*(row[name] for name in _Signal._fields)) for row in rows]
        if self.event_time:
            self.pending.appendList([_packed(arrived)])
            self._wake(min(signal.event_us for signal in arrived))
            return
        now_us = timerValues.getCurrentProcessingTimeInMs() * 1000
        yield from self._advance(key[0], sorted(arrived), now_us)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.event_time:
            now_us = timerValues.getCurrentProcessingTimeInMs() * 1000
            yield from self._advance(key[0], [], now_us)
            return
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(
            _Signal(*values) for packed in self.pending.get() for values in zip(*packed)
        )
        ready = [signal for signal in waiting if signal.event_us <= now_us]
        later = waiting[len(ready) :]
        if later:
            self._wake(later[0].event_us)
        if ready:
            if later:
                self.pending.put([_packed(later)])
            else:
                self.pending.clear()
        yield from self._advance(key[0], ready, now_us)
        if self.expire_us is not None and not later:
            visit = self.visit.get()
            if visit is not None and _Visit(*visit).seen_us + self.expire_us <= now_us:
                self.visit.clear()

    def close(self):
        pass

    def _wake(self, time_us):
        self.handle.registerTimer(-(-time_us // 1000))

    def _advance(self, imsi, signals, now_us):
        held = self.visit.get()
        before = None if held is None else _Visit(*held)
        visit, events, any_signal = before, [], False
        for signal in signals:
            any_signal = True
            clock = signal.event_us if self.event_time else now_us
            visit = self._report(imsi, visit, clock, events)
            if events:
                yield from (_Event(*event) for event in events)
                events = []
            if visit is not None and visit.region_id == signal.region_id:
                if self.expire_us is not None:
                    visit = visit._replace(seen_us=signal.event_us)
                continue
            person = (signal.gender, signal.age, signal.event_us)
            if visit is not None and visit.watched:
                if visit.reported:
                    events.append((imsi, STAY_ENDED, visit.region_id, *person))
                events.append((imsi, LEAVE, visit.region_id, *person))
            if signal.watched:
                events.append((imsi, ENTER, signal.region_id, *person))
            visit = _Visit(
                signal.region_id,
                bool(signal.watched),
                clock + self.threshold_us,
                False,
                signal.gender,
                signal.age,
                signal.event_us,
            )
        visit = self._report(imsi, visit, now_us, events)
        if visit != before:
            self.visit.update(tuple(visit))
        if visit is not None and visit.watched and not visit.reported:
            self._wake(visit.due_us)
        if self.expire_us is not None and any_signal:
            self._wake(visit.seen_us + self.expire_us)
        yield from (_Event(*event) for event in events)

    @staticmethod
    def _report(imsi, visit, clock, events):
        """Report a visit that has become a long stay by ``clock``."""
        if visit is None or not visit.watched or visit.reported or visit.due_us > clock:
            return visit
        events.append((imsi, STAY_BEGAN, visit.region_id, visit.gender, visit.age, visit.due_us))
        return visit._replace(reported=True)


class SlicedRows:
    """Rows that wait in a map ``pending`` by slices of time, for a processor to take in order.

    A ``record`` is a tuple whose first two fields are longs that order it, the time first. A slice
    that outgrows ``SLICE`` rows is split, and slices are read one after the other once they are
    due, so of a key with any number of rows about two slices are in memory.
    """

    def _take_in(self, arrived):
        """Hold rows back; they wake the key once the watermark has passed the first of them."""
        slices, first_us = self._slices(), None
        while chunk := sorted(islice(arrived, SLICE)):
            first_us = chunk[0][0] if first_us is None else min(first_us, chunk[0][0])
            self._hold(slices, chunk)
        self._wake(first_us)

    def _wake(self, time_us):
        self.handle.registerTimer(-(-time_us // 1000))

    def _slices(self):
        """{start of a slice: keys of its pieces}."""
        found = {}
        for held in list(self.pending.keys()):
            found.setdefault(tuple(held[:2]), []).append(tuple(held))
        return found

    def _due(self, slices, now_us):
        """The rows up to ``now_us`` in order; they leave the state."""
        for start in sorted(slices):
            if start[0] > now_us:
                self._wake(start[0])
                return
            signals = self._read(slices[start])
            ready = bisect_right(signals, now_us, key=lambda signal: signal[0])
            if ready:
                self._remove(slices, start)
                if ready < len(signals):
                    self._put(slices, start, signals[ready:])
            yield from signals[:ready]
            if ready < len(signals):
                self._wake(signals[ready][0])
                return

    def _hold(self, slices, chunk):
        starts, at = sorted({_LEAST, *slices}), 0
        while at < len(chunk):
            after = bisect_right(starts, chunk[at][:2])
            stop = len(chunk)
            if after < len(starts):
                stop = bisect_left(chunk, starts[after], key=lambda signal: signal[:2])
            self._add(slices, starts[after - 1], chunk[at:stop])
            at = stop

    def _add(self, slices, start, signals):
        held = slices.get(start, [])
        if not held or sum(piece[3] for piece in held) + len(signals) <= SLICE:
            self._put(slices, start, signals)
            return
        signals = sorted(self._read(held) + signals)
        self._remove(slices, start)
        at = 0
        while at < len(signals):
            stop = min(at + max(SLICE // 2, 1), len(signals))
            while stop < len(signals) and signals[stop][:2] == signals[stop - 1][:2]:
                stop += 1
            self._put(slices, signals[at][:2] if at else start, signals[at:stop])
            at = stop

    def _read(self, pieces):
        found = []
        for piece in pieces:
            times, fields = self.pending.getValue(piece)
            found += map(self.record._make, zip(times, *pickle.loads(fields)))
        return sorted(found)

    def _remove(self, slices, start):
        for piece in slices.pop(start):
            self.pending.removeKey(piece)

    def _put(self, slices, start, signals):
        pieces = slices.setdefault(start, [])
        piece = (*start, len(pieces), len(signals))
        times, *fields = _packed(signals)
        self.pending.updateValue(piece, (times, pickle.dumps(fields, pickle.HIGHEST_PROTOCOL)))
        pieces.append(piece)


class SlicedVisitTracker(SlicedRows, VisitTracker):
    """The tracker in event time, with waiting signals by slices of time in a map."""

    record = _Signal

    def init(self, handle):
        self.handle = handle
        self.visit = handle.getValueState("visit", _VISIT_SCHEMA, self.ttl_ms)
        self.pending = handle.getMapState("slices", _SLICE_SCHEMA, _SLICE_VALUE)
        self._person = lru_cache(_PERSONS)(_person)

    def handleInputRows(self, key, rows, timerValues):
        self._take_in(self._signals(rows))
        yield from ()

    def _signals(self, rows):
        """Rows with the fields of a signal, or those of ``visit_events`` with a time and a text."""
        rows = iter(rows)
        for first in rows:
            rows = chain([first], rows)
            if "signal" not in first:
                yield from fields_of(rows, _Signal._fields)
                return
            for time, text in fields_of(rows, ("event_ts", "signal")):
                number, _, person = text.partition(" ")
                yield micros(time), int(number) if number else None, *self._person(person)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        slices = self._slices()
        yield from self._advance(key[0], self._due(slices, now_us), now_us)
        if self.expire_us is not None and not slices:
            visit = self.visit.get()
            if visit is not None and _Visit(*visit).seen_us + self.expire_us <= now_us:
                self.visit.clear()


class TimedVisitTracker(SlicedVisitTracker):
    """The tracker with the event's time as a timestamp too, for a stateful step behind it. Spark
    collects all that the timers of a task give out, so only the ``kinds`` that this step reads go there.
    """

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for event in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
            if self.kinds is None or event.event_type in self.kinds:
                yield _TimedEvent(*event, _EPOCH + timedelta(microseconds=event.event_us))


def micros(time):
    """Microseconds since 1970, without the rounding of seconds as a float."""
    if time is None:
        return None
    past = (time if time.tzinfo else time.astimezone()) - _EPOCH
    return (past.days * 86_400 + past.seconds) * 1_000_000 + past.microseconds


def _person(text):
    found = json.loads(text)
    return tuple(map(found.get, _Signal._fields[2:]))


def _packed(signals):
    return tuple(map(list, zip(*signals)))


def visit_events(
    flow,
    threshold_ms,
    event_time=True,
    ttl_ms=None,
    expire_ms=None,
    opened=None,
    chained=False,
    kinds=None,
):
    """The event stream of a flow with a ``watched`` flag (see ``live.with_watch_flag``).

    ``ttl_ms`` drops the state of subscribers not seen for that long; Spark offers it in
    processing time only. ``expire_ms`` does so in event time, by timers. ``opened`` holds visits
    that are open when the stream starts, one per subscriber (see ``open_visits``). With
    ``chained`` the events keep a watermark, so another stateful step may follow, and ``kinds`` may
    name the event types that it reads.
    """
    if event_time:
        # Python gets every cell of every row by itself, so all but the time is one text.
        number = F.coalesce(F.col("event_id").cast("string"), F.lit(""))
        person = F.to_json(F.struct(*_Signal._fields[2:]))
        rows = flow.select("imsi", "event_ts", F.concat(number, F.lit(" "), person).alias("signal"))
    else:
        time_us = F.unix_micros("event_ts").alias("event_us")
        rows = flow.select("imsi", "event_ts", time_us, *_Signal._fields[1:])
    tracker = TimedVisitTracker if chained else SlicedVisitTracker if event_time else VisitTracker
    more = {"eventTimeColumnName": "event_ts"} if chained else {}
    if opened is not None:
        more["initialState"] = opened.groupBy("imsi")
    events = rows.groupBy("imsi").transformWithState(
        statefulProcessor=tracker(threshold_ms, event_time, ttl_ms, expire_ms, kinds),
        outputStructType=f"{EVENT_SCHEMA}, event_ts timestamp" if chained else EVENT_SCHEMA,
        outputMode="Append",
        timeMode="EventTime" if event_time else "ProcessingTime",
        **more,
    )
    if chained:
        return events
    return events.select(
        "imsi",
        "event_type",
        "region_id",
        "gender",
        "age",
        F.timestamp_micros("event_us").alias("event_ts"),
    )


def open_visits(carried, targets, threshold_ms):
    """The state in which a stream goes on behind batch loads; ``carried`` is of ``flow.carry_over``."""
    if targets is None:
        watched = carried.withColumn("watched", F.lit(True))
    else:
        listed = targets.select("region_id").distinct().withColumn("_listed", F.lit(True))
        watched = carried.join(listed, "region_id", "left").withColumn(
            "watched", F.coalesce("_listed", F.lit(False))
        )
    entered = F.unix_micros("event_ts")
    return watched.select(
        "imsi", "region_id", "watched", (entered + threshold_ms * 1000).alias("due_us"), "reported",
        "gender", "age", entered.alias("seen_us"),
    )


def current_visits(spark, checkpoint, threshold_ms):
    """Who is in which watched region now, and since when, from the state of a running or stopped
    ``start_visits``, as its last finished micro-batch left it.

    Spark reads the state from the checkpoint, so the stream is neither asked nor held up.
    """
    held = (
        spark.read.format("statestore")
        .option("path", checkpoint)
        .option("stateVarName", "visit")
        .load()
    )
    return held.where("value.watched").select(
        F.col("key.imsi").alias("imsi"),
        F.col("value.region_id").alias("region_id"),
        F.timestamp_micros(F.col("value.due_us") - threshold_ms * 1000).alias("enter_ts"),
        F.col("value.reported").alias("long_stay"),
        F.col("value.gender").alias("gender"),
        F.col("value.age").alias("age"),
    )
