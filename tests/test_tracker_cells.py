"""What the stateful steps hand to Spark by row: few cells, and nothing that is not read."""

import json
from datetime import datetime, timezone

from pyspark.sql import Row

from tests.helpers import START_US, us
from tests.test_tracker import TARGETS, THRESHOLD, Clock, rows
from tests.test_tracker_slices import MapHandle, fire
from towerlens.operators import flow
from towerlens.streaming import running, visits

SIGNALS = [(0, "A", 0), (1, "B", 40), (2, "X", 41), (3, "A", 50)]
END = START_US // 1000 + 900_000


def tracked(tracker, batch):
    handle = MapHandle()
    tracker.init(handle)
    got = list(tracker.handleInputRows(("u",), batch, Clock(0)))
    held = dict(tracker.pending.held)
    fire(handle, tracker, END, got)
    return got, held


def packed(plain):
    """As ``visit_events`` sends signals: the time, and the rest as one text."""
    for row in plain:
        place = {n: row[n] for n in ("region_id", "watched", "gender", "age") if row[n] is not None}
        time = datetime.fromtimestamp(row["event_us"] // 1_000_000, timezone.utc)
        yield Row(imsi="u", event_ts=time, signal=f"{row['event_id']} {json.dumps(place)}")


def test_packed_signals_give_the_events_of_plain_ones():
    plain, _ = tracked(visits.SlicedVisitTracker(THRESHOLD * 1000), rows(SIGNALS))
    short, _ = tracked(visits.SlicedVisitTracker(THRESHOLD * 1000), packed(rows(SIGNALS)))
    assert short == plain and len(plain) == 8
    bare = Row(event_us=us(0), event_id=1, region_id="A", watched="A" in TARGETS, gender=None, age=None)
    got, _ = tracked(visits.SlicedVisitTracker(THRESHOLD * 1000), packed([bare]))
    assert [(e.gender, e.age) for e in got] == [(None, None)] * 2


def test_a_piece_of_a_slice_is_two_values():
    _, held = tracked(visits.SlicedVisitTracker(THRESHOLD * 1000), rows(SIGNALS))
    for times, fields in held.values():
        assert times == [us(s) for *_, s in SIGNALS] and isinstance(fields, bytes)


def test_chained_tracker_gives_out_only_the_kinds_that_are_read():
    kinds = (flow.STAY_BEGAN, flow.STAY_ENDED)
    every, _ = tracked(visits.TimedVisitTracker(THRESHOLD * 1000), rows(SIGNALS))
    some, _ = tracked(visits.TimedVisitTracker(THRESHOLD * 1000, kinds=kinds), rows(SIGNALS))
    assert some == [e for e in every if e.event_type in kinds] and 0 < len(some) < len(every)
    assert some[0].asDict(True) == dict(zip(some[0]._fields, some[0]))


def test_packed_changes_give_the_counts_of_plain_ones():
    changes = [(us(5), 2, "a"), (us(7), 3, "a b"), (us(9), 2, None)]
    times = [datetime.fromtimestamp(t // 1_000_000, timezone.utc) for t, *_ in changes]
    given = {
        "plain": [Row(event_us=t, event_type=k, imsi=i) for t, k, i in changes],
        "packed": [
            Row(region_id="A", event_ts=at, change=f"{k}" if i is None else f"{k} {i}")
            for at, (_, k, i) in zip(times, changes)
        ],
    }
    got = {}
    for form, batch in given.items():
        handle, step = MapHandle(), running.RunningStays()
        step.init(handle)
        found = list(step.handleInputRows(("u",), iter(batch), Clock(0)))
        fire(handle, step, END, found)
        got[form] = [tuple(r) for r in found]
    assert got["packed"] == got["plain"] == [("u", t, i, k, n) for (t, k, i), n in zip(changes, (1, 0, 1))]
