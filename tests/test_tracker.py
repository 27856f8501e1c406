"""The stream's state machine by itself, against brute force over random cuts of the input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import Row

from tests.helpers import START_US, brute_events, us
from towerlens.streaming.visits import VisitTracker

THRESHOLD = 30
TARGETS = ("A", "B")


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Rows:
    def __init__(self):
        self.held = []

    def get(self):
        return iter(self.held)

    def put(self, rows):
        self.held = list(rows)

    def appendList(self, rows):
        self.held += rows

    def clear(self):
        self.held = []


class Handle:
    """State and timers of one key."""

    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema, ttl=None):
        return Value()

    def getListState(self, name, schema):
        return Rows()

    def registerTimer(self, ms):
        self.timers.add(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def rows(signals):
    return iter(
        [
            Row(
                event_us=us(second),
                event_id=number,
                region_id=region,
                watched=region in TARGETS,
                gender="1",
                age=30,
            )
            for number, region, second in signals
        ]
    )


def run(batches, delay, end):
    """Feed batches; after each, the watermark follows the newest signal and timers fire."""
    handle, tracker = Handle(), VisitTracker(THRESHOLD * 1000)
    tracker.init(handle)
    got, newest, watermark = [], 0, 0
    for batch in [*batches, None]:
        if batch is not None:
            got += list(tracker.handleInputRows(("u",), rows(batch), Clock(watermark)))
            newest = max(newest, *(second for _, _, second in batch))
            watermark = max(watermark, START_US // 1000 + (newest - delay) * 1000)
        else:
            watermark = START_US // 1000 + end * 1000
        while any(timer <= watermark for timer in handle.timers):
            timer = min(handle.timers)
            handle.timers.remove(timer)
            got += list(tracker.handleExpiredTimer(("u",), Clock(watermark), None))
    return sorted(
        (imsi, kind, region, (time_us - START_US) / 1e6)
        for imsi, kind, region, _, _, time_us in got
    )


@settings(max_examples=300, deadline=None)
@given(
    signals=st.lists(st.tuples(st.sampled_from("AABX"), st.integers(0, 200)), max_size=25),
    cuts=st.lists(st.integers(0, 25), max_size=6),
)
def test_cutting_the_input_changes_nothing(signals, cuts):
    signals = sorted(signals, key=lambda s: s[1])
    numbered = [(n, region, second) for n, (region, second) in enumerate(signals)]
    bounds = [0, *sorted(cuts), len(numbered)]
    batches = [numbered[a:b] for a, b in zip(bounds, bounds[1:]) if numbered[a:b]]
    wanted = brute_events([("u", r, s) for r, s in signals], TARGETS, THRESHOLD, 500)
    assert run(batches, 0 if not cuts else 5, 500) == wanted


@settings(max_examples=100, deadline=None)
@given(
    signals=st.lists(st.tuples(st.sampled_from("AABX"), st.integers(0, 60)), min_size=1, max_size=20),
    order=st.randoms(),
)
def test_disorder_within_the_delay_changes_nothing(signals, order):
    numbered = [(n, region, second) for n, (region, second) in enumerate(signals)]
    wanted = brute_events([("u", r, s) for r, s in signals], TARGETS, THRESHOLD, 500)
    shuffled = list(numbered)
    order.shuffle(shuffled)
    assert run([[one] for one in shuffled], 100, 500) == wanted


def test_processing_time_reports_when_the_clock_says_so():
    handle, tracker = Handle(), VisitTracker(THRESHOLD * 1000, event_time=False)
    tracker.init(handle)
    start = START_US // 1000
    first = list(tracker.handleInputRows(("u",), rows([(0, "A", 0)]), Clock(start)))
    assert [event[1] for event in first] == [1]
    assert handle.timers == {start + 30_000}
    early = list(tracker.handleExpiredTimer(("u",), Clock(start + 29_999), None))
    assert early == []
    due = list(tracker.handleExpiredTimer(("u",), Clock(start + 30_000), None))
    assert [event[1] for event in due] == [2]
    left = list(
        tracker.handleInputRows(("u",), rows([(1, "X", 40)]), Clock(start + 41_000))
    )
    assert [event[1] for event in left] == [3, 0]


def test_state_of_the_gone_expires_by_timer():
    tracker = VisitTracker(THRESHOLD * 1000, expire_ms=100_000)
    handle = Handle()
    tracker.init(handle)
    row = Row("event_us", "event_id", "region_id", "watched", "gender", "age")
    seen = [row(us(s), n, r, True, "1", 30) for n, (s, r) in enumerate([(0, "A"), (10, "A"), (20, "A")])]
    assert list(tracker.handleInputRows(("u",), iter(seen), Clock(0))) == []
    base = START_US // 1000
    kinds = [e.event_type for e in tracker.handleExpiredTimer(("u",), Clock(base + 60_000), None)]
    assert kinds == [1, 2] and tracker.visit.exists()
    assert base + 120_000 in handle.timers
    assert list(tracker.handleExpiredTimer(("u",), Clock(base + 119_999), None)) == []
    assert tracker.visit.exists()
    assert list(tracker.handleExpiredTimer(("u",), Clock(base + 120_000), None)) == []
    assert not tracker.visit.exists()
    again = [row(us(300), 9, "B", True, "1", 30)]
    list(tracker.handleInputRows(("u",), iter(again), Clock(0)))
    kinds = [e.event_type for e in tracker.handleExpiredTimer(("u",), Clock(base + 301_000), None)]
    assert kinds == [1]
