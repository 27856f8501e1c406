"""Visits, events and long stays: hand-written cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import at, brute_changes, brute_events, flow_frame
from towerlens.operators import flow, skew
from towerlens.operators.latest import cell_map

THRESHOLD = 30
TARGETS = ("A", "B")


def events_of(spark, rows, horizon, heavy=None, slice_ms=60_000):
    frame = flow_frame(spark, rows)
    targets = spark.createDataFrame([(t,) for t in TARGETS], "region_id string")
    changes = flow.region_changes(frame, heavy, slice_ms)
    stays = flow.stay_events(
        flow.visits(changes, targets), THRESHOLD * 1000, F.lit(at(horizon)).cast("timestamp")
    )
    both = flow.flow_events(changes, targets).unionByName(stays)
    return sorted(
        (r.imsi, r.event_type, r.region_id, (r.event_ts - at(0)).total_seconds())
        for r in both.collect()
    )


CASES = {
    "first sighting": ([("u", "A", 0)], 10, [("u", 1, "A", 0)]),
    "repeat in the same region": ([("u", "A", 0), ("u", "A", 5)], 10, [("u", 1, "A", 0)]),
    "both watched": (
        [("u", "A", 0), ("u", "B", 10)],
        20,
        [("u", 0, "A", 10), ("u", 1, "A", 0), ("u", 1, "B", 10)],
    ),
    "through an unwatched region": (
        [("u", "A", 0), ("u", "X", 10), ("u", "A", 20)],
        25,
        [("u", 0, "A", 10), ("u", 1, "A", 0), ("u", 1, "A", 20)],
    ),
    "left before the threshold": (
        [("u", "A", 0), ("u", "X", 29)],
        100,
        [("u", 0, "A", 29), ("u", 1, "A", 0)],
    ),
    "left exactly at the threshold": (
        [("u", "A", 0), ("u", "X", 30)],
        100,
        [("u", 0, "A", 30), ("u", 1, "A", 0), ("u", 2, "A", 30), ("u", 3, "A", 30)],
    ),
    "left after the threshold": (
        [("u", "A", 0), ("u", "X", 50)],
        100,
        [("u", 0, "A", 50), ("u", 1, "A", 0), ("u", 2, "A", 30), ("u", 3, "A", 50)],
    ),
    "back before the threshold": (
        [("u", "A", 0), ("u", "X", 20), ("u", "A", 25), ("u", "X", 40)],
        100,
        [("u", 0, "A", 20), ("u", 0, "A", 40), ("u", 1, "A", 0), ("u", 1, "A", 25)],
    ),
    "still open at the horizon": ([("u", "A", 0)], 30, [("u", 1, "A", 0), ("u", 2, "A", 30)]),
    "open and too short": ([("u", "A", 0)], 29, [("u", 1, "A", 0)]),
    "two signals at one instant": (
        [("u", "A", 0), ("u", "B", 0)],
        5,
        [("u", 0, "A", 0), ("u", 1, "A", 0), ("u", 1, "B", 0)],
    ),
    "no signals": ([], 5, []),
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    rows, horizon, wanted = CASES[name]
    assert events_of(spark, rows, horizon) == wanted
    assert brute_events(rows, TARGETS, THRESHOLD, horizon) == wanted


def random_rows(seed, users=40, n=1500, span=600):
    """Random signals; user 'hot' has a third of them."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        user = "hot" if rng.random() < 0.34 else f"u{rng.randrange(users)}"
        rows.append((user, rng.choice("AABX"), rng.randrange(span * 10) / 10))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = random_rows(seed)
    wanted = brute_events(rows, TARGETS, THRESHOLD, 600)
    assert events_of(spark, rows, 600) == wanted


@pytest.mark.parametrize("slice_ms", [1_000, 7_000, 10_000_000])
def test_heavy_subscribers_are_sliced(spark, slice_ms):
    rows = random_rows(3)
    heavy = skew.heavy_keys(flow_frame(spark, rows), "imsi", floor=100)
    assert [r.imsi for r in heavy.collect()] == ["hot"]
    wanted = brute_events(rows, TARGETS, THRESHOLD, 600)
    assert events_of(spark, rows, 600, heavy, slice_ms) == wanted


def test_changes_carry_previous_and_exit(spark):
    rows = random_rows(4)
    heavy = skew.heavy_keys(flow_frame(spark, rows), "imsi", floor=100)
    wanted = sorted(brute_changes(rows), key=repr)
    for listed in (None, heavy):
        got = flow.region_changes(flow_frame(spark, rows), listed, 5_000).collect()
        second = lambda ts: None if ts is None else (ts - at(0)).total_seconds()
        assert (
            sorted(
                (
                    (r.imsi, r.prev_region, r.region_id, second(r.event_ts), second(r.exit_ts))
                    for r in got
                ),
                key=repr,
            )
            == sorted(((i, b, r, float(s), e) for i, b, r, s, e in wanted), key=repr)
        )


def test_running_total_is_the_plain_sum_and_never_negative(spark):
    rows = random_rows(5)
    stays = [e for e in brute_events(rows, TARGETS, THRESHOLD, 600) if e[1] in (2, 3)]
    frame = spark.createDataFrame(
        [(i, t, r, at(s)) for i, t, r, s in stays],
        "imsi string, event_type int, region_id string, event_ts timestamp",
    )
    for slice_ms in (500, 60_000, 10**9):
        got = {
            (r.region_id, r.event_ts, r.event_type, r.imsi): r.stay_count
            for r in flow.running_stays(flow.stay_deltas(frame), slice_ms).collect()
        }
        count = dict.fromkeys(TARGETS, 0)
        for imsi, kind, region, second in sorted(stays, key=lambda e: (e[3], e[1], e[0])):
            count[region] += 1 if kind == 2 else -1
            assert got[(region, at(second), kind, imsi)] == count[region] >= 0


def test_every_ended_stay_began(spark):
    rows = random_rows(6)
    events = events_of(spark, rows, 600)
    began = [(i, r) for i, t, r, _ in events if t == 2]
    for ended in [(i, r) for i, t, r, _ in events if t == 3]:
        began.remove(ended)


def test_cell_of_two_regions_keeps_the_last(spark):
    cells = spark.createDataFrame(
        [("R1", "c", 1), ("R2", "c", 2), ("R3", "d", 3)],
        "region_id string, laccell string, line_no long",
    )
    assert sorted(map(tuple, cell_map(cells, "line_no").collect())) == [("c", "R2"), ("d", "R3")]
