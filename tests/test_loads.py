"""Visits between loads, streams that go on from loads, and running counts per change."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.helpers import START_US, at, brute_events, flow_frame, rows_of
from tests.test_flow import TARGETS, THRESHOLD, random_rows
from tests.test_streaming import batch_twin, dims, stream_of, write_end, write_steps
from tests.test_tracker import Clock
from tests.test_tracker_slices import MapHandle, fire
from towerlens.operators import flow, persona
from towerlens.plans import batch, catalog, inputs
from towerlens.streaming import live, running, visits, writers


@pytest.mark.parametrize("borders, again", [([200, 380], 1), ([0, 50, 50.5, 590], 3), ([], 0)])
def test_loads_give_what_one_run_gives(spark, tmp_path, borders, again):
    rows = [r for r in random_rows(4, n=600)] + [("still", "A", 1.0), ("gone", "X", 2.0)]
    # The last load ends at the newest signal, as its horizon says.
    newest = max(s for *_, s in rows)
    frame = flow_frame(spark, rows)
    targets = spark.createDataFrame([(t,) for t in TARGETS], "region_id string")
    ends = [-1, *borders, 10_000]
    for n in range(len(ends) - 1):
        low, high = (F.lit(at(e)).cast("timestamp") for e in ends[n : n + 2])
        part = frame.where((F.col("event_ts") > low) & (F.col("event_ts") <= high))
        for _ in range(1 + (n == again)):
            batch.build_visits(part, str(tmp_path), n, n - 1 if n else None, THRESHOLD * 1000, targets)
    found = []
    for kind in ("flow", "stay"):
        found += spark.read.parquet(f"{tmp_path}/{kind}_events").collect()
    got = sorted((r.imsi, r.event_type, r.region_id, (r.event_ts - at(0)).total_seconds()) for r in found)
    assert got == brute_events(rows, TARGETS, THRESHOLD, newest)


def test_empty_load_changes_nothing(spark, tmp_path):
    targets = spark.createDataFrame([(t,) for t in TARGETS], "region_id string")
    frame = flow_frame(spark, [("u", "A", 0), ("u", "B", 40)])
    batch.build_visits(frame, str(tmp_path), "a", None, THRESHOLD * 1000, targets)
    batch.build_visits(frame.limit(0), str(tmp_path), "b", "a", THRESHOLD * 1000, targets)
    names = ("imsi", "region_id", "event_ts", "reported")
    assert rows_of(batch.read_carried(spark, tmp_path, "b"), *names) == rows_of(batch.read_carried(spark, tmp_path, "a"), *names)
    assert spark.read.parquet(f"{tmp_path}/flow_events/load=b").count() == 0


def placed(spark, src, since=None):
    user_info, cells = dims(spark)
    stream = stream_of(spark, src)
    if since is not None:
        stream = stream.where(F.col("event_id") >= since)
    return live.user_region_flow(stream, user_info, cells, "2 hours")


@pytest.mark.parametrize("cuts", [(), (120, 640, 900)])
def test_running_stays_equal_batch_for_every_cut(spark, tmp_path, cuts):
    src = str(tmp_path / "src")
    write_steps(spark, src, cuts)
    write_end(spark, src)
    writers.start_running_stays(
        placed(spark, src), inputs.target_region(spark, f"{DATA}/sf0.001"), catalog.STAY_MS,
        str(tmp_path / "out"), str(tmp_path / "checkpoint"), availableNow=True,
    ).awaitTermination()
    _, stays = batch_twin(spark)
    names = ("region_id", "event_ts", "imsi", "event_type", "stay_count")
    want = rows_of(flow.running_stays(flow.stay_deltas(stays)), *names)
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), *names) == want and len(want) > 100


@pytest.mark.parametrize("seed", range(10))
def test_running_count_is_bounded_and_in_order(monkeypatch, seed):
    monkeypatch.setattr(visits, "SLICE", 6)
    draw = random.Random(seed)
    rows = [
        {"event_us": START_US + draw.randrange(40) * 1_000_000, "event_type": draw.choice((2, 3)), "imsi": f"u{i}"}
        for i in range(120)
    ]
    want, count = [], 0
    for r in sorted(rows, key=lambda r: (r["event_us"], r["event_type"], r["imsi"])):
        count += 1 if r["event_type"] == 2 else -1
        want.append((r["event_us"], r["event_type"], r["imsi"], count))
    handle, step = MapHandle(), running.RunningStays()
    step.init(handle)
    got, draw_order = [], sorted(rows, key=lambda r: r["event_us"])
    for part in (draw_order[:50], draw_order[50:]):
        draw.shuffle(part)
        got += list(step.handleInputRows(("A",), iter(part), Clock(0)))
        # The watermark stands just before the newest of what came.
        mark = max(r["event_us"] for r in part) // 1000 - 1000
        fire(handle, step, mark, got)
    fire(handle, step, START_US // 1000 + 100_000, got)
    assert [(r.event_us, r.event_type, r.imsi, r.stay_count) for r in got] == want
    assert not step.pending.held


def test_current_visits_while_the_stream_rests(spark, tmp_path):
    src, targets = str(tmp_path / "src"), inputs.target_region(spark, f"{DATA}/sf0.001")
    write_steps(spark, src, ())
    write_end(spark, src)
    writers.start_visits(
        placed(spark, src), targets, catalog.STAY_MS, str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True
    ).awaitTermination()
    got = visits.current_visits(spark, str(tmp_path / "c"), catalog.STAY_MS)
    user_info, cells = dims(spark)
    changes = flow.region_changes(persona.user_region_flow(inputs.signal(spark, f"{DATA}/sf0.001"), user_info, cells))
    want = flow.visits(changes, targets).where("exit_ts IS NULL")
    names = ("imsi", "region_id", "enter_ts", "gender", "age")
    assert rows_of(got, *names) == rows_of(want, *names)
    # All of these visits are older than the threshold by the end of the stream.
    assert {r.long_stay for r in got.collect()} == {True}
