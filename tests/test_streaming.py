"""The stream forms against their batch twins, over several ways to cut the input."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.helpers import rows_of
from towerlens.operators import flow, latest, persona
from towerlens.plans import catalog, inputs
from towerlens.sinks import tables as sink
from towerlens.sources import streams
from towerlens.streaming import live, writers

SF = f"{DATA}/sf0.001"
EVENT = ("imsi", "event_type", "region_id", "gender", "age", "event_ts")
# A signal far in the future moves the watermark past all real signals.
END_ID = 999_999
END_TS = dt.datetime(2024, 3, 1)
DELAY_HOURS = 2


def dims(spark):
    return inputs.user_info(spark, SF), latest.cell_map(inputs.region_cell(spark, SF), "line_no")


def write_steps(spark, folder, cuts, first=0):
    """Write the signals as one file per step, cut at the given event ids."""
    signal = inputs.signal(spark, SF)
    bounds = [0, *cuts, 10**9]
    for step in range(first, len(bounds) - 1):
        part = signal.where((F.col("event_id") >= bounds[step]) & (F.col("event_id") < bounds[step + 1]))
        part.coalesce(1).write.mode("append").parquet(folder)


def write_end(spark, folder):
    known = dims(spark)[0].first().imsi
    spark.range(1).select(
        F.lit(END_ID).cast("bigint").alias("event_id"),
        F.lit(known).alias("imsi"),
        F.lit("C1").alias("laccell"),
        F.lit(0).cast("bigint").alias("start_ms"),
        F.lit(END_TS).cast("timestamp").alias("event_ts"),
    ).write.mode("append").parquet(folder)


def stream_of(spark, folder):
    schema = inputs.signal(spark, SF).schema
    return streams.file_table(spark, folder, schema, files_per_trigger=1)


def batch_twin(spark):
    """The batch answer with the horizon that the end signal gives to the stream."""
    user_info, cells = dims(spark)
    changes = flow.region_changes(
        persona.user_region_flow(inputs.signal(spark, SF), user_info, cells)
    )
    targets = inputs.target_region(spark, SF)
    horizon = F.lit(END_TS - dt.timedelta(hours=DELAY_HOURS)).cast("timestamp")
    flows = flow.flow_events(changes, targets)
    stays = flow.stay_events(flow.visits(changes, targets), catalog.STAY_MS, horizon)
    return flows, stays


def run_visits(spark, src, out):
    user_info, cells = dims(spark)
    placed = live.user_region_flow(
        stream_of(spark, src), user_info, cells, f"{DELAY_HOURS} hours"
    )
    writers.start_visits(
        placed,
        inputs.target_region(spark, SF),
        catalog.STAY_MS,
        f"{out}/tables",
        f"{out}/checkpoint",
        availableNow=True,
    ).awaitTermination()


def check_visits(spark, out):
    flows, stays = batch_twin(spark)
    got_flows = spark.read.parquet(f"{out}/tables/flow_events")
    got_stays = spark.read.parquet(f"{out}/tables/stay_events")
    assert rows_of(got_flows, *EVENT) == rows_of(flows, *EVENT)
    assert rows_of(got_stays, *EVENT) == rows_of(stays, *EVENT)
    totals = flow.stay_totals(flow.stay_deltas(stays))
    got = writers.read_totals(spark, f"{out}/tables/stay_totals")
    names = ("region_id", "stay_count", "ts")
    assert rows_of(got, *names) == rows_of(totals, *names)


@pytest.mark.parametrize("cuts", [(), (500,), (120, 121, 640, 900)])
def test_visits_equal_batch(spark, tmp_path, cuts):
    src = str(tmp_path / "src")
    write_steps(spark, src, cuts)
    write_end(spark, src)
    run_visits(spark, src, str(tmp_path))
    check_visits(spark, str(tmp_path))


def test_visits_continue_after_restart(spark, tmp_path):
    src = str(tmp_path / "src")
    signal = inputs.signal(spark, SF)
    signal.where("event_id < 400").coalesce(1).write.mode("append").parquet(src)
    run_visits(spark, src, str(tmp_path))
    signal.where("event_id >= 400").coalesce(1).write.mode("append").parquet(src)
    write_end(spark, src)
    run_visits(spark, src, str(tmp_path))
    check_visits(spark, str(tmp_path))


# ---- live persona ------------------------------------------------------------------------------

COUNTERS = (
    "region_id", "window_start", "man", "women", "age_10_20", "age_20_40", "age_40", "pep_cnt",
)


def test_persona_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    write_steps(spark, src, (300, 700))
    write_end(spark, src)
    user_info, cells = dims(spark)
    placed = live.user_region_flow(
        stream_of(spark, src), user_info, cells, f"{DELAY_HOURS} hours"
    )
    out = str(tmp_path / "region_person")
    writers.start_persona(
        placed, "1 hour", out, str(tmp_path / "checkpoint"), availableNow=True
    ).awaitTermination()
    windows = persona.persona_windows(
        persona.user_region_flow(inputs.signal(spark, SF), user_info, cells), "1 hour"
    )
    wanted = latest.last_per_key(windows, ["region_id"], "window_start")
    got = sink.read_current(spark, out, windows.schema)
    assert rows_of(got, *COUNTERS) == rows_of(wanted, *COUNTERS)


# ---- text source, dimension refresh, processing time -------------------------------------------


def test_text_lines_become_signals(spark, tmp_path):
    src = tmp_path / "lines"
    src.mkdir()
    (src / "a.txt").write_text(
        "u1|c1|23.1|113.1|1704067200123\nbad line\nu2|c2|23.1|113.1|1704067201000\n"
    )
    query = (
        live.signals(streams.file_lines(spark, str(src)))
        .writeStream.format("memory")
        .queryName("parsed_signals")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert rows_of(spark.table("parsed_signals"), "imsi", "laccell", "event_ts") == [
        ("u1", "c1", dt.datetime(2024, 1, 1, 0, 0, 0, 123000)),
        ("u2", "c2", dt.datetime(2024, 1, 1, 0, 0, 1)),
    ]


def test_dimensions_are_read_again_for_each_batch(spark, tmp_path):
    schema = inputs.signal(spark, SF).schema
    src, out = str(tmp_path / "src"), str(tmp_path / "placed")
    users, cells = str(tmp_path / "users"), str(tmp_path / "cells")

    def signal(number, imsi):
        spark.createDataFrame(
            [(number, imsi, "c1", 0, dt.datetime(2024, 1, 1))], schema
        ).write.mode("append").parquet(src)

    def load():
        return (
            spark.read.schema("imsi string, gender string, age int").csv(users, sep="|"),
            spark.read.schema("laccell string, region_id string").csv(cells, sep="|"),
        )

    def run():
        writers.start_enrichment(
            stream_of(spark, src), load, out, str(tmp_path / "checkpoint"), availableNow=True
        ).awaitTermination()

    (tmp_path / "users").mkdir()
    (tmp_path / "cells").mkdir()
    (tmp_path / "users" / "1.txt").write_text("u1|1|30\n")
    (tmp_path / "cells" / "1.txt").write_text("c1|R1\n")
    signal(1, "u1")
    signal(2, "u2")
    run()
    assert rows_of(spark.read.parquet(out), "event_id") == [(1,)]
    (tmp_path / "users" / "2.txt").write_text("u2|0|40\n")
    (tmp_path / "cells" / "1.txt").write_text("c1|R9\n")
    signal(3, "u2")
    run()
    assert rows_of(spark.read.parquet(out), "event_id", "region_id", "gender") == [
        (1, "R1", "1"),
        (3, "R9", "0"),
    ]


def test_watch_list_is_read_again_for_each_batch(spark, tmp_path):
    schema = inputs.signal(spark, SF).schema
    src, placed = str(tmp_path / "src"), str(tmp_path / "placed")
    users = spark.createDataFrame([("u1", "1", 30), ("u2", "0", 40)], "imsi string, gender string, age int")
    cells = spark.createDataFrame([("c1", "R1"), ("c2", "R2")], "laccell string, region_id string")
    listed = ["R1"]

    def signals(first, rows):
        made = [(first + n, u, c, 0, dt.datetime(2024, 1, 1, 0, m)) for n, (u, c, m) in enumerate(rows)]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(src)

    def load():
        return users, cells, spark.createDataFrame([(r,) for r in listed], "region_id string")

    def run():
        writers.start_enrichment(
            stream_of(spark, src), load, placed, str(tmp_path / "c1"), availableNow=True
        ).awaitTermination()
        kept = spark.read.parquet(placed).drop("batch_id").schema
        flow_stream = streams.file_table(spark, f"{placed}/batch_id=*", kept).withWatermark("event_ts", "0 seconds")
        writers.start_visits(
            flow_stream, None, 3_600_000, str(tmp_path / "out"), str(tmp_path / "c2"), availableNow=True
        ).awaitTermination()

    signals(1, [("u1", "c1", 0), ("u1", "c2", 1), ("u2", "c1", 2), ("u2", "c1", 3)])
    run()
    listed[:] = ["R2"]
    # u2 leaves R1, whose visit began while R1 was listed; u1 leaves R2, entered before R2 was listed.
    signals(10, [("u2", "c2", 4), ("u1", "c1", 5), ("u1", "c2", 6), ("u1", "c2", 59)])
    run()
    signals(20, [("u1", "c2", 59)])
    run()
    got = spark.read.parquet(str(tmp_path / "out" / "flow_events"))
    found = sorted((r.imsi, r.event_type, r.region_id, r.event_ts.minute) for r in got.collect())
    assert found == [
        ("u1", 0, "R1", 1), ("u1", 1, "R1", 0), ("u1", 1, "R2", 6),
        ("u2", 0, "R1", 4), ("u2", 1, "R1", 2), ("u2", 1, "R2", 4),
    ]


def test_processing_time_visits_with_state_ttl(spark, tmp_path):
    """With no threshold every entry is a long stay at once, whatever the clock says."""
    src, out = str(tmp_path / "src"), str(tmp_path)
    write_steps(spark, src, ())
    user_info, cells = dims(spark)
    placed = persona.user_region_flow(stream_of(spark, src), user_info, cells)
    targets = inputs.target_region(spark, SF)
    query = writers.start_visits(
        placed,
        targets,
        0,
        f"{out}/tables",
        f"{out}/checkpoint",
        event_time=False,
        ttl_ms=86_400_000,
        processingTime="1 second",
    )
    # Timers of the clock keep such a query running, so it is stopped once the file is through.
    deadline = time.monotonic() + 90
    while time.monotonic() < deadline and query.isActive:
        if any(p["numInputRows"] for p in query.recentProgress):
            break
        time.sleep(0.5)
    query.stop()
    flows, _ = batch_twin(spark)
    got = spark.read.parquet(f"{out}/tables/flow_events")
    assert rows_of(got, *EVENT) == rows_of(flows, *EVENT)
    stays = spark.read.parquet(f"{out}/tables/stay_events")
    assert stays.where("event_type = 2").count() == flows.where("event_type = 1").count()
    assert stays.where("event_type = 3").count() == flows.where("event_type = 0").count()


def test_processing_time_stamp(spark, tmp_path):
    src = str(tmp_path / "src")
    write_steps(spark, src, ())
    user_info, cells = dims(spark)
    stamped = live.stamped_now(stream_of(spark, src))
    windows = persona.persona_windows(
        persona.user_region_flow(stamped, user_info, cells), "60 seconds"
    )
    query = (
        windows.writeStream.format("memory")
        .queryName("stamped_windows")
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    wanted = persona.user_region_flow(inputs.signal(spark, SF), user_info, cells).count()
    assert spark.table("stamped_windows").agg(F.sum("pep_cnt")).first()[0] == wanted


def test_newest_batch_counts_not_the_newest_time(spark, tmp_path):
    path = str(tmp_path / "totals")
    schema = "imsi string, event_type int, region_id string, event_ts timestamp"
    when = dt.datetime(2024, 1, 1)
    steps = [[("u", 2, "A", when), ("v", 2, "A", when)], [("u", 3, "A", when - dt.timedelta(hours=1))], [("v", 3, "A", when - dt.timedelta(hours=2))]]
    for n, rows in enumerate(steps):
        writers.add_to_totals(spark.createDataFrame(rows, schema), path, n)
        assert rows_of(writers.read_totals(spark, path), "stay_count") == [(2 - n,)]


def test_stamped_signals_keep_the_order_of_the_feed(spark):
    lines = spark.createDataFrame(
        [(f"u|{c}|23.1|113.2|{1_700_000_000_000 + i}",) for i, c in enumerate("ABAC")], "line string"
    )
    rows = live.stamped_now(live.signals(lines)).orderBy("event_id").collect()
    assert [r.laccell for r in rows] == list("ABAC")
    with_offset = lines.withColumn("offset", F.lit(7).cast("long"))
    assert {r.event_id for r in live.signals(with_offset).collect()} == {7}


def test_late_rows_are_counted(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    signal = inputs.signal(spark, SF)
    user_info, cells = dims(spark)

    def run():
        placed = live.user_region_flow(stream_of(spark, src), user_info, cells, "1 hour")
        query = writers.start_persona_log(placed, "1 hour", out, str(tmp_path / "c"), availableNow=True)
        query.awaitTermination()
        return writers.late_rows(query)

    signal.where("event_id >= 500").coalesce(1).write.mode("append").parquet(src)
    assert run() == 0
    signal.where("event_id < 20").coalesce(1).write.mode("append").parquet(src)
    assert run() > 0


def test_batch_run_again_leaves_totals_unchanged(spark, tmp_path):
    path = str(tmp_path / "totals")
    schema = "imsi string, event_type int, region_id string, event_ts timestamp"
    when = dt.datetime(2024, 1, 1)
    one = spark.createDataFrame([("u", 2, "A", when), ("v", 2, "A", when)], schema)
    two = spark.createDataFrame([("u", 3, "A", when + dt.timedelta(hours=1))], schema)
    writers.add_to_totals(one, path, 0)
    for _ in range(2):
        writers.add_to_totals(two, path, 1)
        got = writers.read_totals(spark, path)
        assert rows_of(got, "region_id", "stay_count") == [("A", 1)]
    assert got.first().ts == when + dt.timedelta(hours=1)
