"""The levelled event log: newest events, files opened, files written again, repeated batches."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from tests.helpers import rows_of
from towerlens.sinks.event_log import EventLog

SCHEMA = "imsi string, region_id string, event_ts timestamp, event_type int"
NAMES = ("imsi", "region_id", "event_ts", "event_type")


def drawn(n, day, seed, hot=0.5):
    draw = random.Random(seed)
    start = dt.datetime(2024, 1, day)
    return [
        (f"u{seed}-{i}", "R0" if draw.random() < hot else f"R{draw.randrange(1, 9)}",
         start + dt.timedelta(seconds=draw.randrange(80_000)), i % 2)
        for i in range(n)
    ]


def newest(rows, region, n):
    found = sorted((r for r in rows if r[1] == region), key=lambda r: r[0])
    return sorted(found, key=lambda r: r[2], reverse=True)[:n]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_batches_merges_and_repeats(spark, tmp_path):
    log, rows = EventLog(spark, str(tmp_path), fanout=3), []
    for n in range(7):
        part = drawn(60, 1 + n % 2, n)
        rows += part
        for _ in range(1 + (n in (2, 5))):
            log.append(spark.createDataFrame(part, SCHEMA), n)
        log.append(spark.createDataFrame(drawn(60, 1, 0), SCHEMA), 0)  # a late repeat
    assert rows_of(log.read(), *NAMES) == sorted(rows, key=repr)
    for region in ("R0", "R3", "none"):
        got = [tuple(r[c] for c in NAMES) for r in log.newest(region, 20, "imsi").collect()]
        assert got == newest(rows, region, 20)
    log.clean()
    assert rows_of(log.read(), *NAMES) == sorted(rows, key=repr)


def test_an_old_day_is_not_written_again(spark, tmp_path):
    log = EventLog(spark, str(tmp_path), fanout=3)
    for n in range(4):
        log.append(spark.createDataFrame(drawn(40, 1, n), SCHEMA), n)
    before = files(tmp_path)
    for n in range(4, 11):
        log.append(spark.createDataFrame(drawn(40, 2, n), SCHEMA), n)
    after = files(tmp_path)
    assert before.items() <= after.items()
    assert not [f for f in after.keys() - before.keys() if "_day=20240101" in f]


def test_newest_opens_what_the_manifest_allows(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log, rows = EventLog(spark, str(tmp_path), fanout=4), []
        for n in range(6):
            part = drawn(400, 1 + n // 3, n, hot=0.8)
            rows += part
            log.append(spark.createDataFrame(part, SCHEMA), n)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    every = log._day(log._state()["days"]["20240102"])
    mine = [f for r in every for f in r["files"] if f["low"] <= "R0" <= f["high"]]
    assert len(mine) >= 12, "one region fills many files"
    got = log.newest("R0", 50, "imsi")
    assert [tuple(r[c] for c in NAMES) for r in got.collect()] == newest(rows, "R0", 50)
    last = newest(rows, "R0", 50)[-1][2].replace(tzinfo=dt.timezone.utc).timestamp() * 1e6
    allowed = {f["path"] for f in mine if f["newest"] >= last}
    opened = {f.partition(str(tmp_path) + "/")[2] for f in got.inputFiles()}
    assert opened == allowed and len(allowed) < len(mine)


def test_a_reader_keeps_its_state(spark, tmp_path):
    log = EventLog(spark, str(tmp_path), fanout=2)
    log.append(spark.createDataFrame(drawn(30, 1, 1), SCHEMA), 0)
    reader = log.read()
    for n in range(1, 4):
        log.append(spark.createDataFrame(drawn(30, 1, n + 1), SCHEMA), n)
    assert reader.count() == 30 and log.read().count() == 120
    log.append(spark.createDataFrame([], SCHEMA), 4)
    assert log.read().count() == 120
    assert log.read().where(F.col("event_ts").isNull()).count() == 0
