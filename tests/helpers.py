"""Small frames and brute-force answers for the tests."""

import datetime as dt

from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)
START_US = 1_704_067_200_000_000

FLOW = "imsi string, region_id string, gender string, age int, event_id long, event_us long"


def us(second):
    return START_US + round(second * 1_000_000)


def at(second):
    return START + dt.timedelta(seconds=second)


def flow_frame(spark, rows):
    """Rows (imsi, region, second) as a placed flow; the event id is the row number."""
    data = [(i, r, "1", 30, n, us(s)) for n, (i, r, s) in enumerate(rows)]
    return (
        spark.createDataFrame(data, FLOW)
        .withColumn("event_ts", F.timestamp_micros("event_us"))
        .drop("event_us")
    )


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


def brute_changes(rows):
    """Per subscriber: (imsi, previous region, region, entry second, exit second or None)."""
    per_user = {}
    for number, (imsi, region, second) in enumerate(rows):
        per_user.setdefault(imsi, []).append((second, number, region))
    found = []
    for imsi, seen in per_user.items():
        visits = []
        for second, _, region in sorted(seen):
            if not visits or visits[-1][0] != region:
                visits.append((region, second))
        for n, (region, second) in enumerate(visits):
            before = visits[n - 1][0] if n else None
            after = visits[n + 1][1] if n + 1 < len(visits) else None
            found.append((imsi, before, region, second, after))
    return found


def brute_events(rows, targets, threshold, horizon):
    """All events (imsi, type, region, second) of rows (imsi, region, second)."""
    events = []
    for imsi, before, region, enter, leave in brute_changes(rows):
        if before in targets:
            events.append((imsi, 0, before, enter))
        if region in targets:
            events.append((imsi, 1, region, enter))
            end = horizon if leave is None else leave
            if enter + threshold <= end:
                events.append((imsi, 2, region, enter + threshold))
                if leave is not None:
                    events.append((imsi, 3, region, leave))
    return sorted(events)
