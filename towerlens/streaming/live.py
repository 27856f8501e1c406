"""From a stream of signals to the streams the live operators consume."""

from pyspark.sql import functions as F

from towerlens.operators import persona
from towerlens.sources import lines


def signals(raw, line="line"):
    """Parsed signals of a line stream; bad lines are dropped.

    ``event_id`` orders signals of one instant. Lines of Kafka bring an offset, which orders the
    signals of a topic partition as they arrived; for other lines a hash of the line serves, which
    gives the same order in every run.
    """
    good = lines.accepted(lines.parse_signal(raw, line))
    return good.select(
        (F.col("offset") if "offset" in raw.columns else F.xxhash64(line)).alias("event_id"),
        "imsi",
        "laccell",
        "start_ms",
        F.timestamp_millis("start_ms").alias("event_ts"),
    )


def stamped_now(stream):
    """Processing-time reading: the time of arrival takes the place of the event time.

    All signals of a micro-batch then share one time, so the order behind it has to be that of
    the feed: ``event_id`` becomes the time in the signal, with 20 bits of the old id for ties.
    """
    low = F.col("event_id").bitwiseAND(F.lit((1 << 20) - 1))
    order = F.shiftleft("start_ms", 20).bitwiseOR(low)
    return stream.withColumns({"event_ts": F.current_timestamp(), "event_id": order})


def user_region_flow(stream, user_info, cells, delay):
    """Signals with region, gender and age, and a watermark ``delay`` behind the newest signal."""
    return persona.user_region_flow(
        stream.withWatermark("event_ts", delay), user_info, cells
    )


def with_watch_flag(flow, targets):
    """Add ``watched``: is the region on the watch list? Without a list every region is, unless
    the flow brings the flag along."""
    if targets is None and "watched" in flow.columns:
        return flow
    if targets is None:
        return flow.withColumn("watched", F.lit(True))
    listed = targets.select("region_id").distinct().withColumn("_listed", F.lit(True))
    return (
        flow.join(listed, "region_id", "left")
        .withColumn("watched", F.coalesce("_listed", F.lit(False)))
        .drop("_listed")
    )
