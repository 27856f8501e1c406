"""Starting the live queries: sources of state on disk, micro-batch writers, checkpoints."""

import json

from pyspark.sql import functions as F

from towerlens.operators import flow, persona
from towerlens.sinks import tables as sink
from towerlens.sinks.keyed import KeyedTable
from towerlens.sources import lines
from towerlens.streaming import live, running, visits

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

TOTAL_SCHEMA = "region_id string, stay_count long, ts timestamp"


def use_rocksdb(spark):
    """Keep operator state in RocksDB, with checkpoints in the query's checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def start_visits(
    stream,
    targets,
    threshold_ms,
    out,
    checkpoint,
    event_time=True,
    ttl_ms=None,
    expire_ms=None,
    opened=None,
    **trigger,
):
    """One query, three tables below ``out``: flow events, stay events, stay totals.

    ``stream`` is a placed stream (see ``live.user_region_flow``), or the output of
    ``start_enrichment`` with a watch list, whose flags then count. ``opened`` holds the visits that
    batch loads left open (``visits.open_visits``). ``trigger`` is passed on, for example ``availableNow=True`` or ``processingTime='10 seconds'``.
    """
    use_rocksdb(stream.sparkSession)
    events = visits.visit_events(
        live.with_watch_flag(stream, targets), threshold_ms, event_time, ttl_ms, expire_ms, opened
    )

    def write(batch, batch_id):
        # Three writers read the batch; keeping it spares two runs of the stateful step.
        batch = batch.persist()
        try:
            sink.append_batch(
                batch.where(F.col("event_type").isin(flow.LEAVE, flow.ENTER)),
                f"{out}/flow_events",
                batch_id,
            )
            stays = batch.where(F.col("event_type").isin(flow.STAY_BEGAN, flow.STAY_ENDED))
            sink.append_batch(stays, f"{out}/stay_events", batch_id)
            add_to_totals(stays, f"{out}/stay_totals", batch_id)
        finally:
            batch.unpersist()

    return _start(events, write, checkpoint, trigger)


def start_running_stays(stream, targets, threshold_ms, out, checkpoint, expire_ms=None, **trigger):
    """Append a row to the table ``out`` for every change of a region's number of long stays.

    Two stateful steps follow each other in one query: the tracker per subscriber, and a count per
    region of the stays that it gives. Event time only, as the order of changes decides the counts.
    """
    use_rocksdb(stream.sparkSession)
    events = visits.visit_events(
        live.with_watch_flag(stream, targets),
        threshold_ms,
        expire_ms=expire_ms,
        chained=True,
        kinds=(flow.STAY_BEGAN, flow.STAY_ENDED),
    )
    return _start(
        running.running_stays(events),
        lambda batch, batch_id: sink.append_batch(batch, out, batch_id),
        checkpoint,
        trigger,
    )


def add_to_totals(stays, path, batch_id):
    """Add the changes of one micro-batch to the stored stay totals."""
    _totals(stays.sparkSession, path).put(flow.stay_totals(flow.stay_deltas(stays)), batch_id)


def read_totals(spark, path):
    return _totals(spark, path).read()


def _totals(spark, path):
    return KeyedTable(spark, path, TOTAL_SCHEMA, ["region_id"], sums=["stay_count"])


def start_persona(stream, length, out, checkpoint, **trigger):
    """Keep the newest finished window of every region in the table ``out``."""
    use_rocksdb(stream.sparkSession)
    windows = persona.persona_windows(stream, length)

    def write(batch, batch_id):
        table = KeyedTable(batch.sparkSession, out, batch.schema, ["region_id"], "window_start")
        table.put(batch, batch_id)

    return _start(windows, write, checkpoint, trigger)


def start_persona_log(stream, length, out, checkpoint, **trigger):
    """Append every finished window to the table ``out``."""
    use_rocksdb(stream.sparkSession)
    windows = persona.persona_windows(stream, length)
    return _start(
        windows,
        lambda batch, batch_id: sink.append_batch(batch, out, batch_id),
        checkpoint,
        trigger,
    )


def start_enrichment(stream, load_dimensions, out, checkpoint, **trigger):
    """Place signals with dimensions that are read again for every micro-batch.

    ``load_dimensions()`` returns (user_info, cells) or (user_info, cells, targets) and is called
    once per batch, so changed files count from the next batch on. The placed signals are appended
    to ``out``, which the stateful queries then read as a stream of files. With a watch list they
    carry ``watched``, the list's answer when the signal came. A visit keeps the answer of the
    signal that opened it: a region added to the list counts from the next entry on, and visits
    that are open when a region leaves the list still report their stay and their end.
    """

    def write(batch, batch_id):
        user_info, cells, *targets = load_dimensions()
        placed = persona.user_region_flow(batch, user_info, cells)
        if targets:
            placed = live.with_watch_flag(placed, targets[0])
        sink.append_batch(placed, out, batch_id)

    return _start(stream, write, checkpoint, trigger)


def start_parsed(parsed, out, checkpoint, **trigger):
    """Write a stream of parsed lines to two tables below ``out``: ``accepted`` and ``rejected``.

    A bad line is kept as it came, with the micro-batch that brought it, so it can be looked at and
    read again; ``counts`` has one row per micro-batch. A batch that runs again replaces its rows.
    """

    def write(batch, batch_id):
        batch = batch.persist()
        try:
            sink.append_batch(lines.accepted(batch), f"{out}/accepted", batch_id)
            sink.append_batch(lines.rejected(batch), f"{out}/rejected", batch_id)
            sink.append_batch(lines.reject_counts(batch), f"{out}/counts", batch_id)
        finally:
            batch.unpersist()

    return _start(parsed, write, checkpoint, trigger)


def stored_counts(spark, out):
    """(n_ok, n_rejected) per finished micro-batch of ``start_parsed``, and a row of zeros."""
    counts = spark.read.schema("n_ok long, n_rejected long").parquet(f"{out}/counts").drop("batch_id")
    zero = F.lit(0).cast("long")
    return counts.unionByName(spark.range(1).select(zero.alias("n_ok"), zero.alias("n_rejected")))


def read_reject_counts(spark, out):
    """(n_ok, n_rejected) of all finished micro-batches of ``start_parsed``."""
    return stored_counts(spark, out).agg(*[F.sum(n).alias(n) for n in ("n_ok", "n_rejected")])


def late_rows(query):
    """Rows that a query has dropped because they came behind the watermark, as far as its kept
    progress reports reach; ``metrics.StoredTotals`` keeps the count of all of them."""
    return sum(
        state.get("numRowsDroppedByWatermark", 0)
        for report in map(_as_dict, query.recentProgress)
        for state in report.get("stateOperators", [])
    )


def _as_dict(report):
    return report if isinstance(report, dict) else json.loads(report.json)


def start_console(stream, n=10, **trigger):
    writer = stream.writeStream.format("console").option("numRows", n).option("truncate", False)
    return writer.trigger(**trigger).start() if trigger else writer.start()


def _start(stream, write, checkpoint, trigger):
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start() if trigger else writer.start()
