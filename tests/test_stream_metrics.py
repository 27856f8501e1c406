"""Rejected lines and late rows of streams, over more micro-batches than Spark keeps reports of."""

import time


from tests.conftest import DATA
from tests.helpers import rows_of
from tests.test_streaming import dims, stream_of
from towerlens.plans import inputs
from towerlens.sources import lines, streams
from towerlens.streaming import live, metrics, writers

SF = f"{DATA}/sf0.001"


def settled(spark, path, name, want):
    """Listeners are told behind the query; wait until the total is there."""
    for _ in range(100):
        if metrics.totals(spark, path).get(name) == want:
            break
        time.sleep(0.1)
    return metrics.totals(spark, path)


def test_counts_of_150_micro_batches(spark, tmp_path):
    spark.sparkContext.setLogLevel("ERROR")
    texts = inputs.signal_lines(spark, SF).select("line")
    texts.repartition(150).write.text(str(tmp_path / "in"))
    want = lines.reject_counts(lines.parse_signal(texts)).first()
    listener = metrics.StoredTotals(spark, str(tmp_path / "totals"))
    spark.streams.addListener(listener)
    try:
        parsed = lines.parse_signal(streams.file_lines(spark, str(tmp_path / "in"), files_per_trigger=1))
        good = metrics.accepted(parsed, "signal").writeStream.format("noop")
        query = good.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        found = settled(spark, str(tmp_path / "totals"), "signal.n_ok", want.n_ok)
    finally:
        spark.streams.removeListener(listener)
    assert len(query.recentProgress) < 150
    assert (found["signal.n_ok"], found["signal.n_rejected"]) == (want.n_ok, want.n_rejected)


def test_rejected_lines_are_kept(spark, tmp_path):
    texts = inputs.signal_lines(spark, SF).select("line")
    texts.repartition(3).write.text(str(tmp_path / "in"))
    for _ in range(2):
        parsed = lines.parse_signal(streams.file_lines(spark, str(tmp_path / "in"), files_per_trigger=1))
        writers.start_parsed(parsed, str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True).awaitTermination()
    want = lines.reject_counts(lines.parse_signal(texts)).first()
    got = writers.read_reject_counts(spark, str(tmp_path / "out")).first()
    assert (got.n_ok, got.n_rejected) == (want.n_ok, want.n_rejected)
    bad = spark.read.parquet(str(tmp_path / "out" / "rejected"))
    assert rows_of(bad, "line") == rows_of(lines.rejected(lines.parse_signal(texts)), "line")


def report(batch, late=0, ran=True, query="q", **observed):
    return {
        "id": query, "batchId": batch, "durationMs": {"addBatch": 5} if ran else {"triggerExecution": 1},
        "observedMetrics": {"signal": observed} if observed else {}, "stateOperators": [{"numRowsDroppedByWatermark": late}],
    }


def test_reports_add_up_once_and_over_restarts(spark, tmp_path):
    path = str(tmp_path)
    first = metrics.StoredTotals(spark, path)
    for n in range(9):
        first.take(report(n, late=1, n_ok=10, n_rejected=1))
        first.take(report(n, late=1, n_ok=10, n_rejected=1))
        first.take(report(n + 1, late=99, ran=False, n_ok=0))
    again = metrics.StoredTotals(spark, path, "q")
    again.take(report(8, late=5))
    again.take(report(9, late=2))
    again.take(report(0, late=50, query="other"))
    assert metrics.totals(spark, path) == {"late_rows": 11, "signal.n_ok": 90, "signal.n_rejected": 9}
    assert len(list((tmp_path / "q").glob("*.json"))) == 3
    assert metrics.totals(spark, f"{path}/none") == {}


def test_late_rows_of_two_starts_are_kept(spark, tmp_path):
    src, out, path = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "totals")
    signal = inputs.signal(spark, SF)
    user_info, cells = dims(spark)
    listener = metrics.StoredTotals(spark, path)
    spark.streams.addListener(listener)
    seen = 0
    try:
        for cond in ("event_id >= 500", "event_id < 20", "event_id BETWEEN 20 AND 60"):
            signal.where(cond).coalesce(1).write.mode("append").parquet(src)
            placed = live.user_region_flow(stream_of(spark, src), user_info, cells, "1 hour")
            query = writers.start_persona_log(placed, "1 hour", out, str(tmp_path / "c"), availableNow=True)
            query.awaitTermination()
            seen += writers.late_rows(query)
        found = settled(spark, path, metrics.LATE, seen)
    finally:
        spark.streams.removeListener(listener)
    assert found[metrics.LATE] == seen > 0
