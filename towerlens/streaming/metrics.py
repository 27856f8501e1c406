"""What a stream has dropped, counted over its whole life and kept with its tables.

Spark reports what a micro-batch observed and how many rows came behind the watermark, but keeps the
newest reports only. ``StoredTotals`` listens to the reports and keeps their sums in a file per
finished micro-batch, of which the newest counts and the last few stay, so nothing is forgotten
however long a stream runs or how often it is started again.
"""

import json

from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from towerlens.sinks.files import Folder
from towerlens.sources import lines

LATE = "late_rows"
_KEPT = 3


def observed_rejects(parsed, name):
    """``parsed`` lines that report how many of a micro-batch were good and bad, as ``name``."""
    return parsed.observe(
        name, F.count_if("is_valid").alias("n_ok"), F.count_if(~F.col("is_valid")).alias("n_rejected")
    )


def accepted(parsed, name):
    """The good lines of a stream, with the bad ones counted in its reports."""
    return lines.accepted(observed_rejects(parsed, name))


class StoredTotals(StreamingQueryListener):
    """Adds the reports of one query up in the folder ``path``.

    Add it to ``spark.streams`` before the query starts; ``query_id`` limits it to one query, which
    a checkpoint keeps over restarts. A report of a batch that is in already adds nothing, nor does
    one of an idle trigger, which names a batch that has not run.
    """

    def __init__(self, spark, path, query_id=None):
        self.folder, self.query_id = Folder(spark, path), query_id

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def onQueryProgress(self, event):
        self.take(json.loads(event.progress.json))

    def take(self, report):
        """Add one report, a dictionary as in Spark's JSON."""
        if self.query_id not in (None, report["id"]) or "addBatch" not in report.get("durationMs", {}):
            return
        state = self._state(report["id"])
        if report["batchId"] <= state["upto"]:
            return
        counts = state["counts"]
        for name, values in (report.get("observedMetrics") or {}).items():
            for key, value in values.items():
                if isinstance(value, int):
                    counts[f"{name}.{key}"] = counts.get(f"{name}.{key}", 0) + value
        late = sum(s.get("numRowsDroppedByWatermark", 0) for s in report.get("stateOperators") or [])
        counts[LATE] = counts.get(LATE, 0) + late
        state = {"upto": report["batchId"], "counts": counts}
        self.folder.write_text(f"{report['id']}/{report['batchId']:012d}.json", json.dumps(state))
        for name in self.folder.names(report["id"])[:-_KEPT]:
            self.folder.remove(f"{report['id']}/{name}")

    def _state(self, query_id):
        names = self.folder.names(query_id)
        if not names:
            return {"upto": -1, "counts": {}}
        return json.loads(self.folder.read_text(f"{query_id}/{names[-1]}"))


def totals(spark, path):
    """{name: count} over all queries that have totals in a folder."""
    folder, out = Folder(spark, path), {}
    for query in folder.names():
        names = folder.names(query)
        if not names or query.startswith("_"):
            continue
        for name, value in json.loads(folder.read_text(f"{query}/{names[-1]}"))["counts"].items():
            out[name] = out.get(name, 0) + value
    return out
