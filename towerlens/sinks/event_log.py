"""The served event log: sorted runs by day, merged by levels, and found by a manifest.

A micro-batch becomes one run per day it touches. A run is range-partitioned by region and time and
sorted newest first, so one region may fill many files, and each file holds a narrow range. The
manifest of a day names its files with their first and last region and time. When ``FANOUT`` runs
of one level have come together on a day, they are merged into one of the next level, so an event is
written again a few times at most, and a day that gets no more events is never written again.

A state of the whole log is one small file that names the manifest of each day. It is put in place
whole, so readers see a micro-batch or a merge entirely or not at all. A batch that is run again
replaces its run, or does nothing where a merge holds it already. Events need a region and a time.
"""

import json

from pyspark.sql import functions as F

from towerlens.sinks.files import Folder

FANOUT = 8
_STATES, _DAYS = "states", "days"


class EventLog:
    """One log; ``ts`` and ``region`` name its columns of time and region."""

    def __init__(self, spark, path, region="region_id", ts="event_ts", fanout=FANOUT):
        self.spark, self.path, self.folder = spark, path, Folder(spark, path)
        self.region, self.ts, self.fanout = region, ts, fanout

    # ---- writing -------------------------------------------------------------------------------

    def append(self, events, batch_id):
        """Add the events of a micro-batch, and merge runs where enough have come together."""
        state = self._state()
        rows = events.withColumn("_day", F.date_format(self.ts, "yyyyMMdd"))
        files = self._write(rows, f"batch-{batch_id:012d}")
        days = {day: self._day(name) for day, name in state["days"].items() if day in files}
        changed = {}
        for day, found in files.items():
            runs = days.get(day, [])
            if any(r["first"] <= batch_id <= r["last"] and r["level"] for r in runs):
                continue  # a merge holds this batch already
            runs = [r for r in runs if r["first"] != batch_id or r["level"]]
            changed[day] = runs + [{"level": 0, "first": batch_id, "last": batch_id, "files": found}]
        state = self._swap(state, changed)
        merged = self._merged(changed, state["number"] + 1)
        if merged:
            self._swap(state, merged)

    def _write(self, rows, run):
        """Write a run; {day: its files with their ranges}, one row per file to the driver."""
        order = ["_day", self.region, F.desc(self.ts)]
        (
            rows.repartitionByRange(*order).sortWithinPartitions(*order)
            .write.mode("overwrite").partitionBy("_day").parquet(f"{self.path}/runs/{run}")
        )
        if not any(n.startswith("_day=") for n in self.folder.names(f"runs/{run}")):
            return {}
        made = self.spark.read.parquet(f"{self.path}/runs/{run}")
        stats = made.groupBy(
            F.col("_day").cast("string").alias("day"), F.col("_metadata.file_path").alias("path")
        ).agg(
            F.min(self.region).alias("low"), F.max(self.region).alias("high"), F.count("*").alias("rows"),
            F.min(F.unix_micros(self.ts)).alias("oldest"), F.max(F.unix_micros(self.ts)).alias("newest"),
        )
        out = {}
        for row in stats.collect():
            item = row.asDict()
            day = item.pop("day")
            item["path"] = f"runs/{run}/_day={day}/{item['path'].rpartition('/')[2]}"
            out.setdefault(day, []).append(item)
        return out

    def _merged(self, days, number):
        """{day: its runs} of the days with full levels, whose runs are merged, one job per level."""
        runs, out, level = dict(days), {}, 0
        while any(r["level"] >= level for found in runs.values() for r in found):
            full = {day: [r for r in found if r["level"] == level] for day, found in runs.items()}
            full = {day: group for day, group in full.items() if len(group) >= self.fanout}
            if full:
                rows = self._read([f["path"] for group in full.values() for r in group for f in r["files"]])
                rows = rows.withColumn("_day", F.date_format(self.ts, "yyyyMMdd"))
                files = self._write(rows, f"merge-{number:012d}-{level}")
                for day, group in full.items():
                    whole = {
                        "level": level + 1, "files": files[day],
                        "first": min(r["first"] for r in group), "last": max(r["last"] for r in group),
                    }
                    out[day] = runs[day] = [r for r in runs[day] if r["level"] != level] + [whole]
            level += 1
        return out

    def clean(self):
        """Remove runs and manifests that the newest state does not name."""
        names = self.folder.names(_STATES)
        state = self._state()
        used = {f["path"].split("/")[1] for name in state["days"].values() for r in self._day(name) for f in r["files"]}
        for run in self.folder.names("runs"):
            if run not in used:
                self.folder.remove(f"runs/{run}")
        for name in set(self.folder.names(_DAYS)) - set(state["days"].values()):
            self.folder.remove(f"{_DAYS}/{name}")
        for name in names[:-1]:
            self.folder.remove(f"{_STATES}/{name}")

    # ---- reading -------------------------------------------------------------------------------

    def read(self):
        """All events."""
        state = self._state()
        return self._read([f["path"] for name in state["days"].values() for r in self._day(name) for f in r["files"]])

    def newest(self, region, n, *ties):
        """The newest ``n`` events of a region, of one time in the order of ``ties``.

        Days are looked at from the newest on, as far as needed. The newest files give a bound;
        only files that reach up to it, by the manifest, are opened.
        """
        paths = self.newest_files(region, n)
        order = [F.desc(self.ts), *ties]
        if not paths:
            return self.read().limit(0)
        return self._read(paths).where(F.col(self.region) == region).orderBy(*order).limit(n)

    def newest_files(self, region, n):
        """The files that the newest ``n`` events of a region may lie in."""
        state, known = self._state(), []
        for day in sorted(state["days"], reverse=True):
            runs = self._day(state["days"][day])
            known += [f for r in runs for f in r["files"] if f["low"] <= region <= f["high"]]
            known.sort(key=lambda f: -f["newest"])
            opened = 1
            while known:
                first = self._read([f["path"] for f in known[:opened]])
                # At most n times come to the driver.
                times = (
                    first.where(F.col(self.region) == region).select(F.unix_micros(self.ts).alias("t"))
                    .orderBy(F.desc("t")).limit(n).collect()
                )
                reach = len(known)
                if len(times) == n:
                    # The more files are looked at, the nearer is the bound.
                    reach = sum(f["newest"] >= times[-1]["t"] for f in known)
                    if reach <= opened:
                        return [f["path"] for f in known[:reach]]
                if opened >= len(known):
                    break
                opened = min(opened * 2, reach)
        return [f["path"] for f in known]

    # ---- parts ---------------------------------------------------------------------------------

    def _read(self, names):
        return self.spark.read.parquet(*[f"{self.path}/{n}" for n in names])

    def _state(self):
        names = self.folder.names(_STATES)
        if not names:
            return {"number": 0, "days": {}}
        return json.loads(self.folder.read_text(f"{_STATES}/{names[-1]}"))

    def _day(self, name):
        return json.loads(self.folder.read_text(f"{_DAYS}/{name}"))

    def _swap(self, state, changed):
        """The next state, with new manifests of the changed days."""
        number = state["number"] + 1
        days = dict(state["days"])
        for day, runs in changed.items():
            days[day] = f"{day}-{number:012d}.json"
            self.folder.write_text(f"{_DAYS}/{days[day]}", json.dumps(runs))
        new = {"number": number, "days": days}
        if not self.folder.write_text(f"{_STATES}/{number:012d}.json", json.dumps(new)):
            raise RuntimeError(f"two writers change {self.path}")
        return new
