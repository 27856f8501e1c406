"""Keyed tables that are not written anew with every change.

A table is a base and deltas. The base has its rows in hash buckets of the keys, each a folder. A
micro-batch writes one delta, of its own rows only; a batch that is run again replaces its delta.
Readers merge deltas into the base. From time to time the deltas are compacted: only the buckets
whose keys they hold are written, into new folders, and a new manifest names the folders of all
buckets and the last batch in them. Manifests are put in place whole and never changed, so a reader
keeps one state however long it reads, until ``clean`` removes states that no reader uses.

Rows of one key merge by a rule of the table: the row with the greatest version wins, or numbers
add up and all other columns take their maximum.
"""

import json

from pyspark.sql import functions as F

from towerlens.operators.latest import last_per_key
from towerlens.sinks.files import Folder

BUCKETS = 32
# So many deltas are compacted by the batch that brings the last of them.
OPEN_DELTAS = 16
_ABOUT = "_about.json"
_MANIFESTS = "manifests"


class KeyedTable:
    """One keyed table; ``schema`` is that of its rows."""

    def __init__(self, spark, path, schema, keys, version=None, sums=(), buckets=BUCKETS):
        if (version is None) == (not sums):
            raise ValueError("give a version column or columns to sum")
        self.spark, self.path, self.folder = spark, path, Folder(spark, path)
        self.schema = schema if isinstance(schema, str) else ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields
        )
        self.about = {"keys": list(keys), "version": version, "sums": list(sums), "buckets": buckets}

    @staticmethod
    def exists(spark, path):
        return Folder(spark, path).exists(_ABOUT)

    @staticmethod
    def opened(spark, path, schema):
        """A table that is there already, with the rule it was made with."""
        about = json.loads(Folder(spark, path).read_text(_ABOUT))
        return KeyedTable(spark, path, schema, about["keys"], about["version"], about["sums"], about["buckets"])

    # ---- writing -------------------------------------------------------------------------------

    def put(self, rows, batch_id, open_deltas=OPEN_DELTAS):
        """Merge the rows of a micro-batch into the table; no base file is written but by compaction."""
        if not self.folder.exists(_ABOUT):
            self.folder.write_text(_ABOUT, json.dumps(self.about))
        self._merged(rows).write.mode("overwrite").parquet(f"{self.path}/deltas/{_number(batch_id)}")
        if len(self._open(self._manifest())) >= open_deltas:
            self.compact()

    def compact(self):
        """Write the buckets that open deltas touch; returns their numbers."""
        state = self._manifest()
        deltas = self._open(state)
        if not deltas:
            return []
        changes = self._bucketed(self._read([f"deltas/{d}" for d in deltas]))
        # At most one number per bucket.
        touched = sorted(r[0] for r in changes.select("_bucket").distinct().collect())
        number = state["number"] + 1
        held = [state["folders"][str(b)] for b in touched if str(b) in state["folders"]]
        rows = changes.drop("_bucket")
        if held:
            rows = self._read(held).unionByName(rows)
        made = f"base/{_number(number)}"
        merged = self._bucketed(self._merged(rows))
        (
            merged.repartition("_bucket").sortWithinPartitions("_bucket", *self.about["keys"])
            .write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{made}")
        )
        folders = {**state["folders"], **{str(b): f"{made}/_bucket={b}" for b in touched}}
        new = {"number": number, "upto": int(deltas[-1]), "folders": folders}
        if not self.folder.write_text(f"{_MANIFESTS}/{_number(number)}.json", json.dumps(new)):
            raise RuntimeError(f"two writers compact {self.path}")
        return touched

    def clean(self, states=2):
        """Remove what only states before the newest ``states`` need."""
        names = self.folder.names(_MANIFESTS)
        kept = [self._state(n) for n in names[-states:]]
        if not kept:
            return
        used = {f.split("/")[1] for state in kept for f in state["folders"].values()}
        newest = max(state["number"] for state in kept)
        for name in self.folder.names("base"):
            if name not in used and int(name) <= newest:
                self.folder.remove(f"base/{name}")
        for name in self.folder.names("deltas"):
            if int(name) <= min(state["upto"] for state in kept):
                self.folder.remove(f"deltas/{name}")
        for name in names[:-states]:
            self.folder.remove(f"{_MANIFESTS}/{name}")

    # ---- reading -------------------------------------------------------------------------------

    def read(self):
        """All rows as they are now; a later change of the table does not reach this frame."""
        state = self._manifest()
        folders = sorted(state["folders"].values())
        return self._with_deltas(state, folders)

    def get(self, *key):
        """The row of one key, from the files of its bucket and the open deltas."""
        state, names = self._manifest(), self.about["keys"]
        one = self.spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip(names, key)])
        kinds = dict(self._empty().dtypes)
        one = one.select(*[F.col(n).cast(kinds[n]).alias(n) for n in names])
        bucket = str(self._bucketed(one).first()["_bucket"])
        rows = self._with_deltas(state, [f for b, f in state["folders"].items() if b == bucket], key)
        return rows

    def _with_deltas(self, state, folders, key=None):
        deltas = [f"deltas/{d}" for d in self._open(state)]

        def chosen(frame):
            for name, value in zip(self.about["keys"], key or ()):
                frame = frame.where(F.col(name) == value)
            return frame

        base = chosen(self._read(folders)) if folders else self._empty()
        if not deltas:
            return base
        return self._merged(base.unionByName(chosen(self._read(deltas))))

    # ---- parts ---------------------------------------------------------------------------------

    def _empty(self):
        return self.spark.createDataFrame([], self.schema)

    def _read(self, names):
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _merged(self, rows):
        keys, version, sums = self.about["keys"], self.about["version"], self.about["sums"]
        if version is not None:
            return last_per_key(rows, keys, version)
        rest = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(
            *[(F.sum(c) if c in sums else F.max(c)).alias(c) for c in rest]
        ).select(*rows.columns)

    def _bucketed(self, rows):
        number = F.pmod(F.xxhash64(*self.about["keys"]), F.lit(self.about["buckets"])).cast("int")
        return rows.withColumn("_bucket", number)

    def _manifest(self):
        names = self.folder.names(_MANIFESTS)
        return self._state(names[-1]) if names else {"number": 0, "upto": -1, "folders": {}}

    def _state(self, name):
        return json.loads(self.folder.read_text(f"{_MANIFESTS}/{name}"))

    def _open(self, state):
        """Finished deltas that no base holds yet."""
        found = [d for d in self.folder.names("deltas") if int(d) > state["upto"]]
        return [d for d in found if self.folder.finished(f"deltas/{d}")]


def _number(n):
    return f"{n:012d}"
