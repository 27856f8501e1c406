"""The user index as a table in hash buckets that grows by loads.

Files are bucketed by imsi, so a load finds its unseen subscribers by shuffling its own distinct
imsis to the buckets; the index itself is read where it lies. Each load notes the ids it takes before
it writes them, so the next load reads the highest id from a table of one row per load and not from
the index, and a load that failed half-way takes the same ids when it is run again.
"""

import uuid

from pyspark.sql import functions as F

from towerlens.operators.user_index import dense_ids
from towerlens.session import materialise

_LOADS = "load string, first bigint, last bigint"


class IndexTable:
    """``(key, id)`` under ``path``; ids are dense from 1 and never move. One load runs at a time.

    A load that failed has to be run again before the next one, or its ids stay unused.
    """

    def __init__(self, spark, path, key="imsi", id_col="bitmap_id", buckets=1024):
        self.spark, self.path, self.key, self.id_col, self.buckets = spark, path, key, id_col, buckets
        self.schema = f"`{key}` string, `{id_col}` bigint"
        # The catalogue entry only tells Spark of the buckets; the files are those under the path.
        self.name = f"user_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({self.schema}) USING parquet LOCATION '{path}/ids' "
            f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS"
        )

    def read(self):
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def loads(self):
        """One row per load: its name and the ids it took, first to last (last < first: none)."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/loads")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], _LOADS)
        return self.spark.read.schema(_LOADS).parquet(f"{self.path}/loads")

    def unseen(self, df):
        """The keys of ``df`` that the index lacks, each once. The index side has no exchange."""
        keys = df.select(F.col(self.key).cast("string")).where(F.col(self.key).isNotNull()).distinct()
        known = self.read().select(self.key).hint("merge")
        return keys.repartition(self.buckets, self.key).join(known, self.key, "left_anti")

    def load(self, df, load):
        """Add the subscribers of ``df`` that are new; ``load`` names the input."""
        taken = self.loads()
        new = materialise(self.unseen(df))
        count = new.count()
        first = self._free_range(taken.where(F.col("load") == load), count)
        if first is None:
            highest = taken.agg(F.max("last")).first()[0] or 0
            first = highest + 1
            noted = self.spark.createDataFrame([(load, first, highest + count)], _LOADS)
            noted.coalesce(1).write.mode("append").parquet(f"{self.path}/loads")
        if count:
            ids = dense_ids(new, self.key, self.id_col, first=first)
            # As many writing tasks as buckets, each of which writes one file.
            rows = ids.repartition(self.buckets, self.key).sortWithinPartitions(self.key)
            writer = rows.write.mode("append").format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key)
            writer.saveAsTable(self.name)

    def _free_range(self, mine, count):
        """The first id that an earlier run of this load noted and did not write, or None.

        Only a load that is run again and finds new subscribers looks into the index for that.
        """
        last = mine.orderBy(F.desc("first"), F.desc("last")).first()
        if last is None:
            return None
        if count == 0:
            return last["first"]
        if count > last["last"] - last["first"] + 1:
            return None
        written = self.read().where(F.col(self.id_col).between(last["first"], last["last"])).limit(1)
        return None if written.count() else last["first"]
