"""Batch table writers. All but an appending ``write_jdbc`` may be run again without changing the result."""

from urllib.parse import quote

from pyspark.sql import functions as F

from towerlens.operators.latest import last_per_key
from towerlens.sinks.keyed import KeyedTable


def overwrite(df, path):
    """Replace a table, as the portrait job does before each load."""
    df.write.mode("overwrite").parquet(path)


def overwrite_hours(members, path, load):
    """Write the region-hour rows of one load, into a folder per hour and load.

    ``load`` names the input, such as its folder. The same load again replaces its own rows; rows
    that other loads gave for the same hour stay, so a straggler adds to its hour. The rebalance
    hint sizes the output files: it joins small partitions and splits an hour that holds a large
    share of the rows.
    """
    (
        members.withColumn("load", F.lit(load))
        .hint("rebalance", "produce_hour")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("produce_hour", "load")
        .parquet(path)
    )


def overwrite_load(members, path, load):
    """Write the region-hour rows of one load into one folder; for loads that span many hours.

    ``load`` names the input, such as its folder. The same load again replaces its own folder; rows
    that other loads gave for the same hour stay, so a straggler adds to its hour. Rows are dealt by
    ranges of hour, region and id, so an hour or a region of any size may fill many files, and a
    filter on the hour skips files and row groups by their minima and maxima.
    """
    order = ["produce_hour", "region_id", "bitmap_id"]
    overwrite(
        members.select("region_id", "produce_hour", "bitmap_id")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order),
        f"{path}/load={quote(load, safe='')}",
    )


def read_hours(spark, path):
    """Region-hour rows of all loads, each once. A filter on the hour reaches the scan.

    Tables of both layouts are read; one table keeps to one of them.
    """
    schema = "region_id string, bitmap_id bigint, produce_hour string, load string"
    rows = spark.read.schema(schema).parquet(path)
    return rows.select("region_id", "produce_hour", "bitmap_id").distinct()


def append_index(new_ids, path):
    """Add ids of unseen subscribers to the user index."""
    new_ids.write.mode("append").parquet(path)


def write_bucketed(df, table, key, buckets, path=None):
    """Save a catalogue table bucketed and sorted by ``key``.

    Tables bucketed alike on imsi, such as the subscribers and the user index, join without a
    shuffle; a stream joined with one only shuffles its own small micro-batch.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def write_jdbc(df, options, mode="append", batch=10_000, truncate=False):
    """Write to a JDBC table in batches, one connection per partition."""
    (
        df.write.format("jdbc")
        .options(**options)
        .option("batchsize", str(batch))
        .option("truncate", str(truncate).lower())
        .mode(mode)
        .save()
    )


def show(df, n=10):
    df.show(n, truncate=False)


def upsert_slot(spark, updates, path, keys, version, batch_id):
    """Merge keyed ``updates`` into the table at ``path``; the row with the greatest version wins.

    The table has two folders used in turn: batch n reads the one that batch n-1 wrote and
    replaces the other. A batch that is run again therefore starts from the same state. A folder
    carries the number of its batch, and readers open finished folders only.
    """
    before = _read_slot(spark, path, batch_id - 1, updates.schema)
    rows = updates if before is None else before.unionByName(updates)
    replace_slot(last_per_key(rows, keys, version), path, batch_id)


def replace_slot(df, path, batch_id):
    """Write the whole table as it is after batch ``batch_id``."""
    df.withColumn(_BATCH, F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
        _slot(path, batch_id)
    )


def read_current(spark, path, schema):
    """The table as the newest finished batch left it; empty before the first batch.

    Tables of ``keyed`` and those of two slots are read alike.
    """
    if KeyedTable.exists(spark, path):
        return KeyedTable.opened(spark, path, schema).read()
    slots = [s for s in (_read_slot(spark, path, n, schema, _BATCH) for n in (0, 1)) if s is not None]
    if not slots:
        return spark.createDataFrame([], schema)
    numbers = [s.agg(F.max(_BATCH)).first()[0] for s in slots]
    newest = max(range(len(slots)), key=lambda i: -1 if numbers[i] is None else numbers[i])
    return slots[newest].drop(_BATCH)


def previous_slot(spark, path, batch_id, schema):
    """The table as it was before batch ``batch_id``, or None before the first batch."""
    return _read_slot(spark, path, batch_id - 1, schema)


def compact_events(events, path):
    """Lay an event log out for serving: a folder per day, sorted by region and time inside files.

    The whole log is written anew, so it may be done again at any time. Rows are dealt by ranges of
    day, region and time, so one region may fill many files of a day. Readers of one region skip
    other days by folder and other regions by the minima and maxima of files and row groups.
    """
    order = ["day", "region_id", F.desc("event_ts")]
    days = events.drop("batch_id").withColumn("day", F.date_format("event_ts", "yyyyMMdd"))
    (
        days.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .partitionBy("day")
        .parquet(path)
    )


def read_events(spark, path, first_day=None):
    """Events of a compacted log, from ``first_day`` (yyyyMMdd) on if it is given."""
    rows = spark.read.parquet(path)
    if first_day is not None:
        rows = rows.where(F.col("day").cast("string") >= first_day)
    return rows.drop("day")


def append_batch(df, path, batch_id):
    """Append one micro-batch; running the batch again replaces its own folder."""
    df.hint("rebalance").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


_BATCH = "_batch"


def _slot(path, batch_id):
    return f"{path}/slot={batch_id % 2}"


def _read_slot(spark, path, batch_id, schema, *more):
    """A slot that is there and finished, or None. A writer removes the mark of success first."""
    folder = _slot(path, batch_id)
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(mark):
        return None
    text = schema if isinstance(schema, str) else ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields
    )
    return spark.read.schema(", ".join([text, *(f"{name} bigint" for name in more)])).parquet(folder)
