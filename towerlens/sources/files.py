"""Delimited files with fixed schemas, and text lines with their order."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from towerlens import schemas


def read_delimited(spark, path, schema, sep="|"):
    """A delimited text file or folder under an explicit schema; bad values become null."""
    return spark.read.schema(schema).option("sep", sep).option("mode", "PERMISSIVE").csv(path)


def read_signal(spark, path):
    """Signal records with their event time. Unused columns are pruned from the scan by Spark."""
    raw = read_delimited(spark, path, schemas.SIGNAL)
    return raw.withColumn("event_ts", F.timestamp_millis("start_ms"))


def read_signal_hour(spark, root, hour):
    """Signals of one hour of a store laid out as ``produce_hour=yyyyMMddHH`` folders.

    The filter is on the partition column, so other hours are neither listed nor read.
    """
    schema = T.StructType(schemas.SIGNAL.fields + [T.StructField("produce_hour", T.StringType())])
    raw = read_delimited(spark, root, schema).where(F.col("produce_hour") == hour)
    return raw.withColumn("event_ts", F.timestamp_millis("start_ms"))


def read_user_info(spark, path):
    """Subscriber attributes. Gender is read as text, so files with numeric codes work as well."""
    return read_delimited(spark, path, schemas.USER_INFO)


def read_region_cell(spark, path):
    return read_delimited(spark, path, schemas.REGION_CELL)


def read_cell_loc(spark, path):
    return read_delimited(spark, path, schemas.CELL_LOC)


def read_target_region(spark, path):
    lines = spark.read.text(path)
    return lines.select(F.trim("value").alias("region_id")).where(F.col("region_id") != "")


def read_lines(spark, path):
    """Text lines with ``line_no``, which follows file name and place in the file.

    Lines of one task are numbered in file order, and blocks of a file are told apart by their
    start offset, so the triple orders lines also when a large file is split over tasks.
    """
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_no"),
    )
