"""Streaming sources. All of them give a column ``line``; Kafka adds ``partition`` and ``offset``."""

from pyspark.sql import functions as F


def kafka_options(servers, topic, starting="latest", group=None, **extra):
    """Options of a Kafka topic. ``starting`` only counts for the first start of a query;
    afterwards the offsets in its checkpoint apply."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
    }
    if group is not None:
        options["kafka.group.id"] = group
    options.update(extra)
    return options


def kafka_lines(spark, options):
    """Message values of a Kafka topic. Needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.select(F.col("value").cast("string").alias("line"), "partition", "offset")


def file_lines(spark, path, files_per_trigger=None):
    """Lines of the text files that appear in a folder."""
    reader = spark.readStream
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(F.col("value").alias("line"))


def file_table(spark, path, schema, files_per_trigger=None):
    """Rows of the parquet files that appear in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
