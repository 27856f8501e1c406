"""Stored tables: parquet, optional JDBC, and SQL texts with named parameters."""

from pyspark.sql import functions as F


def read_table(spark, path):
    return spark.read.parquet(path)


def jdbc_options(url, table, driver=None, user=None, password=None, **extra):
    """Options of a JDBC table. Credentials come from the caller, never from the source tree."""
    options = {"url": url, "dbtable": table, "driver": driver, "user": user, "password": password}
    options.update(extra)
    return {key: str(value) for key, value in options.items() if value is not None}


def read_jdbc(spark, options, split_on=None, lower=None, upper=None, partitions=None):
    """A JDBC table; with ``split_on`` it is read in ``partitions`` parallel ranges.

    Needs the driver jar of the database on the class path.
    """
    reader = spark.read.format("jdbc").options(**options)
    if split_on is not None:
        reader = reader.options(
            partitionColumn=split_on,
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(partitions),
        )
    return reader.load()


def query(spark, text, **params):
    """Run a SQL text with named parameters (``:name``), never with values pasted into the text."""
    return spark.sql(text, args=params)


def register(**frames):
    """Register frames as temp views under their keyword names."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def hour_bounds(hour):
    """First instant of a ``yyyyMMddHH`` hour and of the next hour, as scalar columns."""
    start = F.to_timestamp(F.lit(hour), "yyyyMMddHH")
    return start, start + F.expr("INTERVAL 1 HOUR")
