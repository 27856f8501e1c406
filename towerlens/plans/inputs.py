"""The reference inputs as views over the given tables.

``events`` plays the signal feed, ``customer`` the subscribers, ``nation`` and ``region`` the cell
and region dimensions. Only integer arithmetic and text building is used.
"""

from pyspark.sql import functions as F

from towerlens.sources import streams, tables

DAY_MS = 86_400_000


def table(spark, sf_dir, name):
    return tables.read_table(spark, f"{sf_dir}/{name}.parquet")


def _text(column):
    return F.col(column).cast("string")


def _prefixed(prefix, column):
    return F.concat(F.lit(prefix), column.cast("string"))


def signal(spark, sf_dir, hour=None):
    """Signals: one cell per user and day; five of the thirty cells belong to no region.

    ``hour`` keeps one ``yyyyMMddHH`` hour; the bounds reach the parquet scan as a filter.
    """
    events = table(spark, sf_dir, "events")
    if hour is not None:
        start, end = (bound.cast("timestamp_ntz") for bound in tables.hour_bounds(hour))
        events = events.where((F.col("ts") >= start) & (F.col("ts") < end))
    return _signal_of(events)


def signal_stream(spark, sf_dir):
    """The same signals as a stream."""
    schema = table(spark, sf_dir, "events").schema
    return _signal_of(streams.file_table(spark, f"{sf_dir}/events*.parquet", schema))


def _signal_of(events):
    timed = events.select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("event_ts"),
    ).withColumn("start_ms", F.unix_millis("event_ts"))
    day = F.expr(f"start_ms div {DAY_MS}")
    return timed.select(
        "event_id",
        _text("user_id").alias("imsi"),
        _prefixed("C", (F.col("user_id") * 7 + day) % 30).alias("laccell"),
        "start_ms",
        "event_ts",
    )


def user_info(spark, sf_dir):
    """Subscribers who are known to the signals: every tenth is not, ages run from 0 to 89."""
    return (
        table(spark, sf_dir, "customer")
        .where(F.col("c_custkey") % 10 != 9)
        .select(
            _text("c_custkey").alias("imsi"),
            (F.col("c_custkey") % 2).cast("string").alias("gender"),
            ((F.col("c_custkey") * 37) % 90).cast("int").alias("age"),
        )
    )


def all_users(spark, sf_dir):
    """Every customer as a subscriber; a third of them have a gender code that is neither 0 nor 1."""
    return table(spark, sf_dir, "customer").select(
        _text("c_custkey").alias("imsi"),
        (F.col("c_custkey") % 3).cast("string").alias("gender"),
        ((F.col("c_custkey") * 37) % 90).cast("int").alias("age"),
    )


def region_cell(spark, sf_dir):
    """The cell dimension in file order (``line_no``)."""
    return table(spark, sf_dir, "nation").select(
        _prefixed("R", F.col("n_regionkey")).alias("region_id"),
        _prefixed("C", F.col("n_nationkey")).alias("laccell"),
        F.col("n_nationkey").cast("bigint").alias("line_no"),
    )


def target_region(spark, sf_dir):
    return (
        table(spark, sf_dir, "region")
        .where(F.col("r_regionkey").isin(0, 2, 3))
        .select(_prefixed("R", F.col("r_regionkey")).alias("region_id"))
    )


def signal_lines(spark, sf_dir):
    """Signals as text; one line in 97 is malformed."""
    good = F.concat_ws(
        "|",
        "imsi",
        "laccell",
        F.concat(F.lit("23."), F.lpad((F.col("event_id") % 100000).cast("string"), 5, "0")),
        F.concat(F.lit("113."), F.lpad((F.col("event_id") * 7 % 100000).cast("string"), 5, "0")),
        _text("start_ms"),
    )
    bad = F.concat(F.lit("bad"), "imsi")
    return signal(spark, sf_dir).select(
        "event_id", F.when(F.col("event_id") % 97 == 0, bad).otherwise(good).alias("line")
    )


def user_lines(spark, sf_dir):
    """Subscribers as text; one customer in 53 has an age that is no number."""
    age = F.when(F.col("c_custkey") % 53 == 0, "x").otherwise(
        ((F.col("c_custkey") * 37) % 90).cast("string")
    )
    return table(spark, sf_dir, "customer").select(
        F.concat_ws("|", _text("c_custkey"), (F.col("c_custkey") % 2).cast("string"), age).alias(
            "line"
        )
    )


def cell_lines(spark, sf_dir):
    """A long cell list as text, one line per part: eight cells per region, one line in 41 bad."""
    key = F.col("p_partkey")
    region = _prefixed("R", F.expr("(p_partkey div 8) % 97"))
    line = F.when(key % 41 == 0, region).otherwise(
        F.concat_ws("|", region, _prefixed("C", key))
    )
    return table(spark, sf_dir, "part").select(key.alias("line_no"), line.alias("line"))


def region_center_lines(spark, sf_dir):
    """Region centres as text. One region is missing on purpose."""
    key = F.col("r_regionkey")
    line = F.concat_ws(
        "|",
        _prefixed("R", key),
        F.concat(
            F.lit("113."), (key + 100).cast("string"), F.lit(",23."), (key + 100).cast("string")
        ),
        F.lit("113.1,23.1;113.2,23.1;113.2,23.2;113.1,23.2"),
        "r_name",
    )
    return (
        table(spark, sf_dir, "region")
        .where(key != 4)
        .select(key.cast("bigint").alias("line_no"), line.alias("line"))
    )


def site_lines(spark, sf_dir):
    """A long list of region centres, one line per supplier.

    Two lines describe each region, so the later one counts; one line in 13 lacks its name.
    """
    key = F.col("s_suppkey")
    line = F.concat_ws(
        "|",
        _prefixed("R", F.expr("s_suppkey div 2")),
        F.concat(F.lit("113."), (key % 90 + 10).cast("string"), F.lit(",23.5")),
        F.concat(F.lit("113.1,23.1;113.2,23."), (key % 9 + 1).cast("string"), F.lit(";113.3,23.3")),
        F.when(key % 13 != 0, F.col("s_name")),
    )
    return table(spark, sf_dir, "supplier").select(key.alias("line_no"), line.alias("line"))
