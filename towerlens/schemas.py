"""Fixed schemas of the inputs. Nothing is inferred from data."""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


SIGNAL = _struct(
    ("imsi", T.StringType()),
    ("laccell", T.StringType()),
    ("latitude", T.DoubleType()),
    ("longitude", T.DoubleType()),
    ("start_ms", T.LongType()),
)

USER_INFO = _struct(
    ("imsi", T.StringType()),
    ("gender", T.StringType()),
    ("age", T.IntegerType()),
)

REGION_CELL = _struct(
    ("region_id", T.StringType()),
    ("laccell", T.StringType()),
)

CELL_LOC = _struct(
    ("laccell", T.StringType()),
    ("latitude", T.DoubleType()),
    ("longitude", T.DoubleType()),
)

TARGET_REGION = _struct(("region_id", T.StringType()))

USER_INDEX = _struct(
    ("imsi", T.StringType()),
    ("bitmap_id", T.LongType()),
)
