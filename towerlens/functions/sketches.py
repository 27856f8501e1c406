"""People counts that merge: theta sketches per key, for any span and any portrait.

A sketch keeps the smallest hashes of the ids it has seen, at most about ``2**LG_ENTRIES``, so it has
a fixed size however many people a key has. Sketches of hours merge to days, and a day's sketch
intersects with that of a portrait. Counts of at most ``2**LG_ENTRIES`` people are exact; beyond, the
standard error is the count over the root of ``2**LG_ENTRIES``, and for an intersection that of the
larger input. ``bound`` is four such errors.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from towerlens.operators.skew import fits_broadcast

LG_ENTRIES = 12
ERRORS = 4.0
MOST_RIGHT = 256


def build(members, keys, id_col="bitmap_id", lg=LG_ENTRIES):
    """``(keys..., people)`` with one sketch per key. Null ids are ignored."""
    present = members.where(F.col(id_col).isNotNull())
    return present.groupBy(*keys).agg(F.theta_sketch_agg(F.col(id_col), F.lit(lg)).alias("people"))


def union(sketches, keys, lg=LG_ENTRIES):
    """Sketches of one key merged, for example the hours of a day; combined on the map side."""
    return sketches.groupBy(*keys).agg(F.theta_union_agg("people", F.lit(lg)).alias("people"))


def intersect(left, right, left_keys, right_keys):
    """Every left sketch AND every right one, with ``_of``, the larger of the two estimates.

    ``right`` is a table of at most MOST_RIGHT keys, such as the portraits, which get numbers; every
    left row meets each number in a join. Pairs are what the result consists of, so none is made in
    vain; larger right sides are an error.
    """
    right = right.select(*right_keys, F.col("people").alias("_right"))
    rows = right.limit(MOST_RIGHT + 1).collect()
    if len(rows) > MOST_RIGHT or not fits_broadcast(right):
        raise ValueError("the right side of an intersection has to be a table of few sketches")
    schema = T.StructType([T.StructField("_slot", T.IntegerType()), *right.schema.fields])
    few = right.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    slot = F.explode(F.array(*[F.lit(i) for i in range(len(rows))]).cast("array<int>")).alias("_slot")
    pairs = left.select(*left_keys, "people", slot).join(F.broadcast(few), "_slot")
    sizes = [F.theta_sketch_estimate(c) for c in ("people", "_right")]
    return pairs.select(
        *left_keys,
        *right_keys,
        F.theta_intersection("people", "_right").alias("people"),
        F.greatest(*sizes).alias("_of"),
    )


def estimate(sketches, lg=LG_ENTRIES):
    """The keys with ``n_people``, and ``bound``, how far the true count may be from it."""
    n = F.theta_sketch_estimate("people")
    of = F.col("_of") if "_of" in sketches.columns else n
    bound = F.when(of <= 2**lg, F.lit(0.0)).otherwise(ERRORS * of / 2 ** (lg / 2))
    keys = [c for c in sketches.columns if c not in ("people", "_of")]
    return sketches.select(*keys, n.alias("n_people"), bound.alias("bound"))
