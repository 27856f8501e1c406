"""Joins and ordered look-ups that hold when one key has a large share of the rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when its measured size is below this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024
# No key is treated as heavy below this many rows: one task handles them easily.
HEAVY_FLOOR = 1_000_000
# At most this many keys can be heavy, whatever the data (see heavy_keys).
MAX_HEAVY_KEYS = 50_000
# Into how many parts a look-up cuts the rows of one heavy key.
SALTS = 64


def measured_bytes(df):
    """Logical size of ``df`` from one aggregate over it: text lengths plus fixed widths."""
    fixed = 0
    varying = F.lit(0).cast("bigint")
    for column in df.schema:
        if isinstance(column.dataType, (T.StringType, T.BinaryType)):
            varying = varying + F.coalesce(F.octet_length(column.name), F.lit(0))
            fixed += 16
        elif isinstance(column.dataType, (T.ArrayType, T.MapType, T.StructType)):
            varying = varying + F.coalesce(F.octet_length(F.to_json(column.name)), F.lit(0))
            fixed += 24
        else:
            fixed += 8
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(varying).alias("b")).first()
    return size.n * fixed + (size.b or 0)


def fits_broadcast(df, limit=None):
    return measured_bytes(df) <= (BROADCAST_BYTES if limit is None else limit)


def heavy_keys_of(df, keys, floor=HEAVY_FLOOR):
    """``heavy_keys`` for several columns from one pass over ``df``."""
    total = df.count()
    if total <= floor:
        return tuple(None for _ in keys)
    threshold = max(floor, total // MAX_HEAVY_KEYS)
    each = F.array(*[F.struct(F.lit(n).alias("n"), F.col(k).cast("string").alias("k")) for n, k in enumerate(keys)])
    counts = df.select(F.explode(each).alias("e")).groupBy("e.n", "e.k").agg(F.count(F.lit(1)).alias("_n"))
    found = counts.where(F.col("_n") > threshold).collect()
    out = []
    for n, key in enumerate(keys):
        rows = [(r["k"],) for r in found if r["n"] == n]
        frame = df.sparkSession.createDataFrame(rows, f"`{key}` string")
        out.append(frame.select(F.col(key).cast(df.schema[key].dataType)) if rows else None)
    return tuple(out)


def heavy_keys(df, key, floor=HEAVY_FLOOR, total=None):
    """The keys that hold too many rows for one task, or None when there are none.

    A key is heavy when it has more than ``max(floor, total / MAX_HEAVY_KEYS)`` rows. Fewer than
    MAX_HEAVY_KEYS keys can each exceed that share of the total, so the list is small by
    construction and may be collected and broadcast. Counting combines on the map side first.
    Null counts as a key. ``total`` is the number of rows where the caller knows it.
    """
    if total is None:
        total = df.count()
    if total <= floor:
        return None
    threshold = max(floor, total // MAX_HEAVY_KEYS)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.where(F.col("_n") > threshold).select(key).collect()
    if not found:
        return None
    return df.sparkSession.createDataFrame(found, counts.select(key).schema)


def lookup_join(fact, dim, key, how="inner", heavy=None, limit=None, salts=SALTS):
    """Join a large ``fact`` with a dimension on ``key``; ``how`` is inner or left.

    Without heavy keys this is a plain join: Spark broadcasts a side below its size threshold and
    shuffles both sides otherwise. ``heavy`` lists the keys of the fact found by ``heavy_keys``. A
    dimension of checked small size is then broadcast. For a larger one the rows of each heavy key,
    and of the null key, which matches nothing, are dealt to ``salts`` parts by a hash of the whole
    row, and only the dimension rows of heavy keys are repeated that often: one scan, one join.
    """
    if heavy is None:
        return fact.join(dim, key, how)
    if fits_broadcast(dim, limit):
        return fact.join(F.broadcast(dim), key, how)
    listed = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
    part = F.pmod(F.xxhash64(*fact.columns), F.lit(salts)).cast("int")
    apart = F.col("_heavy").isNotNull() | F.col(key).isNull()
    left = fact.join(listed, key, "left").withColumn("_salt", F.when(apart, part).otherwise(0))
    parts = F.when(F.col("_heavy").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = dim.join(listed, key, "left").withColumn("_salt", F.explode(parts))
    return left.drop("_heavy").join(right.drop("_heavy"), [key, "_salt"], how).drop("_salt")


def with_slice(df, key, ts, heavy, slice_ms):
    """Add ``_slice``: a time slice for the rows of heavy keys, null for all others."""
    flagged = df.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), key, "left")
    number = F.floor(F.unix_millis(ts) / F.lit(slice_ms)).cast("bigint")
    return flagged.withColumn("_slice", F.when(F.col("_heavy"), number)).drop("_heavy")


def with_neighbour(
    df, keys, order, columns, direction="previous", slice_col=None, keep=None
):
    """Add columns of the previous or next row per key: ``columns`` maps new name to source column.

    Without ``slice_col`` this is lag or lead over the keys. With it, rows are ordered inside
    (keys, slice), so a key with very many rows is spread over as many tasks as it has slices. A
    second window finds the neighbours across slice borders: the first and last row of each slice
    meet there in one group per key, all other rows keep what they have. Slices must follow the
    order. Rows whose slice is null belong to ordinary keys and have no borders.

    ``keep`` is a condition on the new columns. Rows that fail it are dropped, those inside a
    slice before the second window already.
    """
    shift = F.lag if direction == "previous" else F.lead
    if slice_col is None:
        window = Window.partitionBy(*keys).orderBy(*order)
        found = df.withColumns({new: shift(old).over(window) for new, old in columns.items()})
        return found if keep is None else found.where(keep)

    local = Window.partitionBy(*keys, slice_col).orderBy(*order)
    first = F.lag(F.lit(True)).over(local).isNull()
    last = F.lead(F.lit(True)).over(local).isNull()
    placed = df.withColumns(
        {
            **{new: shift(old).over(local) for new, old in columns.items()},
            "_open": first if direction == "previous" else last,
            "_border": (first | last) & F.col(slice_col).isNotNull(),
        }
    )
    if keep is not None:
        placed = placed.where(keep | F.col("_border"))
    placed = placed.withColumn("_lane", F.when(~F.col("_border"), F.col(slice_col)))
    across = Window.partitionBy(*keys, "_border", "_lane").orderBy(*order)
    unknown = F.col("_open") & F.col("_border")
    found = placed.withColumns(
        {
            new: F.when(unknown, shift(old).over(across)).otherwise(F.col(new))
            for new, old in columns.items()
        }
    )
    if keep is not None:
        found = found.where(keep)
    return found.drop("_open", "_border", "_lane")
