"""Parsers for ``|``-separated lines.

A bad line never fails a job: every parser adds ``is_valid`` and keeps the line, ``accepted``
drops bad lines, and ``reject_counts`` reports how many there were. One pass serves both.
"""

from pyspark.sql import functions as F

from towerlens.functions import columns as C


def parse_signal(lines, line="line"):
    """Signal lines to imsi, laccell, latitude, longitude, start_ms."""
    typed = _typed(
        lines,
        line,
        imsi=_part(0),
        laccell=_part(1),
        latitude=C.as_double(_part(2)),
        longitude=C.as_double(_part(3)),
        start_ms=C.as_long(_part(4)),
    )
    return _validated(typed, "imsi", "laccell", "latitude", "longitude", "start_ms")


def parse_signal_cell(lines, line="line"):
    """The tolerant reading of signal lines: only imsi and laccell have to be there."""
    return _validated(_typed(lines, line, imsi=_part(0), laccell=_part(1)), "imsi", "laccell")


def parse_user_info(lines, line="line"):
    """Subscriber lines to imsi, gender, age; negative ages are bad."""
    typed = _typed(
        lines, line, imsi=_part(0), gender=F.trim(_part(1)), age=C.as_int(_part(2))
    )
    return _validated(typed, "imsi", "gender", "age", extra=F.col("age") > -1)


def parse_region_cell(lines, line="line"):
    """Cell lines to region_id, laccell."""
    typed = _typed(lines, line, region_id=_part(0), laccell=_part(1))
    return _validated(typed, "region_id", "laccell")


def parse_region_center(lines, line="line"):
    """Region lines to region_id, name, center, boundary; a line must have exactly four parts."""
    typed = _typed(
        lines,
        line,
        region_id=_part(0),
        center=C.point(_part(1)),
        boundary=C.polygon(_part(2)),
        name=_part(3),
        _n=F.size("_parts"),
    )
    return _validated(typed, "region_id", extra=F.col("_n") == 4).drop("_n")


def _part(position):
    return C.field(F.col("_parts"), position)


def _typed(lines, line, **columns):
    """Add the typed columns to ``lines``.

    The columns come out of ``inline``, which the optimiser does not merge with later filters, so
    each line is split and converted once and not again for every use of a column.
    """
    values = F.struct(*[column.alias(name) for name, column in columns.items()])
    parts = lines.withColumn("_parts", C.fields(F.col(line)))
    return parts.select(*lines.columns, F.inline(F.array(values)))


def _validated(df, *required, extra=None):
    valid = F.lit(True)
    for column in required:
        valid = valid & F.col(column).isNotNull()
    if extra is not None:
        valid = valid & extra
    return df.withColumn("is_valid", F.coalesce(valid, F.lit(False)))


def accepted(parsed):
    return parsed.where("is_valid").drop("is_valid")


def rejected(parsed, line="line"):
    return parsed.where("not is_valid").select(line)


def reject_counts(parsed):
    return parsed.agg(
        F.count_if("is_valid").alias("n_ok"),
        F.count_if(~F.col("is_valid")).alias("n_rejected"),
    )
