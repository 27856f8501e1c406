"""Scalar expressions: time buckets, age bands, gender codes, text fields, counters."""

from pyspark.sql import functions as F

# The age bands of the live counters, [low, high) in years.
LIVE_AGE_BANDS = {
    "age_10_20": (10, 20),
    "age_20_40": (20, 40),
    "age_40": (40, None),
}


def millis_to_ts(ms):
    return F.timestamp_millis(F.col(ms) if isinstance(ms, str) else ms)


def hour_text(ts):
    """``yyyyMMddHH`` in the session time zone."""
    return F.date_format(ts, "yyyyMMddHH")


def day_text(hour):
    """The day part of a ``yyyyMMddHH`` text."""
    return F.substring(hour, 1, 8)


def second_text(ts):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def fields(line, sep="|"):
    return F.split(line, "\\" + sep)


def field(parts, position):
    """The field at ``position``, or null where the line is too short."""
    return F.get(parts, F.lit(position))


def as_int(text):
    return F.trim(text).try_cast("int")


def as_long(text):
    return F.trim(text).try_cast("bigint")


def as_double(text):
    return F.trim(text).try_cast("double")


def point(text):
    """``'x,y'`` to an array of two doubles."""
    return F.transform(F.split(text, ","), as_double)


def polygon(text):
    """``'x,y;x,y;...'`` to an array of points."""
    return F.transform(F.split(text, ";"), point)


def age_band(age):
    """'10' for [10, 20), '20' for [20, 40), '40' from 40 on, null below 10."""
    return (
        F.when((age >= 10) & (age < 20), "10")
        .when((age >= 20) & (age < 40), "20")
        .when(age >= 40, "40")
    )


def age_band_closed_upper(age):
    """Bands that include their upper end: up to 20, (20, 40], above 40."""
    return (
        F.when(age <= 20, "age20down")
        .when(age <= 40, "age20-40")
        .when(age > 40, "age40up")
    )


def gender_code(gender):
    """'1' or '0'; null for every other code."""
    return F.when(gender == "1", "1").when(gender == "0", "0")


def gender_name(gender):
    return F.when(gender == "1", "boy").when(gender == "0", "girl").otherwise("none")


def persona_counters(gender="gender", age="age"):
    """The counters of one audience make-up row.

    They count records, not distinct people. Everyone whose gender is not '1' counts as a woman,
    and people under 10 are in the total but in no age band.
    """
    is_man = F.col(gender).eqNullSafe("1")
    counters = [
        F.count_if(is_man).alias("man"),
        F.count_if(~is_man).alias("women"),
    ]
    for name, (low, high) in LIVE_AGE_BANDS.items():
        inside = F.col(age) >= low
        if high is not None:
            inside = inside & (F.col(age) < high)
        counters.append(F.count_if(inside).alias(name))
    return counters + [F.count(F.lit(1)).alias("pep_cnt")]
