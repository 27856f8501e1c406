"""Sketches against exact counts."""

import pytest
from pyspark.sql import functions as F

from towerlens.functions import sketches
from towerlens.operators import skew


def people(spark, lo, hi, step, key):
    return spark.range(lo, hi, step).select(F.lit(key).alias("k"), (F.col("id") % 7).alias("h"), F.col("id").alias("bitmap_id"))


def test_small_counts_are_exact_after_merging(spark):
    frame = people(spark, 0, 3000, 1, "a").union(people(spark, 0, 900, 3, "b"))
    merged = sketches.union(sketches.build(frame.union(frame), ["k", "h"]), ["k"])
    got = {r.k: (r.n_people, r.bound) for r in sketches.estimate(merged).collect()}
    assert got == {"a": (3000, 0.0), "b": (300, 0.0)}


def test_large_counts_are_within_the_bound(spark):
    frame = people(spark, 0, 200_000, 1, "a").union(people(spark, 0, 200_000, 5, "b"))
    days = sketches.union(sketches.build(frame, ["k", "h"]), ["k"])
    for r in sketches.estimate(days).collect():
        true = {"a": 200_000, "b": 40_000}[r.k]
        assert 0 < r.bound < 0.07 * true and abs(r.n_people - true) <= r.bound
    other = sketches.build(people(spark, 100_000, 300_000, 1, "c"), ["k"]).withColumnRenamed("k", "p")
    for r in sketches.estimate(sketches.intersect(days, other, ["k"], ["p"])).collect():
        true = {"a": 100_000, "b": 20_000}[r.k]
        assert r.p == "c" and r.n_people > 0 and abs(r.n_people - true) <= r.bound


def test_nothing_and_too_much(spark, monkeypatch):
    none = sketches.build(spark.createDataFrame([("a", None)], "k string, bitmap_id long"), ["k"])
    assert none.count() == 0 and sketches.union(none, ["k"]).count() == 0
    some = sketches.build(people(spark, 0, 10, 1, "a"), ["k"])
    assert sketches.intersect(some, none.withColumnRenamed("k", "p"), ["k"], ["p"]).count() == 0
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 1)
    with pytest.raises(ValueError):
        sketches.intersect(some, some.withColumnRenamed("k", "p"), ["k"], ["p"])
