"""Bitmaps against plain sets."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import rows_of
from towerlens.functions import bitmaps
from towerlens.operators import skew

EDGES = [0, 1, 2, 32767, 32768, 32769, 65536, 65537, 2**32, 2**40 + 5]


def members(spark, sets, key):
    rows = [(name, i) for name, ids in sets.items() for i in sorted(ids)]
    return spark.createDataFrame(rows, f"{key} string, bitmap_id long")


def as_sets(df, key):
    found = {}
    for row in df.collect():
        found.setdefault(row[key], set()).add(row.bitmap_id)
    return found


def test_bucket_edges_round_trip(spark):
    built = bitmaps.build(members(spark, {"a": set(EDGES)}, "k"), ["k"])
    assert rows_of(bitmaps.expand(built, ["k"]), "bitmap_id") == sorted(
        [(i,) for i in EDGES], key=repr
    )
    buckets = {r.bucket: r.n for r in built.select("bucket", F.bitmap_count("bm").alias("n")).collect()}
    assert buckets[0] == 1 and buckets[1] == 4 and buckets[2] == 2 and buckets[3] == 1


def test_nulls_and_empty_input(spark):
    frame = spark.createDataFrame([("a", None), ("a", 3), ("b", None)], "k string, bitmap_id long")
    built = bitmaps.build(frame, ["k"])
    assert as_sets(bitmaps.expand(built, ["k"]), "k") == {"a": {3}}
    assert bitmaps.build(frame.where("false"), ["k"]).count() == 0


def test_expand_many_buckets_per_batch(spark):
    ids = set(range(1, 3_000_000, 997))
    built = bitmaps.build(members(spark, {"a": ids, "b": {5}}, "k"), ["k"])
    assert as_sets(bitmaps.expand(built, ["k"]), "k") == {"a": ids, "b": {5}}


ID_SETS = st.dictionaries(
    st.sampled_from("abc"),
    st.sets(st.integers(0, 100_000) | st.sampled_from(EDGES), min_size=1, max_size=60),
    min_size=1,
    max_size=3,
)


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(left=ID_SETS, right=ID_SETS)
def test_bitmaps_are_sets(spark, left, right):
    lefts = bitmaps.build(members(spark, left, "l"), ["l"])
    rights = bitmaps.build(members(spark, right, "r"), ["r"])
    both = bitmaps.cardinality(bitmaps.intersect(lefts, rights, ["l"], ["r"]), ["l", "r"])
    got = {(r.l, r.r): r.n_users for r in both.collect() if r.n_users}
    wanted = {(a, b): len(x & y) for a, x in left.items() for b, y in right.items() if x & y}
    assert got == wanted
    every = bitmaps.union(lefts.withColumn("one", F.lit(1)), ["one"])
    assert bitmaps.cardinality(every, ["one"]).first().n_users == len(set().union(*left.values()))


@pytest.mark.parametrize("limit", [0, skew.BROADCAST_BYTES])
def test_intersection_of_both_sizes(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
    left = {str(n): set(range(n, 90_000, 701 + n)) for n in range(20)}
    right = {str(n): set(range(n, 90_000, 503 + n)) for n in range(3)}
    lefts = bitmaps.build(members(spark, left, "l"), ["l"])
    rights = bitmaps.build(members(spark, right, "r"), ["r"])
    both = bitmaps.cardinality(bitmaps.intersect(lefts, rights, ["l"], ["r"]), ["l", "r"])
    got = {(r.l, r.r): r.n_users for r in both.collect() if r.n_users}
    assert got == {(a, b): len(x & y) for a, x in left.items() for b, y in right.items() if x & y}


def test_intersection_keeps_pairs_whole(spark):
    """No pair is unfolded or shuffled behind the join, and buckets without a common id have no row."""
    left = {"a": {0, 1, 40_000}, "b": {5}, "c": set(range(32_000, 34_000))}
    right = {"x": {1, 40_000}, "y": {7}, "z": {33_000, 100_000}}
    lefts = bitmaps.build(members(spark, left, "l"), ["l"])
    rights = bitmaps.build(members(spark, right, "r"), ["r"])
    both = bitmaps.intersect(lefts, rights, ["l"], ["r"])
    assert both.columns == ["l", "r", "bucket", "bm"]
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "bitmap_and_agg" not in plan
    got = sorted((r.l, r.r, r.id) for r in bitmaps.expand(both, ["l", "r"], "id").collect())
    assert got == sorted((a, b, i) for a, x in left.items() for b, y in right.items() for i in x & y)
    assert both.count() == 3
    assert bitmaps.intersect(lefts.limit(0), rights, ["l"], ["r"]).count() == 0
