"""Sets of two forms against plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_bitmaps import EDGES, as_sets, members
from towerlens.functions import bitmaps, id_sets
from towerlens.operators import skew

THIN = id_sets.THIN_IDS


def some_sets(seed):
    rng = random.Random(seed)
    return {
        "edges": set(EDGES),
        "thin": set(rng.sample(range(1, 400_000), 300)),
        "below": set(range(1, THIN)),
        "at": set(range(1, THIN + 1)),
        "full": set(range(1, 40_000)),
        "mixed": set(rng.sample(range(1, 32_769), 5000)) | {90_000, 2**40},
    }


def test_round_trip_and_forms(spark):
    sets = some_sets(1)
    frame = members(spark, sets, "k")
    built = id_sets.build(frame.unionByName(frame), ["k"]).cache()
    assert as_sets(id_sets.expand(built, ["k"]), "k") == sets
    assert {r.k: r.n_users for r in id_sets.cardinality(built, ["k"]).collect()} == {k: len(v) for k, v in sets.items()}
    for r in built.collect():
        assert len(r.ids) == (2 * r.n if r.n < THIN else id_sets.BUCKET_BYTES)
    assert {len(r.ids) for r in built.where("k = 'at'").collect()} == {id_sets.BUCKET_BYTES}


def test_same_buckets_as_bitmaps(spark):
    frame = members(spark, some_sets(2), "k")
    maps, sets = bitmaps.build(frame, ["k"]), id_sets.build(frame, ["k"])
    rows = lambda df: sorted((r.k, r.bucket, bytes(r[-1])) for r in df.collect())
    assert rows(id_sets.to_bitmaps(sets, ["k"])) == rows(maps)
    assert rows(id_sets.from_bitmaps(maps, ["k"])) == rows(sets)


@pytest.mark.parametrize("limit", [skew.BROADCAST_BYTES, 0])
def test_intersections(spark, limit, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
    left, right = some_sets(3), some_sets(4)
    made = id_sets.intersect(
        id_sets.build(members(spark, left, "a"), ["a"]), id_sets.build(members(spark, right, "b"), ["b"]), ["a"], ["b"]
    )
    assert ("BroadcastHashJoin" in made._jdf.queryExecution().executedPlan().toString()) == (limit > 0)
    got = {}
    for r in id_sets.expand(made, ["a", "b"]).collect():
        got.setdefault((r.a, r.b), set()).add(r.bitmap_id)
    assert got == {(a, b): x & y for a, x in left.items() for b, y in right.items() if x & y}


@pytest.mark.parametrize("partitions", [1, 7])
def test_unions_over_many_chunks(spark, partitions):
    rng = random.Random(5)
    rows = [(d, h, i) for d in ("mon", None) for h in range(150) for i in rng.sample(range(1, 70_000), 40)]
    rows += [("mon", 200, i) for i in range(1, 33_000)]
    hours = id_sets.build(spark.createDataFrame(rows, "d string, h int, bitmap_id long"), ["d", "h"])
    days = id_sets.union(hours.repartition(partitions), ["d"])
    assert days.count() == days.select("d", "bucket").distinct().count()
    assert as_sets(id_sets.expand(days, ["d"]), "d") == {d: {i for e, _, i in rows if e == d} for d in ("mon", None)}


def test_nothing(spark):
    frame = spark.createDataFrame([("a", None)], "k string, bitmap_id long")
    built = id_sets.build(frame, ["k"])
    assert built.count() == id_sets.union(built, ["k"]).count() == id_sets.expand(built, ["k"]).count() == 0
    assert id_sets.intersect(built, built.withColumnRenamed("k", "b"), ["k"], ["b"]).count() == 0


def test_bytes_of_sparse_sets_follow_their_members(spark):
    rng = random.Random(6)
    rows = [(h, i) for h in range(200) for i in rng.sample(range(1, 3_000_000), 200)]
    frame = spark.createDataFrame(rows, "h int, bitmap_id long")
    sets = id_sets.build(frame, ["h"])
    # With the bucket number and the count of every row.
    stored = sets.agg(F.sum(F.octet_length("ids") + 12)).first()[0]
    dense = bitmaps.build(frame, ["h"]).agg(F.sum(F.octet_length("bm"))).first()[0]
    assert stored <= 2 * 8 * len(rows) and stored * 100 < dense
