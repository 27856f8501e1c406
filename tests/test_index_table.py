"""The bucketed user index: loads, reruns, plans."""

import random

from towerlens.sinks.index_table import IndexTable


def users(spark, names):
    return spark.createDataFrame([(n, 1) for n in names], "imsi string, x int")


def ids(index):
    return {r.imsi: r.bitmap_id for r in index.read().collect()}


def test_loads_add_dense_ids_and_move_none(spark, tmp_path):
    rng = random.Random(1)
    index = IndexTable(spark, str(tmp_path), buckets=4)
    seen, expected = set(), {}
    for load in range(4):
        names = [f"u{rng.randrange(60)}" for _ in range(40)] + ([None] if load else [])
        index.load(users(spark, names), f"load{load}")
        new = sorted({n for n in names if n is not None} - seen)
        expected.update({n: len(expected) + 1 + i for i, n in enumerate(new)})
        seen |= set(new)
        assert ids(index) == expected
    index.load(users(spark, ["u1"]), "nothing new")
    index.load(users(spark, []), "empty")
    assert ids(index) == expected and index.loads().count() == 6


def test_a_failed_load_takes_its_ids_again(spark, tmp_path):
    index = IndexTable(spark, str(tmp_path), buckets=2)
    index.load(users(spark, ["b", "a"]), "1")
    noted = spark.createDataFrame([("2", 3, 4)], "load string, first bigint, last bigint")
    # As left by a load that noted its ids and was lost before it wrote them.
    noted.write.mode("append").parquet(f"{tmp_path}/loads")
    for _ in range(2):
        index.load(users(spark, ["d", "c", "a"]), "2")
    index.load(users(spark, ["e"]), "3")
    assert ids(index) == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5}


def test_a_load_that_grew_takes_new_ids(spark, tmp_path):
    index = IndexTable(spark, str(tmp_path), buckets=2)
    index.load(users(spark, ["a", "b"]), "1")
    index.load(users(spark, ["c"]), "2")
    for _ in range(2):
        index.load(users(spark, ["a", "b", "x"]), "1")
    index.load(users(spark, ["y"]), "3")
    assert ids(index) == {"a": 1, "b": 2, "c": 3, "x": 4, "y": 5}


def test_a_later_session_reads_the_files(spark, tmp_path):
    IndexTable(spark, str(tmp_path), buckets=2).load(users(spark, ["a"]), "1")
    again = IndexTable(spark, str(tmp_path), buckets=2)
    again.load(users(spark, ["b"]), "2")
    assert ids(again) == {"a": 1, "b": 2}


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = IndexTable(spark, str(tmp_path), buckets=4)
    index.load(users(spark, ["a", "b"]), "1")
    plan = index.unseen(users(spark, ["b", "c"]))._jdf.queryExecution().executedPlan().toString()
    scan = plan.split("SortMergeJoin")[1].split("FileScan")[0].rsplit("LocalTableScan", 1)[-1].rsplit("ExistingRDD", 1)[-1]
    assert "Exchange" not in scan and "Bucketed: true" in plan and "SelectedBucketsCount: 4 out of 4" in plan
