"""The paths for heavy keys give the rows of the plain paths."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.helpers import rows_of
from towerlens.operators import latest, persona, region_hours, sampling, skew, user_index
from towerlens.plans import inputs

SF = f"{DATA}/sf0.001"


def fact_and_dim(spark):
    fact = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 20).cast("string")))
        .alias("key"),
        "id",
    )
    dim = spark.range(18).select(
        F.when(F.col("id") < 2, "hot")
        .otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))
        .alias("key"),
        (F.col("id") * 10).alias("value"),
    )
    return fact, dim


def test_heavy_keys(spark):
    fact, _ = fact_and_dim(spark)
    assert [r.key for r in skew.heavy_keys(fact, "key", floor=200).collect()] == ["hot"]
    assert skew.heavy_keys(fact, "key", floor=400) is None
    assert skew.heavy_keys(fact, "key") is None


def test_heavy_keys_of_two_columns_in_one_pass(spark):
    fact, _ = fact_and_dim(spark)
    both = fact.withColumn("half", F.col("id") % 2)
    found = skew.heavy_keys_of(both, ("key", "half", "id"), floor=200)
    assert [r.key for r in found[0].collect()] == ["hot"]
    assert sorted(r.half for r in found[1].collect()) == [0, 1] and found[2] is None
    assert found[1].schema["half"].dataType == both.schema["half"].dataType
    assert skew.heavy_keys_of(both, ("key", "half")) == (None, None)


def test_lookup_join_paths_agree(spark):
    fact, dim = fact_and_dim(spark)
    heavy = skew.heavy_keys(fact, "key", floor=200)
    for how in ("inner", "left"):
        plain = rows_of(fact.join(dim, "key", how), "key", "id", "value")
        for limit in (None, 0):
            got = skew.lookup_join(fact, dim, "key", how, heavy, limit)
            assert rows_of(got, "key", "id", "value") == plain


def test_heavy_rows_are_dealt_out_in_one_scan_and_join(spark):
    fact, dim = fact_and_dim(spark)
    heavy = skew.heavy_keys(fact, "key", floor=200)
    limit = skew.measured_bytes(dim) - 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.lookup_join(fact, dim, "key", "inner", heavy, limit)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    main = plan.split("== Initial Plan ==")[0]
    assert main.count("SortMergeJoin") == 1 and "Union" not in plan and "_salt" in plan


def test_measured_bytes_grows_with_text(spark):
    short = spark.range(10).select(F.lit("a").alias("t"))
    long = spark.range(10).select(F.repeat(F.lit("a"), F.lit(1000)).alias("t"))
    assert skew.measured_bytes(long) - skew.measured_bytes(short) == 10 * 999
    assert skew.measured_bytes(short.where("false")) == 0


@pytest.mark.parametrize("limit", [0, skew.BROADCAST_BYTES])
def test_region_hours_with_heavy_cells(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
    signal, cells = inputs.signal(spark, SF), inputs.region_cell(spark, SF)
    index = user_index.dense_ids(inputs.user_info(spark, SF))
    heavy = skew.heavy_keys(signal, "laccell", floor=33)
    assert heavy is not None
    names = ("region_id", "produce_hour", "bitmap_id")
    for how in ("left", "inner"):
        plain = region_hours.region_hour_members(signal, cells, index, how)
        split = region_hours.region_hour_members(signal, cells, index, how, heavy)
        assert rows_of(plain, *names) == rows_of(split, *names)


@pytest.mark.parametrize("limit", [0, skew.BROADCAST_BYTES])
def test_flow_with_heavy_users_and_cells(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
    signal = inputs.signal(spark, SF)
    users = inputs.user_info(spark, SF)
    cells = latest.cell_map(inputs.region_cell(spark, SF), "line_no")
    plain = persona.user_region_flow(signal, users, cells)
    split = persona.user_region_flow(
        signal,
        users,
        cells,
        skew.heavy_keys(signal, "imsi", floor=20),
        skew.heavy_keys(signal, "laccell", floor=33),
    )
    names = ("event_id", "imsi", "region_id", "gender", "age")
    assert rows_of(plain, *names) == rows_of(split, *names)


def test_adjacent_repeats_across_slices(spark):
    values = "aabbbaaccaaaabcddddda"
    frame = spark.createDataFrame(list(enumerate(values)), "seq long, v string")
    wanted = [
        (n, v) for n, v in enumerate(values) if n == 0 or values[n - 1] != v
    ]
    for slices in (None, 1, 3, 20):
        got = sampling.drop_adjacent_repeats(frame, "seq", "v", slices)
        assert sorted(map(tuple, got.collect())) == wanted
    # The order may be a struct, such as that of lines in files, and as sparse as it likes.
    nested = frame.select(F.struct(F.lit("f").alias("file"), (F.col("seq") * 10**9).alias("n")).alias("at"), "v")
    got = sampling.drop_adjacent_repeats(nested, "at", "v", 4)
    assert sorted((r["at"]["n"] // 10**9, r.v) for r in got.collect()) == wanted


def test_sample_is_whole_when_small_and_stable(spark):
    frame = spark.range(30).select(F.concat(F.lit("R"), F.col("id").cast("string")).alias("r"))
    assert sampling.uniform_sample(frame, 50, ["r"]).count() == 30
    first = rows_of(sampling.uniform_sample(frame, 5, ["r"], seed=1), "r")
    assert first == rows_of(sampling.uniform_sample(frame.repartition(5), 5, ["r"], seed=1), "r")
    assert len(first) == 5
    assert first != rows_of(sampling.uniform_sample(frame, 5, ["r"], seed=2), "r")
