"""Files in, tables out: readers, parsers, the user index, portraits, region hours, sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.helpers import rows_of
from towerlens import session
from towerlens.operators import portraits, region_hours, user_index
from towerlens.plans import batch, inputs, serving
from towerlens.sinks import tables as sink
from towerlens.sources import files, lines, streams, tables

SF = f"{DATA}/sf0.001"
USERS = "imsi string, gender string, age int"


def write_text(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


# ---- readers -----------------------------------------------------------------------------------


def test_read_signal(spark, tmp_path):
    path = write_text(
        tmp_path / "xdr.txt",
        "u1|c1|39.958087|116.296185|1670468511000\nu2|c2|x|116.3|1670468511999\n",
    )
    got = files.read_signal(spark, path).orderBy("imsi").collect()
    assert got[0].asDict() == {
        "imsi": "u1",
        "laccell": "c1",
        "latitude": 39.958087,
        "longitude": 116.296185,
        "start_ms": 1670468511000,
        "event_ts": dt.datetime(2022, 12, 8, 3, 1, 51),
    }
    assert got[1].latitude is None and got[1].start_ms == 1670468511999


def test_read_signal_hour_prunes_folders(spark, tmp_path):
    for hour in ("2024010100", "2024010101"):
        folder = tmp_path / f"produce_hour={hour}"
        folder.mkdir()
        write_text(folder / "part.txt", f"u{hour}|c1|1.0|2.0|1704067200000\n")
    got = files.read_signal_hour(spark, str(tmp_path), "2024010101")
    assert rows_of(got, "imsi") == [("u2024010101",)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(produce_hour" in plan


def test_read_dimensions(spark, tmp_path):
    users = write_text(tmp_path / "users.txt", "u1|0|18\nu2|1|40\n")
    cells = write_text(tmp_path / "cells.txt", "R1|c1\nR2|c2\n")
    places = write_text(tmp_path / "places.txt", "c1|23.24947|113.33808\n")
    watch = write_text(tmp_path / "watch.txt", " R1 \n\nR2\n")
    assert rows_of(files.read_user_info(spark, users), "imsi", "gender", "age") == [
        ("u1", "0", 18),
        ("u2", "1", 40),
    ]
    assert rows_of(files.read_region_cell(spark, cells), "region_id", "laccell") == [
        ("R1", "c1"),
        ("R2", "c2"),
    ]
    assert files.read_cell_loc(spark, places).first().latitude == 23.24947
    assert rows_of(files.read_target_region(spark, watch), "region_id") == [("R1",), ("R2",)]


def test_lines_keep_file_order(spark, tmp_path):
    path = write_text(tmp_path / "many.txt", "".join(f"{n}\n" for n in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = files.read_lines(spark, path)
        assert got.rdd.getNumPartitions() > 3
        assert [r.line for r in got.orderBy("line_no").collect()] == [str(n) for n in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_region_centers(spark, tmp_path):
    from towerlens.operators.latest import last_per_key

    path = write_text(
        tmp_path / "centers.txt",
        "R1|1,2|0,0;0,1;1,1|old\nR2|5,6|0,0\nR1|3,4|0,0;2,2|new|extra\nR1|3,4|0,0;2,2|new\n",
    )
    parsed = lines.parse_region_center(files.read_lines(spark, path))
    good = lines.accepted(parsed).drop("line")
    row = last_per_key(good, ["region_id"], "line_no").collect()
    assert len(row) == 1
    assert (row[0].region_id, row[0].name) == ("R1", "new")
    assert row[0].center == [3.0, 4.0] and row[0].boundary == [[0.0, 0.0], [2.0, 2.0]]
    assert lines.rejected(parsed).count() == 2


@pytest.mark.parametrize(
    "parser, text, wanted",
    [
        (lines.parse_signal, "u|c|1.5|2.5|7", True),
        (lines.parse_signal, "u|c|1.5|2.5|7|more", True),
        (lines.parse_signal, "u|c|1.5|2.5", False),
        (lines.parse_signal, "u|c|1.5|north|7", False),
        (lines.parse_signal, "", False),
        (lines.parse_signal_cell, "u|c", True),
        (lines.parse_signal_cell, "u", False),
        (lines.parse_user_info, "u|0|18", True),
        (lines.parse_user_info, "u|0|-1", False),
        (lines.parse_user_info, "u|0|old", False),
        (lines.parse_user_info, "u|0", False),
        (lines.parse_region_cell, "R|c", True),
        (lines.parse_region_cell, "R", False),
    ],
)
def test_parsers_reject_and_go_on(spark, parser, text, wanted):
    frame = spark.createDataFrame([(text,), ("",)], "line string")
    assert parser(frame).where(F.col("line") == text).first().is_valid is wanted


def test_options(spark):
    options = tables.jdbc_options("jdbc:x://host/db", "USER_INDEX", user="u", fetchsize=1000)
    assert options == {
        "url": "jdbc:x://host/db",
        "dbtable": "USER_INDEX",
        "user": "u",
        "fetchsize": "1000",
    }
    kafka = streams.kafka_options("h:9092", "xdr", "earliest", group="g")
    assert kafka["startingOffsets"] == "earliest" and kafka["kafka.group.id"] == "g"
    assert kafka["subscribe"] == "xdr"


def test_query_takes_named_parameters(spark):
    tables.register(numbers=spark.range(5))
    got = tables.query(spark, "SELECT count(*) AS n FROM numbers WHERE id >= :low", low=3)
    assert got.first().n == 2


# ---- user index --------------------------------------------------------------------------------


def test_ids_are_dense_distinct_and_ordered(spark):
    frame = spark.range(5000).select(F.md5((F.col("id") % 3001).cast("string")).alias("imsi"))
    got = user_index.dense_ids(frame.unionByName(spark.createDataFrame([(None,)], "imsi string")))
    rows = sorted(got.collect(), key=lambda r: r.bitmap_id)
    assert [r.bitmap_id for r in rows] == list(range(1, 3002))
    assert [r.imsi for r in rows] == sorted(r.imsi for r in rows)


def test_ids_of_empty_input(spark):
    assert user_index.dense_ids(spark.createDataFrame([], USERS)).count() == 0


def test_index_grows_without_moving(spark, tmp_path):
    path = str(tmp_path / "index")
    first = spark.createDataFrame([("b", "0", 1), ("d", "0", 1)], USERS)
    batch.build_user_index(first, path)
    before = rows_of(spark.read.parquet(path), "imsi", "bitmap_id")
    second = spark.createDataFrame([("a", "0", 1), ("b", "0", 1), ("e", "0", 1)], USERS)
    batch.build_user_index(second, path, existing=spark.read.parquet(path))
    after = rows_of(spark.read.parquet(path), "imsi", "bitmap_id")
    assert before == [("b", 1), ("d", 2)]
    assert after == [("a", 3), ("b", 1), ("d", 2), ("e", 4)]


# ---- portraits ---------------------------------------------------------------------------------

PEOPLE = [
    ("u09", "1", 9),
    ("u10", "1", 10),
    ("u19", "0", 19),
    ("u20", "1", 20),
    ("u39", "0", 39),
    ("u40", "1", 40),
    ("odd", "2", 50),
    ("odd", "2", 50),
    ("new", "1", 30),
    ("none", "1", None),
]


def portrait_sets(spark, scheme, kinds=("gender", "age")):
    people = spark.createDataFrame(PEOPLE, USERS)
    index = user_index.dense_ids(people.where("imsi <> 'new'"))
    labelled = portraits.user_portraits(people, index, scheme)
    rows = portraits.portrait_members(labelled, scheme, kinds).join(index, "bitmap_id").collect()
    found = {}
    for row in rows:
        found.setdefault((row.portrait_id, row.portrait_value), []).append(row.imsi)
    return {key: sorted(names) for key, names in found.items()}


def test_standard_portraits(spark):
    wanted_gender = {(1, "1"): ["u10", "u20", "u40"], (2, "0"): ["u19", "u39"]}
    wanted_age = {
        (3, "10"): ["u10", "u19"],
        (4, "20"): ["u20", "u39"],
        (5, "40"): ["odd", "u40"],
    }
    assert portrait_sets(spark, portraits.STANDARD) == {**wanted_gender, **wanted_age}
    assert portrait_sets(spark, portraits.STANDARD, ("gender",)) == wanted_gender
    assert portrait_sets(spark, portraits.STANDARD, ("age",)) == wanted_age


def test_alternative_portraits(spark):
    assert portrait_sets(spark, portraits.CLOSED_UPPER) == {
        (1, "boy"): ["none", "u09", "u10", "u20", "u40"],
        (2, "girl"): ["u19", "u39"],
        (None, "none"): ["odd"],
        (3, "age20down"): ["u09", "u10", "u19", "u20"],
        (4, "age20-40"): ["u39", "u40"],
        (5, "age40up"): ["odd"],
    }


def test_portrait_table_is_replaced(spark, tmp_path):
    path = str(tmp_path / "portraits")
    people = spark.createDataFrame(PEOPLE, USERS)
    index = user_index.dense_ids(people)
    for _ in range(2):
        batch.build_portraits(people, index, path)
    # Five people with two labels, "odd" with its age label, "new" with two.
    assert spark.read.parquet(path).count() == 13


# ---- region hours ------------------------------------------------------------------------------


def test_cell_of_two_regions_counts_in_both(spark):
    signal = spark.createDataFrame(
        [("u1", "c1", dt.datetime(2024, 1, 1, 5, 30)), ("u1", "c1", dt.datetime(2024, 1, 1, 5, 40)),
         ("who", "c1", dt.datetime(2024, 1, 1, 5)), ("u1", "lost", dt.datetime(2024, 1, 1, 6))],
        "imsi string, laccell string, event_ts timestamp",
    )
    cells = spark.createDataFrame([("A", "c1"), ("B", "c1")], "region_id string, laccell string")
    index = spark.createDataFrame([("u1", 1)], "imsi string, bitmap_id long")
    left = region_hours.region_hour_members(signal, cells, index)
    assert rows_of(left, "region_id", "produce_hour", "bitmap_id") == [
        ("A", "2024010105", 1), ("A", "2024010105", None),
        ("B", "2024010105", 1), ("B", "2024010105", None),
        (None, "2024010106", 1),
    ]
    inner = region_hours.region_hour_members(signal, cells, index, how="inner")
    assert rows_of(inner, "region_id", "bitmap_id") == [("A", 1), ("B", 1)]
    only_unknown = region_hours.region_hour_counts(
        region_hours.region_hour_members(signal.where("imsi = 'who'"), cells, index)
    )
    assert rows_of(only_unknown, "region_id", "n_users") == [("A", 0), ("B", 0)]


def test_stragglers_add_to_their_hour(spark, tmp_path):
    path = str(tmp_path / "hours")
    cells = spark.createDataFrame([("A", "c1")], "region_id string, laccell string")
    index = spark.createDataFrame([(f"u{i}", i) for i in range(1, 5)], "imsi string, bitmap_id long")
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    eight = [(f"u{i}", "c1", at(8, i)) for i in (1, 2, 3)] + [("u1", "lost", at(8, 9))]
    nine = [("u4", "c1", at(8, 59)), ("u1", "c1", at(9, 0))]
    schema = "imsi string, laccell string, event_ts timestamp"
    wanted = [
        ("A", "2024010108", 1), ("A", "2024010108", 2), ("A", "2024010108", 3), ("A", "2024010108", 4),
        ("A", "2024010109", 1), (None, "2024010108", 1),
    ]
    for load, rows in (("08", eight), ("09", nine), ("09", nine), ("08", eight)):
        batch.build_region_hours(spark.createDataFrame(rows, schema), cells, index, path, load)
    assert rows_of(sink.read_hours(spark, path), "region_id", "produce_hour", "bitmap_id") == wanted
    # A load that is run again with fewer rows replaces its own rows only.
    batch.build_region_hours(spark.createDataFrame(nine[:1], schema), cells, index, path, "09")
    got = rows_of(sink.read_hours(spark, path), "region_id", "produce_hour", "bitmap_id")
    assert ("A", "2024010108", 4) in got and ("A", "2024010108", 2) in got


def test_hours_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "hours")
    signal, cells = inputs.signal(spark, SF), inputs.region_cell(spark, SF)
    index = user_index.dense_ids(inputs.user_info(spark, SF))
    batch.build_region_hours(signal, cells, index, path, "all")
    first = rows_of(sink.read_hours(spark, path), "region_id", "produce_hour", "bitmap_id")
    hour = sink.read_hours(spark, path).first().produce_hour
    again = inputs.signal(spark, SF, hour)
    assert 0 < again.count() < signal.count()
    batch.build_region_hours(again, cells, index, path, "again")
    second = rows_of(sink.read_hours(spark, path), "region_id", "produce_hour", "bitmap_id")
    assert first == second


def test_loads_replace_their_own_rows(spark, tmp_path):
    path = str(tmp_path / "hours")
    schema = "region_id string, produce_hour string, bitmap_id bigint"
    first = [("A", "2024010108", 1), ("A", "2024010108", 2), (None, "2024010109", None)]
    second = [("A", "2024010108", 2), ("B", "2024010109", 3)]
    for load, rows in (("a", first), ("b", second), ("a", first), ("c", [])):
        sink.overwrite_load(spark.createDataFrame(rows, schema), path, load)
    got = rows_of(sink.read_hours(spark, path), "region_id", "produce_hour", "bitmap_id")
    assert got == sorted({*first, *second}, key=repr)
    sink.overwrite_load(spark.createDataFrame(first[:1], schema), path, "a")
    got = rows_of(sink.read_hours(spark, path), "region_id", "produce_hour", "bitmap_id")
    assert got == sorted({first[0], *second}, key=repr)


def test_an_hour_opens_few_files(spark, tmp_path):
    """Files of a load hold ranges of hours, and the filter on the hour reaches the scan."""
    path = str(tmp_path / "hours")
    signal, cells = inputs.signal(spark, SF), inputs.region_cell(spark, SF)
    index = user_index.dense_ids(inputs.user_info(spark, SF))
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merging)
    spark.conf.set(merging, "false")
    try:
        batch.build_region_hours(signal, cells, index, path, "2024/01 all", write=sink.overwrite_load)
    finally:
        spark.conf.set(merging, before)
    files = spark.read.parquet(path).select(
        "produce_hour", F.input_file_name().alias("file")
    )
    ranges = files.groupBy("file").agg(F.min("produce_hour").alias("a"), F.max("produce_hour").alias("z")).collect()
    assert len(ranges) > 4
    hours = sorted({r.produce_hour for r in files.select("produce_hour").distinct().collect()})
    assert max(sum(r.a <= h <= r.z for r in ranges) for h in hours) <= 2
    assert {r["load"] for r in spark.read.parquet(path).select("load").distinct().collect()} == {"2024/01 all"}
    one = sink.read_hours(spark, path).where(F.col("produce_hour") == hours[0])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(produce_hour,{hours[0]})" in plan
    assert 0 < one.count() < sink.read_hours(spark, path).count()


def test_serving_from_stored_tables(spark, tmp_path):
    """The jobs in their order, then the question, all through files."""
    users = inputs.user_info(spark, SF)
    batch.build_user_index(users, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    batch.build_portraits(users, index, str(tmp_path / "portraits"))
    batch.build_region_hours(
        inputs.signal(spark, SF), inputs.region_cell(spark, SF), index, str(tmp_path / "hours"), "a"
    )
    members = sink.read_hours(spark, str(tmp_path / "hours"))
    groups = spark.read.parquet(str(tmp_path / "portraits"))
    best = (
        members.where("region_id is not null")
        .join(groups, "bitmap_id")
        .groupBy("region_id", "produce_hour", "portrait_id")
        .count()
        .orderBy(F.desc("count"))
        .first()
    )
    where = (best.region_id, best.produce_hour, best.portrait_id)
    assert serving.portrait_user_count(members, groups, *where).first().n_users == best["count"]
    assert serving.portrait_users(members, groups, *where).count() == best["count"]
    assert serving.portrait_user_count(members, groups, "R0", "1999010100", 1).first().n_users == 0
    plan = serving.portrait_users(members, groups, *where)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(produce_hour" in plan
    assert "PushedFilters: [IsNotNull(region_id), EqualTo(region_id," in plan


# ---- keyed tables ------------------------------------------------------------------------------


def test_upsert_keeps_the_newest_and_repeats_safely(spark, tmp_path):
    path, schema = str(tmp_path / "live"), "k string, v int, t int"
    read = lambda: rows_of(sink.read_current(spark, path, schema), "k", "v", "t")
    frame = lambda rows: spark.createDataFrame(rows, schema)
    sink.upsert_slot(spark, frame([("a", 1, 1), ("b", 2, 1)]), path, ["k"], "t", 0)
    assert read() == [("a", 1, 1), ("b", 2, 1)]
    for _ in range(2):
        sink.upsert_slot(spark, frame([("a", 5, 2), ("b", 9, 0)]), path, ["k"], "t", 1)
        assert read() == [("a", 5, 2), ("b", 2, 1)]
    sink.upsert_slot(spark, frame([("c", 7, 3)]), path, ["k"], "t", 2)
    assert read() == [("a", 5, 2), ("b", 2, 1), ("c", 7, 3)]


def test_readers_open_finished_slots_only(spark, tmp_path):
    path, schema = str(tmp_path / "live"), "k string, v int"
    assert sink.read_current(spark, path, schema).collect() == []
    for n in (0, 1):
        sink.replace_slot(spark.createDataFrame([("a", n)], schema), path, n)
    assert rows_of(sink.read_current(spark, path, schema), "k", "v") == [("a", 1)]
    # A batch that is being written has no mark of success yet.
    (tmp_path / "live" / "slot=1" / "_SUCCESS").unlink()
    assert rows_of(sink.read_current(spark, path, schema), "k", "v") == [("a", 0)]


def test_compacted_events_skip_other_days_and_regions(spark, tmp_path):
    rows = [(f"u{i}", i % 2, f"R{i % 5}", "1", 30, dt.datetime(2024, 1, 1 + i % 3, i % 24)) for i in range(300)]
    log = spark.createDataFrame(
        rows, "imsi string, event_type int, region_id string, gender string, age int, event_ts timestamp"
    )
    path = str(tmp_path / "days")
    for _ in range(2):
        sink.compact_events(log.withColumn("batch_id", F.lit(1)), path)
    newest = serving.latest_events(sink.read_events(spark, path, "20240103"), "R2", 50)
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(region_id,R2)" in plan
    wanted = sorted(r[0] for r in rows if r[2] == "R2" and r[5].day == 3)
    assert sorted(r.imsi for r in newest.collect()) == wanted
    assert sink.read_events(spark, path).count() == 300


def test_a_hot_region_fills_many_files(spark, tmp_path):
    log = spark.range(4000).selectExpr(
        "cast(id AS string) AS imsi", "1 AS event_type", "if(id % 10 = 0, 'R1', 'R0') AS region_id", "'1' AS gender", "30 AS age",
        "timestamp_seconds(1704067200 + id) AS event_ts", "0L AS batch_id",
    )
    path = str(tmp_path / "days")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merging)
    spark.conf.set(merging, "false")
    try:
        sink.compact_events(log, path)
    finally:
        spark.conf.set(merging, before)
    rows = sink.read_events(spark, path).withColumn("file", F.input_file_name())
    assert rows.where("region_id = 'R0'").select("file").distinct().count() >= 4
    assert rows.where("region_id = 'R1'").select("file").distinct().count() <= 2
    newest = serving.latest_events(sink.read_events(spark, path), "R0", 3).collect()
    assert sorted(r.imsi for r in newest) == ["3997", "3998", "3999"]


def test_checkpoint_folder_of_this_machine_needs_a_local_master(monkeypatch, tmp_path):
    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, master, named=None):
            self.sparkContext, self.conf = Context(master), {"spark.checkpoint.dir": named}

    local = Session("local[8]")
    session.ensure_checkpoint_dir(local)
    assert "towerlens-checkpoint-" in local.sparkContext.folder
    named = Session("spark://host:7077", "hdfs://x/y")
    session.ensure_checkpoint_dir(named)
    assert named.sparkContext.folder == "hdfs://x/y"
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session("yarn"))


def test_heatmap_of_no_regions_is_zero(spark):
    schema = "region_id string, age_10_20 long, age_20_40 long, age_40 long, man long, women long"
    row = serving.heatmap_totals(spark.createDataFrame([], schema)).first()
    assert tuple(row) == (0, 0, 0, 0, 0)


def test_text_counters_that_are_no_numbers_are_skipped(spark):
    stored = spark.createDataFrame(
        [("R1", "1", "2", "3", "4", "5"), ("R2", "10", "many", None, " 40 ", "50")],
        ["region_id", *serving.TOTALLED],
    )
    row = serving.heatmap_totals(serving.numeric_cells(stored, serving.TOTALLED)).first()
    assert tuple(row) == (11, 2, 3, 44, 55)


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    users = inputs.user_info(spark, SF)
    sink.write_bucketed(users, "users_by_imsi", "imsi", 4, str(tmp_path / "users"))
    sink.write_bucketed(
        user_index.dense_ids(users), "index_by_imsi", "imsi", 4, str(tmp_path / "index")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("users_by_imsi").join(spark.table("index_by_imsi"), "imsi")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == users.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE users_by_imsi")
        spark.sql("DROP TABLE index_by_imsi")
