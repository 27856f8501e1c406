"""Check values of the fixture views at sf0.01, written down when the fixtures were made."""

from pyspark.sql import functions as F

from tests.conftest import DATA
from towerlens.operators import portraits
from towerlens.plans import catalog
from towerlens.plans.catalog import QUERIES

SF = f"{DATA}/sf0.01"


def count(spark, name, where="true"):
    return QUERIES[name](spark, SF).where(where).count()


def counts(spark, name, *keys):
    rows = QUERIES[name](spark, SF).groupBy(*keys).count().collect()
    return {tuple(r[k] for k in keys): r["count"] for r in rows}


def test_inputs(spark):
    signal = QUERIES["scan_signal"](spark, SF)
    totals = signal.agg(F.count("*"), F.count_distinct("laccell"), F.sum("start_ms")).first()
    assert tuple(totals) == (10_000, 30, 17053619445353579)
    # The fixture's subscribers lack every tenth customer; the scan and index queries have them all.
    assert catalog._index(spark, SF).count() == 1350
    assert count(spark, "user_index") == count(spark, "scan_user_info") == 1500
    rejects = {r.input: (r.n_ok, r.n_rejected) for r in QUERIES["parse_reject_count"](spark, SF).collect()}
    assert rejects["signal"] == (9896, 104)


def test_sets(spark):
    assert count(spark, "region_hour_users") == 9222
    assert count(spark, "region_hour_users", "bitmap_id is not null") == 8570
    assert count(spark, "region_hour_count") == 3894
    members = portraits.portrait_members(catalog._labelled(spark, SF))
    sizes = {r.portrait_id: r.n_users for r in portraits.portrait_sizes(members).collect()}
    assert sizes == {1: 534, 2: 666, 3: 149, 4: 301, 5: 750}
    for route in ("portrait_region_hour_matrix", "bitmap_and_count"):
        matrix = QUERIES[route](spark, SF)
        numbers = (F.count("*"), F.sum("n_users"), F.max("n_users"))
        assert tuple(matrix.agg(*numbers).first()) == (10_213, 15_268, 6)
        assert tuple(matrix.where("region_id is not null").agg(*numbers).first()) == (
            8_543,
            12_786,
            6,
        )
    assert QUERIES["portrait_region_hour_count"](spark, SF).first().n_users == 6


def test_visits(spark):
    assert count(spark, "user_region_flow") == 7516
    assert count(spark, "region_visits") == 1821
    assert counts(spark, "flow_events", "event_type", "region_id") == {
        (0, "R0"): 581, (0, "R2"): 587, (0, "R3"): 587,
        (1, "R0"): 597, (1, "R2"): 612, (1, "R3"): 612,
    }
    assert counts(spark, "stay_events", "event_type", "region_id") == {
        (2, "R0"): 339, (2, "R2"): 326, (2, "R3"): 326,
        (3, "R0"): 336, (3, "R2"): 323, (3, "R3"): 324,
    }
    running = QUERIES["stay_running_total"](spark, SF)
    assert tuple(running.agg(F.count("*"), F.min("stay_count"), F.max("stay_count")).first()) == (
        1974, 0, 15,
    )
    totals = {r.region_id: r.stay_count for r in QUERIES["stay_total"](spark, SF).collect()}
    assert totals == {"R0": 3, "R2": 3, "R3": 2}


def test_live_counters(spark):
    windows = QUERIES["region_persona_window"](spark, SF)
    names = ("man", "women", "age_10_20", "age_20_40", "age_40", "pep_cnt")
    assert tuple(windows.agg(F.count("*"), *[F.sum(n) for n in names]).first()) == (
        3080, 3356, 4160, 791, 1734, 4161, 7516,
    )
