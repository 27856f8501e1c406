"""Physical plans of the registered queries."""

import pytest

from tests.conftest import DATA
from towerlens.operators import flow, latest, persona, skew
from towerlens.plans import inputs
from towerlens.plans.catalog import QUERIES

SF = f"{DATA}/sf0.001"

# Queries whose last step has one row or a few by definition.
SINGLE_ROW = {
    "parse_reject_count",
    "heatmap_totals",
    "portrait_region_hour_count",
    "stored_text_heatmap",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(query(spark, SF)) for name, query in QUERIES.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_and_no_single_task(plans, name):
    plan = plans[name]
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name not in SINGLE_ROW:
        main = plan.split("+- == Initial Plan ==")[0]
        # The scalar horizon of the stays is a one-row aggregate in a subquery.
        assert main.count("SinglePartition") <= main.count("Subquery")


def test_hour_filter_reaches_the_scan(plans):
    assert "GreaterThanOrEqual(ts," in plans["scan_signal_hour"]
    assert "GreaterThanOrEqual(ts," in plans["portrait_region_hour_count"]


def test_scans_read_only_needed_columns(plans):
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plans["region_hour_count"]
    assert "ReadSchema: struct<c_custkey:bigint>" in plans["user_age_band"]


def test_newest_per_region_is_cut_before_the_shuffle(plans):
    assert plans["latest_per_region"].count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plans["latest_flow_events"]


def test_signals_shrink_before_they_meet_the_index(plans):
    plan = plans["region_hour_users_inner"]
    index_join = plan.index("BroadcastHashJoin [imsi")
    assert plan.index("HashAggregate", index_join) > index_join


def test_forced_heavy_forms_scan_the_signals_once(plans):
    for name in ("region_hour_users_skewed", "flow_events_skewed"):
        main = plans[name].split("== Initial Plan ==")[0]
        assert main.count("events.parquet") == 1 and "Union" not in main
        assert "_salt" in main


def test_reject_counts_read_the_signals_once(plans):
    assert plans["parse_reject_count"].split("== Initial Plan ==")[0].count("events.parquet") == 1


def test_visits_need_one_shuffle(spark):
    changes = flow.region_changes(
        persona.user_region_flow(
            inputs.signal(spark, SF),
            inputs.user_info(spark, SF),
            inputs.region_cell(spark, SF).select("region_id", "laccell"),
        )
    )
    assert plan_of(changes).count("Exchange hashpartitioning") == 1


def test_sliced_visits_read_the_signals_once(spark):
    signal = inputs.signal(spark, SF)
    cells = latest.cell_map(inputs.region_cell(spark, SF), "line_no")
    heavy = skew.heavy_keys(signal, "imsi", floor=20)
    placed = persona.user_region_flow(signal, inputs.user_info(spark, SF), cells, heavy)
    plan = plan_of(flow.region_changes(placed, heavy))
    assert plan.count("events.parquet") == 1
    assert "Union" not in plan
