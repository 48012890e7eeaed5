"""Shapes of the physical plans, without the help that small tables give."""

import re

import pytest

from framequill.plans import registry

#: Most exchanges of plans that need more than three.
MANY = {"certificate_status": 4, "stage_order": 6, "sheet_frames": 4, "pilot_binding": 6}


@pytest.fixture(scope="module")
def unaided(spark):
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_plan(unaided, sf_dir, name):
    plan = registry.QUERIES[name](unaided, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert len(re.findall(r"\bExchange\b", plan)) <= MANY.get(name, 3)


def test_filters_and_columns_reach_the_scan(unaided, sf_dir):
    plan = lambda name: registry.QUERIES[name](unaided, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in re.search(r"ReadSchema: struct<([^>]*)", plan("evidence_coverage"))[1]
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,F\)", plan("pilot_lookup"))
    assert re.search(r"ReadSchema: struct<([^>]*)", plan("direction_frame"))[1] == "event_id:bigint,value:double"


def test_ring_report_costs_one_exchange(unaided, sf_dir):
    plan = registry.QUERIES["ring_seam_report"](unaided, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and len(re.findall(r"\bSort\b", plan)) == 1
