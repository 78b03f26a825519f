"""Every query with SQL gives the SQL's rows; the others run and are checked below and in test_operators."""

from __future__ import annotations

import oracle
import pytest

from skyloom.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert oracle.differences(spark, QUERIES[name], ORACLE[name], SF, con) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["tile_id", "y", "x", "oid", "ndvi", "n"]


@pytest.mark.parametrize("name", ["j06_weather_near_acquisitions", "j07_before_and_after_events", "j08_interval_of_observations", "j10_points_in_boxes", "j11_pixels_in_polygons", "n01_dilate"])
def test_range_and_spatial_joins_have_an_equi_key(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["s01_load_wanted_features"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
