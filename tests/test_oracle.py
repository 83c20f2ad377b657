"""Registered queries against DuckDB on the smallest tables. CURBWATCH_FULL=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
FEW = ["rank_cameras_per_city", "w1_rolling_median", "w2_hour_of_week_cell", "j4_incident_cameras", "t7_quiet_stretch", "a2_city_pulse",
       "a1_region_median", "j1_snap_cameras", "s1_caltrans_feed", "a20_evaluation", "w8_wall_tiers", "e5_kendall_tau"]
PLANS, SQL = entry.queries(), entry.oracle_sql()
NAMES = sorted(SQL) if os.environ.get("CURBWATCH_FULL") else FEW


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(PLANS)
    assert entry.FLAGSHIP in PLANS


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, note = compare(PLANS[name](spark, FOLDER), con, SQL[name])
    assert ok, note


def test_entry_is_small_and_stable(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["region_id", "rank", "camera_id"]
    assert df.count() > 0
