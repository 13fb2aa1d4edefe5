"""Registered queries against their SQL: all of them, or with GRIDCAST_CORE=1 a part that touches every operator module."""

import os

import oracle
import pytest

from gridcast.plans import catalog  # noqa: F401
from gridcast.plans.registry import REGISTRY, runner

FOLDER = os.environ.get("GRIDCAST_TEST_DATA", "/root/testdata/sf0.001")
CORE = [
    "walk_forward_brier", "a1_asof_points", "a8_strength_timeline", "a15_turnover_form", "f6_sos_forecast", "f8_calibrated_forecast",
    "e4_reliability_bins", "e6_metric_set", "e8_walk_forward", "e11_margin_walk_forward", "e18_paired_significance", "e20_scorecard",
    "c4_turnover_points_fit", "p1_player_usage", "p3_usual_starters", "p4_category_prior", "p7_player_impact", "p10_confirmation",
    "p11_availability", "w1_win_totals", "w9_combined_outcomes", "v6_pick_resolution", "g1_value", "g4_momentum", "g5_backtest",
    "s1_append_snapshots", "s5_versioned_load", "s6_lineage", "s7_scoreboard", "s12_latest_snapshot", "v3_season_coverage", "v4_canonical_teams",
]
NAMES = CORE if os.environ.get("GRIDCAST_CORE") else list(REGISTRY)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    ok, message = oracle.compare(runner(name)(spark, FOLDER), con, REGISTRY[name].sql)
    assert ok, message


def test_every_query_has_sql():
    assert [n for n, e in REGISTRY.items() if e.sql is None] == []
