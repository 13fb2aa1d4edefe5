"""Stored tables of the mapped views whose files have gone."""

import os

import pytest

from gridcast.plans import catalog  # noqa: F401
from gridcast.plans.fixtures import Tables
from gridcast.plans.registry import runner
from gridcast.session import drop, drop_staged

FOLDER = os.environ.get("GRIDCAST_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(autouse=True)
def tables():
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")


def one_file(spark):
    os.remove(Tables(spark, FOLDER).games().inputFiles()[0].removeprefix("file:").replace("///", "/"))


@pytest.mark.parametrize("clean", [drop_staged, lambda spark: drop(Tables(spark, FOLDER).games()), one_file], ids=["all", "games", "one file"])
@pytest.mark.parametrize("name", ["a10_league_points", "a14_turnovers_committed", "c5_carryover_fit"])
def test_queries_run_after_the_staged_files_have_gone(spark, clean, name):
    first = sorted(runner(name)(spark, FOLDER).collect())
    clean(spark)
    assert sorted(runner(name)(spark, FOLDER).collect()) == first


def test_stored_tables_are_written_once(spark):
    assert Tables(spark, FOLDER).games().inputFiles() == Tables(spark, FOLDER).games().inputFiles()
