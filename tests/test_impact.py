"""Bootstrap means of players' production, and what the joins around them may send to the driver."""

import hashlib
from datetime import datetime

import pytest

from gridcast.operators import players

R, SEED = 20, 7
KEYS = "team_id int, season_year int, player_id long, category string"


def place(games, replicate, slot):
    return int(int(hashlib.md5(f"{SEED}|{replicate}|{slot}".encode()).hexdigest()[:13], 16) / 2**52 * games)


@pytest.mark.parametrize("weights", [4_000_000, 30])
def test_means_of_drawn_games(spark, monkeypatch, weights):
    monkeypatch.setattr(players, "_WEIGHTS", weights)
    monkeypatch.setattr(players, "_STATES", 3)
    # two lines at the last kickoff but one: the smaller game comes first
    lines = [(1, 2020, p, c, datetime(2020, 9, 1 + min(i, 8)), 100 - i if i == 8 else i, float((i * p) % 11)) for p in (5, 6) for c in ("passing", "rushing") for i in range(10)]
    scored = spark.createDataFrame(lines, KEYS + ", kickoff_at timestamp_ntz, game_id long, score double").repartition(4)
    states = [(1, 2020, 5, "passing", g) for g in (1, 2, 9, 10)] + [(1, 2020, 6, "rushing", g) for g in (2, 10, 10)]
    found = players.resampled_means(spark.createDataFrame(states, KEYS + ", games long"), scored, R, SEED)
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["player_id"], r["category"], r["games"]): r["resampled_means"] for r in found.collect()}
    assert set(got) == {(s[2], s[3], s[4]) for s in states}
    for (player, category, games), means in got.items():
        scores = [line[6] for line in sorted(lines, key=lambda line: (line[4], line[5])) if line[2] == player and line[3] == category]
        assert means == pytest.approx([sum(scores[place(games, r, s)] for s in range(games)) / games for r in range(R)])


def test_box_scores_are_not_broadcast(spark, tmp_path):
    """A row for every stat line there is: however small its files look, it is not sent to the driver."""
    path = str(tmp_path / "lines")
    spark.createDataFrame([(1, 5, "x"), (2, 6, "y")], "game_id long, player_id long, stat string").write.parquet(path)
    starters = spark.createDataFrame([(1, 5), (1, 6), (3, 5)], "game_id long, player_id long")
    absent = players.missing_from_box_score(starters, spark.read.parquet(path))
    assert "Broadcast" not in absent._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, absent.collect())) == [(1, 6), (3, 5)]


def test_lines_are_scored_before_they_are_joined(spark):
    """What the join shuffles is a score, not the texts of a line."""
    lines = spark.createDataFrame([(1, 3, 5, "passing", ["YDS"], ["250"])], "game_id long, team_id int, player_id long, stat_category string, stat_labels array<string>, stat_values array<string>")
    games = spark.createDataFrame([(1, 2020, datetime(2020, 9, 1))], "game_id long, season_year int, kickoff_at timestamp_ntz")
    found = players.scored_statlines(lines.hint("merge"), games)
    top = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "stat_values" not in top and [r["score"] for r in found.collect()] == [10.0]
