"""Trials packed as bits give the records and hits of one row per game and trial."""

from pyspark.sql import functions as F

from gridcast.operators import season

TRIALS = 130


def remaining(spark):
    rows = [(i, 2020 + i % 2, i % 5, 5 + i % 3, None if i == 11 else (i % 11) / 10) for i in range(60)]
    return spark.createDataFrame(rows, "game_id long, season_year int, home_team_id int, away_team_id int, p double")


def test_bits_are_the_draws(spark):
    df = remaining(spark)
    rows = {}
    for r in season.trial_outcomes(df, TRIALS, 3).collect():
        rows.setdefault(r["game_id"], {})[r["trial"]] = r["winner_id"] == r["home_team_id"]
    packed = season.trial_outcomes(df.repartition(3), TRIALS, 3, packed=True).collect()
    assert len(packed) == 60
    for r in packed:
        bits = "".join(f"{b:08b}" for b in r["home_wins"])[:TRIALS]
        assert [b == "1" for b in bits] == [rows[r["game_id"]][t] for t in range(TRIALS)]


def test_records_from_bits(spark, monkeypatch):
    df = remaining(spark)
    base = df.select("season_year", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).distinct()
    base = base.withColumns({c: F.lit(n).cast("bigint") for c, n in (("wins", 2), ("losses", 1), ("ties", 1))})
    shown = lambda outcomes: sorted(tuple(r) for r in season.trial_records(outcomes, base, TRIALS).select("season_year", "trial", "team_id", "wins", "losses", "win_rate").collect())
    rows = shown(season.trial_outcomes(df, TRIALS, 3))
    packed = season.trial_outcomes(df, TRIALS, 3, packed=True)
    assert shown(packed) == rows
    plan = season.trial_records(packed, base, TRIALS)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan
    monkeypatch.setattr(season, "_GROUPS", 2)
    assert shown(season.trial_outcomes(df, TRIALS, 3, packed=True)) == rows


def test_joint_hits_from_bits(spark, monkeypatch):
    pick = F.when(F.col("game_id") % 4 == 0, F.col("away_team_id")).when(F.col("game_id") == 21, F.lit(99)).when(F.col("game_id") != 13, F.col("home_team_id"))
    df = remaining(spark).withColumn("set_id", F.col("game_id") % 23).withColumn("picked_id", pick)
    hits = season.trial_outcomes(df, TRIALS, 3).groupBy("set_id", "trial").agg(F.min((F.col("winner_id") == F.col("picked_id")).cast("bigint")).alias("hit"))
    rows = {r[0]: r[1] for r in hits.groupBy("set_id").agg(F.sum("hit")).collect()}
    for groups in (1000, 0):
        monkeypatch.setattr(season, "_GROUPS", groups)
        found = {r["set_id"]: r["hits"] for r in season._joint_hits(season.trial_outcomes(df, TRIALS, 3, packed=True), TRIALS).collect()}
        assert found == {k: TRIALS if v is None else v for k, v in rows.items()}
