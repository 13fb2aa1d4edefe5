"""Queries over fits, season projections and market signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast import constants as K
from gridcast.operators import fitting, players, season, signals
from gridcast.plans import sqltext as Q
from gridcast.plans.evaluation_queries import losses
from gridcast.plans.fixtures import Tables
from gridcast.plans.registry import big, cte, q6, query, r6, with_ctes

TRAIN, TEST = [1996, 1997, 1998, 1999], [2000, 2001]
EXPONENTS = [1.5, 2.0, 2.37, 3.0, 4.0]
TRIALS = K.SEASON_TRIALS

# --- fits ------------------------------------------------------------------------------

_grid = ""
for _i in range(4):
    _lo, _hi = ("1.0::DOUBLE", "5.0::DOUBLE") if _i == 0 else (f"(SELECT lo FROM b{_i - 1})", f"(SELECT hi FROM b{_i - 1})")
    _x = f"({_lo} + i * ({_hi} - {_lo}) / 40)"
    _grid += f"""
g{_i} AS MATERIALIZED (SELECT i, {_lo} AS l, {_hi} AS h, min({_x}) AS x, avg(pow({Q.pyth('pf', 'pa', 'cx')} - wins::DOUBLE / games, 2)) AS err
  FROM (SELECT i, {_x} AS cx, pf, pa, wins, games FROM team_seasons, range(41) AS r(i)) AS c GROUP BY i),
b{_i} AS MATERIALIZED (SELECT x, err, l + greatest(i - 1, 0) * (h - l) / 40 AS lo, l + least(i + 1, 40) * (h - l) / 40 AS hi FROM g{_i} ORDER BY err, i LIMIT 1),"""


@query("c1_exponent_fit", with_ctes("WITH " + _grid.rstrip(",") +
    "\nSELECT round(x, 4) AS exponent, round(err, 6) AS mean_squared_error FROM b3"))
def _(t: Tables) -> DataFrame:
    best, error = fitting.fit_exponent(fitting.expected_wins_samples(t.games()))
    return t.spark.createDataFrame([(round(best, 4), round(error, 6))], "exponent double, mean_squared_error double")


def _years(years: list[int]) -> str:
    return f"season_year IN ({', '.join(map(str, years))})"


def _exponent_losses(years: list[int]) -> str:
    p = Q.home_field(Q.log5("hs", "aws"))
    return losses(
        f"(SELECT game_id, is_tie, home_won, x, coalesce(home_reason, away_reason) AS reason, CASE WHEN coalesce(home_reason, away_reason) IS NULL THEN round({p}, 6) END AS p "
        f"FROM (SELECT *, {Q.pyth('home_ppg_for', 'home_ppg_against', 'x')} AS hs, {Q.pyth('away_ppg_for', 'away_ppg_against', 'x')} AS aws "
        f"FROM rated, (VALUES {', '.join(f'({e}::DOUBLE)' for e in EXPONENTS)}) AS e(x) WHERE {_years(years)}) AS q) AS r"
    )


@query("c2_exponent_selection", with_ctes(f"""
WITH train AS (SELECT x, avg(se) AS brier FROM ({_exponent_losses(TRAIN)}) AS l GROUP BY x),
chosen AS (SELECT x FROM train ORDER BY brier, x LIMIT 1)
SELECT train.x AS exponent, {q6('train.brier')} AS train_brier, train.x = (SELECT x FROM chosen) AS chosen,
       CASE WHEN train.x = (SELECT x FROM chosen) THEN {q6(f"(SELECT avg(se) FROM ({_exponent_losses(TEST)}) AS l WHERE l.x = train.x)")} END AS test_brier FROM train"""))
def _(t: Tables) -> DataFrame:
    chosen, scores, report = fitting.select_exponent(t.games(), EXPONENTS, TRAIN, TEST)
    hit = F.col("exponent") == chosen
    return scores.select(
        "exponent", r6("brier", "train_brier"), hit.alias("chosen"), F.when(hit, F.round(report.select("brier").scalar(), 6)).alias("test_brier"))


_gap = ("((coalesce(home_ppg_for, 0) - coalesce(home_ppg_against, 0)) - (coalesce(away_ppg_for, 0) - coalesce(away_ppg_against, 0)))")


@query("c3_home_margin_fit", with_ctes(f"""
SELECT count(*) AS n, {q6(f'avg(home_score - away_score - {_gap})')} AS home_margin_points FROM rated
WHERE {_years(TRAIN)} AND NOT neutral_site AND home_reason IS NULL AND away_reason IS NULL"""))
def _(t: Tables) -> DataFrame:
    return fitting.fit_home_margin(t.games(), TRAIN).select(big("n"), r6("home_margin_points"))


cte("done_games", f"SELECT *, kickoff_at - INTERVAL 24 HOUR AS cutoff FROM games WHERE completed AND {_years(TRAIN)}")
cte("done_probes", "SELECT home_team_id AS team_id, season_year, cutoff FROM done_games UNION SELECT away_team_id, season_year, cutoff FROM done_games")
cte("done_strengths", Q.strengths_sql(Q.rates_sql(f"({Q.totals_sql('done_probes')}) AS dt")))
cte("done_form", """
SELECT p.team_id, p.season_year, p.cutoff, avg(m.turnover_margin) AS turnover_form FROM done_probes AS p
LEFT JOIN margins AS m ON m.team_id = p.team_id AND m.season_year = p.season_year AND m.kickoff_at < p.cutoff AND m.completed
GROUP BY p.team_id, p.season_year, p.cutoff""")
cte("done_rated", Q.both_sides("done_games", "done_strengths", ["ppg_for", "ppg_against", "reason"]))
cte("done_all", Q.both_sides("done_rated", "done_form", ["turnover_form"]))


@query("c4_turnover_points_fit", with_ctes(f"""
SELECT count(*) AS n, {q6('-regr_slope(y, x)')} AS points_per_turnover FROM (
  SELECT home_turnover_form - away_turnover_form AS x, home_score - away_score - {_gap} AS y FROM done_all
  WHERE home_reason IS NULL AND away_reason IS NULL) AS s WHERE x IS NOT NULL"""))
def _(t: Tables) -> DataFrame:
    return fitting.fit_turnover_points(t.games(), t.statlines(), TRAIN).select(big("n"), r6("points_per_turnover"))


@query("c5_carryover_fit", with_ctes(f"""
SELECT count(*) AS n, {q6('regr_slope(b.ppg_for, a.ppg_for)')} AS carry_for, {q6('regr_slope(b.ppg_against, a.ppg_against)')} AS carry_against
FROM team_seasons AS a JOIN team_seasons AS b ON b.team_id = a.team_id AND b.season_year = a.season_year + 1"""))
def _(t: Tables) -> DataFrame:
    return fitting.fit_carryover(t.games()).select(big("n"), r6("carry_for"), r6("carry_against"))


CAL = [1997, 1998, 1999, 2000]
cte("kick_games", f"""
SELECT *, kickoff_at AS cutoff, (home_score > away_score)::INTEGER AS home_won FROM games
WHERE season_type = 'regular' AND completed AND home_score <> away_score AND {_years(CAL)}""")
cte("kick_probes", "SELECT home_team_id AS team_id, season_year, cutoff FROM kick_games UNION SELECT away_team_id, season_year, cutoff FROM kick_games")
cte("kick_totals", Q.totals_sql("kick_probes"))
cte("kick_strengths", Q.calibrated_sql("kick_totals"))
cte("kick_samples", f"""
SELECT season_year, home_won, raw_p AS p, {Q.logit('raw_p')} AS x FROM ({Q.strength_forecast_sql('kick_games', 'kick_strengths')}) AS k WHERE abstain_reason IS NULL""")
_newton = "n0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS a, 1.0::DOUBLE AS b),"
for _i in range(12):
    _newton += f"""
n{_i + 1} AS MATERIALIZED (SELECT a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM (
  SELECT any_value(a) AS a, any_value(b) AS b, sum(q - home_won) AS ga, sum((q - home_won) * x) + 0.001::DOUBLE * any_value(b) AS gb,
         sum(q * (1 - q)) AS haa, sum(q * (1 - q) * x) AS hab, sum(q * (1 - q) * x * x) + 0.001::DOUBLE AS hbb
  FROM (SELECT s.*, a, b, 1 / (1 + exp(-(a + b * x))) AS q FROM kick_samples AS s, n{_i} WHERE season_year < {CAL[-1]}) AS z) AS t),"""


@query("c6_platt_fit", with_ctes(f"WITH {_newton.rstrip(',')}\nSELECT {q6('a')} AS a, {q6('b')} AS b FROM n12"))
def _(t: Tables) -> DataFrame:
    a, b = fitting.fit_platt(fitting.calibration_samples(t.games(), CAL[:-1]))
    return t.spark.createDataFrame([(a, b)], "a double, b double").select(r6("a"), r6("b"))


@query("c7_calibration_selection", with_ctes(f"""
WITH {_newton}
checked AS (SELECT s.*, 1 / (1 + exp(-(a + b * x))) AS q FROM kick_samples AS s, n12 WHERE season_year = {CAL[-1]}),
gaps AS (SELECT max(abs(mp - ar)) AS gap FROM (
  SELECT avg(q) AS mp, avg(home_won) AS ar FROM checked JOIN (SELECT i AS bin, i * 0.1::DOUBLE AS lo, (i + 1) * 0.1::DOUBLE AS hi FROM range(10) AS r(i)) AS b
    ON q >= lo AND (q < hi OR (bin = 9 AND q = hi)) GROUP BY bin HAVING count(*) >= 5) AS g),
scores AS (SELECT avg(pow(p - home_won, 2)) AS raw, avg(pow(q - home_won, 2)) AS platt FROM checked)
SELECT CASE WHEN platt >= raw OR gap > 0.25 THEN '{K.UNCALIBRATED}' ELSE '{K.PLATT}' END AS version,
       (SELECT count(*) FROM kick_samples WHERE season_year < {CAL[-1]}) AS n, {q6('raw')} AS brier_raw, {q6('platt')} AS brier_platt,
       CASE WHEN platt >= raw THEN 'no better than uncalibrated' WHEN gap > 0.25 THEN 'calibration gap' END AS rejected FROM scores, gaps"""))
def _(t: Tables) -> DataFrame:
    c = fitting.select_calibration(t.games(), CAL)
    return t.spark.createDataFrame(
        [(c["version"], c["n"], round(c["brier_raw"], 6), round(c["brier_platt"], 6), c["rejected"])],
        "version string, n long, brier_raw double, brier_platt double, rejected string")


@query("c8_points_per_production", with_ctes(f"SELECT {q6('c')} AS points_per_production FROM conversion"))
def _(t: Tables) -> DataFrame:
    return players.points_per_production(t.statlines(), t.games()).select(r6("points_per_production"))


# --- season projections: every season as of its own July 1 --------------------------------


def dated(t: Tables) -> DataFrame:
    return t.games().withColumn(
        "as_of", F.make_timestamp_ntz(F.col("season_year"), F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def remaining(t: Tables) -> DataFrame:
    from gridcast.session import stage

    return stage(season.remaining_probabilities(dated(t), t.games()))


cte("dated", """
SELECT *, make_timestamp(season_year, 7, 1, 0, 0, 0.0) AS as_of, make_timestamp(season_year, 7, 1, 0, 0, 0.0) AS cutoff,
       completed AND kickoff_at < make_timestamp(season_year, 7, 1, 0, 0, 0.0) AS played FROM games WHERE season_type = 'regular'""")
cte("dated_probes", "SELECT home_team_id AS team_id, season_year, cutoff FROM dated UNION SELECT away_team_id, season_year, cutoff FROM dated")
cte("dated_strengths", Q.strengths_sql(Q.rates_sql(f"({Q.totals_sql('dated_probes')}) AS dt")))
cte("left_games", f"""
SELECT game_id, season_year, week, kickoff_at, home_team_id, away_team_id, coalesce(p, 0.5) AS p
FROM ({Q.baseline_sql('(' + Q.both_sides('(SELECT * FROM dated WHERE NOT played)', 'dated_strengths', ['strength', 'reason']) + ') AS dr')}) AS b""")
cte("played_rows", """
SELECT season_year, home_team_id AS team_id, (home_score > away_score)::INTEGER AS w, (home_score < away_score)::INTEGER AS l, (home_score = away_score)::INTEGER AS t FROM dated WHERE played
UNION ALL SELECT season_year, away_team_id, (home_score < away_score)::INTEGER, (home_score > away_score)::INTEGER, (home_score = away_score)::INTEGER FROM dated WHERE played""")
cte("table_rows", """
SELECT s.season_year, s.team_id, coalesce(sum(w), 0)::BIGINT AS wins, coalesce(sum(l), 0)::BIGINT AS losses, coalesce(sum(t), 0)::BIGINT AS ties
FROM season_teams AS s LEFT JOIN played_rows AS p ON p.season_year = s.season_year AND p.team_id = s.team_id GROUP BY s.season_year, s.team_id""")
cte("h2h", """
SELECT season_year, least(home_team_id, away_team_id) AS lo, greatest(home_team_id, away_team_id) AS hi,
       (arg_max({'w': CASE WHEN home_score > away_score THEN home_team_id WHEN home_score < away_score THEN away_team_id END}, (kickoff_at, game_id))).w AS winner
FROM dated WHERE played GROUP BY 1, 2, 3""")


@query("w1_win_totals", with_ctes(f"""
SELECT season_year::BIGINT AS season_year, team_id::BIGINT AS team_id, gp AS games_played, ws AS wins_so_far, gr AS games_remaining, {q6('ea')} AS expected_additional_wins,
       {q6('greatest(ws, ws + ea - sqrt(v))')} AS band_low, {q6('least(ws + gr, ws + ea + sqrt(v))')} AS band_high
FROM (SELECT t.season_year, t.team_id, wins + losses + ties AS gp, wins + 0.5::DOUBLE * ties AS ws, count(r.p) AS gr, coalesce(sum(r.p), 0) AS ea, coalesce(sum(r.p * (1 - r.p)), 0) AS v
      FROM table_rows AS t LEFT JOIN (SELECT season_year, home_team_id AS team_id, p FROM left_games UNION ALL SELECT season_year, away_team_id, 1 - p FROM left_games) AS r
        ON r.season_year = t.season_year AND r.team_id = t.team_id GROUP BY t.season_year, t.team_id, wins, losses, ties) AS q"""))
def _(t: Tables) -> DataFrame:
    return season.win_totals(dated(t), t.games()).select(
        big("season_year"), big("team_id"), big("games_played"), "wins_so_far", big("games_remaining"),
        r6("expected_additional_wins"), r6("band_low"), r6("band_high"))


_rate = "(CASE WHEN wins + losses + ties > 0 THEN (wins + 0.5::DOUBLE * ties) / (wins + losses + ties) ELSE 0.0 END)"


@query("w2_standings", with_ctes(f"SELECT season_year::BIGINT AS season_year, team_id::BIGINT AS team_id, wins, losses, ties, {q6(_rate)} AS win_rate FROM table_rows"))
def _(t: Tables) -> DataFrame:
    return season.standings(dated(t)).select(
        big("season_year"), big("team_id"), big("wins"), big("losses"), big("ties"), r6("win_rate"))


@query("w3_head_to_head", with_ctes("SELECT season_year::BIGINT AS season_year, lo::BIGINT AS low_id, hi::BIGINT AS high_id, winner::BIGINT AS winner_id FROM h2h"))
def _(t: Tables) -> DataFrame:
    return season.head_to_head(dated(t)).select(big("season_year"), big("low_id"), big("high_id"), big("winner_id"))


@query("w4_remaining_probabilities", with_ctes("SELECT game_id, p FROM left_games"))
def _(t: Tables) -> DataFrame:
    return season.remaining_probabilities(dated(t), t.games()).select("game_id", "p")


cte("drawn", f"""
SELECT g.*, trial, CASE WHEN {Q.uniform(str(K.SEED), 'trial', 'game_id')} < p THEN home_team_id ELSE away_team_id END AS winner,
       least(home_team_id, away_team_id) AS lo, greatest(home_team_id, away_team_id) AS hi
FROM left_games AS g, range({TRIALS}) AS r(trial)""")
cte("finals", f"""
SELECT *, {_rate} AS rate FROM (
  SELECT b.season_year, b.team_id, tr.trial, b.wins + coalesce(d.w, 0) AS wins, b.losses + coalesce(d.n - d.w, 0) AS losses, b.ties
  FROM table_rows AS b, range({TRIALS}) AS tr(trial) LEFT JOIN (
    SELECT season_year, trial, team_id, sum(w)::BIGINT AS w, count(*) AS n FROM (
      SELECT season_year, trial, home_team_id AS team_id, (winner = home_team_id)::INTEGER AS w FROM drawn
      UNION ALL SELECT season_year, trial, away_team_id, (winner = away_team_id)::INTEGER FROM drawn) AS u GROUP BY ALL) AS d
  ON d.season_year = b.season_year AND d.trial = tr.trial AND d.team_id = b.team_id) AS f""")
cte("divisions", "SELECT team_id, conference, division FROM teams JOIN (VALUES " + ", ".join(
    f"('{a}', '{c}', '{d}')" for a, (c, d) in K.DIVISIONS.items()) + ") AS v(abbr, conference, division) ON abbr = abbreviation")


def ranked_sql(source: str, group: str, label: str) -> str:
    lot = Q.uniform(str(K.SEED), f"'{label}'", "k.trial", "k.team_id")
    part = f"season_year, trial, {group}"
    return f"""
SELECT * EXCLUDE (key, size, tlo, thi, better), row_number() OVER (PARTITION BY {part} ORDER BY rate DESC, key, team_id) AS place FROM (
  SELECT k.*, coalesce(d.winner, h.winner) AS better,
         CASE WHEN size = 2 AND coalesce(d.winner, h.winner) IS NOT NULL THEN (k.team_id <> coalesce(d.winner, h.winner))::INTEGER::DOUBLE ELSE {lot} END AS key
  FROM (SELECT *, count(*) OVER w AS size, min(team_id) OVER w AS tlo, max(team_id) OVER w AS thi FROM {source} WINDOW w AS (PARTITION BY {part}, rate)) AS k
  LEFT JOIN (SELECT season_year, trial, lo, hi, arg_max(winner, (kickoff_at, game_id)) AS winner FROM drawn GROUP BY ALL) AS d
    ON d.season_year = k.season_year AND d.trial = k.trial AND d.lo = tlo AND d.hi = thi
  LEFT JOIN h2h AS h ON h.season_year = k.season_year AND h.lo = tlo AND h.hi = thi) AS r"""


cte("finals_div", "SELECT f.*, conference, division FROM finals AS f JOIN divisions USING (team_id)")
cte("division_ranks", ranked_sql("finals_div", "conference, division", "division"))
cte("wildcard_ranks", ranked_sql("(SELECT * EXCLUDE (place) FROM division_ranks WHERE place > 1)", "conference", "wildcard"))
cte("field", """
SELECT season_year, trial, team_id, wins, ties, true AS division_winner, true AS playoffs FROM division_ranks WHERE place = 1
UNION ALL SELECT season_year, trial, team_id, wins, ties, false, place <= 3 FROM wildcard_ranks""")


def simulated(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    from gridcast.session import stage

    left = remaining(t)
    outcomes = season.trial_outcomes(left, TRIALS, packed=True)
    records = stage(season.trial_records(outcomes, season.standings(dated(t)), TRIALS))
    return records, left, season.head_to_head(dated(t))


@query("m10_divisions", with_ctes("SELECT t.team_id::BIGINT AS team_id, abbreviation, conference, division FROM teams AS t JOIN divisions AS d ON d.team_id = t.team_id"))
def _(t: Tables) -> DataFrame:
    return season.attach_divisions(t.teams())[0].select(big("team_id"), "abbreviation", "conference", "division")


@query("w5_trial_records", with_ctes("SELECT season_year::BIGINT AS season_year, trial::BIGINT AS trial, team_id::BIGINT AS team_id, wins, losses, ties FROM finals"))
def _(t: Tables) -> DataFrame:
    outcomes = season.trial_outcomes(remaining(t), TRIALS, packed=True)
    return season.trial_records(outcomes, season.standings(dated(t)), TRIALS).select(
        big("season_year"), big("trial"), big("team_id"), big("wins"), big("losses"), big("ties"))


@query("w6_division_ranking", with_ctes("""
SELECT season_year::BIGINT AS season_year, team_id::BIGINT AS team_id, place, count(*) AS trials FROM division_ranks GROUP BY ALL"""))
def _(t: Tables) -> DataFrame:
    records, left, h2h = simulated(t)
    known = season.attach_divisions(t.teams())[0].select("team_id", "conference", "division")
    ranks = season.rank_with_tiebreak(records.join(known, "team_id"), left, h2h, ["conference", "division"], "division")
    return ranks.groupBy(big("season_year"), big("team_id"), big("place")).agg(F.count(F.lit(1)).alias("trials"))


@query("w7_playoff_rate", with_ctes(f"""
SELECT season_year::BIGINT AS season_year, team_id::BIGINT AS team_id, count(*) FILTER (WHERE division_winner) AS division_wins, count(*) FILTER (WHERE playoffs) AS playoff_places FROM field GROUP BY ALL"""))
def _(t: Tables) -> DataFrame:
    field = season.playoff_field(*simulated(t), t.teams())
    count = lambda c, n: F.sum(F.col(c).cast("bigint")).alias(n)
    return field.groupBy(big("season_year"), big("team_id")).agg(
        count("division_winner", "division_wins"), count("playoffs", "playoff_places"))


def _pct(p: int) -> str:
    return f"(list_sort(list(wins + 0.5::DOUBLE * ties)))[{int(round((TRIALS - 1) * p / 100)) + 1}] AS p{p}"


@query("w8_simulation_summary", with_ctes(f"""
SELECT season_year::BIGINT AS season_year, team_id::BIGINT AS team_id, {', '.join(_pct(p) for p in (10, 25, 50, 75, 90))}, {q6('avg(wins + 0.5::DOUBLE * ties)')} AS mean_wins,
       {q6(f'count(*) FILTER (WHERE division_winner) / {TRIALS}.0::DOUBLE')} AS division_rate, {q6(f'count(*) FILTER (WHERE playoffs) / {TRIALS}.0::DOUBLE')} AS playoff_rate
FROM field GROUP BY season_year, team_id"""))
def _(t: Tables) -> DataFrame:
    field = season.playoff_field(*simulated(t), t.teams())
    return season.simulation_summary(field, TRIALS).select(
        big("season_year"), big("team_id"), "p10", "p25", "p50", "p75", "p90", r6("mean_wins"), r6("division_rate"), r6("playoff_rate"))


# every team's home games of a week are a set; week 13 straddles July 1, so its sets mix played and unplayed games
cte("pick_rows", "SELECT (season_year::BIGINT * 100 + week) * 1000 + home_team_id AS set_id, * FROM dated")


@query("w9_combined_outcomes", with_ctes(f"""
SELECT s.set_id::BIGINT AS set_id, {q6('CASE WHEN coalesce(missed, 0) > 0 THEN 0.0 ELSE coalesce(hits, ' + str(TRIALS) + f') / {TRIALS}.0::DOUBLE END')} AS joint_probability,
       {q6('CASE WHEN coalesce(missed, 0) > 0 THEN 0.0 ELSE coalesce(prod, 1.0) END')} AS exact_probability
FROM (SELECT DISTINCT set_id FROM pick_rows) AS s
LEFT JOIN (SELECT set_id, count(*) FILTER (WHERE NOT home_score > away_score) AS missed FROM pick_rows WHERE played GROUP BY set_id) AS m ON m.set_id = s.set_id
LEFT JOIN (SELECT set_id, sum(hit)::BIGINT AS hits FROM (
  SELECT k.set_id, d.trial, min((d.winner = d.home_team_id)::INTEGER) AS hit FROM pick_rows AS k JOIN drawn AS d ON d.game_id = k.game_id GROUP BY ALL) AS h GROUP BY set_id) AS j ON j.set_id = s.set_id
LEFT JOIN (SELECT k.set_id, product(g.p) AS prod FROM pick_rows AS k JOIN left_games AS g ON g.game_id = k.game_id GROUP BY k.set_id) AS e ON e.set_id = s.set_id"""))
def _(t: Tables) -> DataFrame:
    games = season.schedule(dated(t))
    picks = games.select(
        ((F.col("season_year").cast("bigint") * 100 + F.col("week")) * 1000 + F.col("home_team_id")).alias("set_id"), "game_id", F.col("home_team_id").alias("winner_id"))
    return season.combined_outcomes(picks, games, t.games(), TRIALS).select(big("set_id"), r6("joint_probability"), r6("exact_probability"))


cte("pick_list", """
SELECT DISTINCT season_year, CASE WHEN season_type = 'preseason' THEN week + 1 ELSE week END AS week,
       CASE WHEN h.region = 'ASIA' THEN 'XXX' ELSE a.abbreviation END AS winner, h.abbreviation AS opponent
FROM games JOIN teams AS h ON h.team_id = home_team_id JOIN teams AS a ON a.team_id = away_team_id""")


@query("v6_pick_resolution", with_ctes("""
SELECT p.season_year::BIGINT AS season_year, p.week::BIGINT AS week, p.winner, p.opponent, min(g.game_id) AS game_id,
       CASE WHEN any_value(w.team_id) IS NULL THEN 'unknown team' WHEN min(g.game_id) IS NULL THEN 'no such game' END AS error
FROM pick_list AS p LEFT JOIN teams AS w ON w.abbreviation = p.winner LEFT JOIN teams AS o ON o.abbreviation = p.opponent
LEFT JOIN games AS g ON g.season_type = 'regular' AND g.season_year = p.season_year AND g.week = p.week
  AND least(g.home_team_id, g.away_team_id) = least(w.team_id, o.team_id) AND greatest(g.home_team_id, g.away_team_id) = greatest(w.team_id, o.team_id) AND w.team_id IS NOT NULL
GROUP BY p.season_year, p.week, p.winner, p.opponent"""))
def _(t: Tables) -> DataFrame:
    teams = t.teams()
    side = lambda s: teams.select(F.col("team_id").alias(f"{s}_team_id"), F.col("abbreviation").alias(s), F.col("region").alias(f"{s}_region"))
    picks = t.games().join(side("home"), "home_team_id").join(side("away"), "away_team_id").select(
        "season_year", F.when(F.col("season_type") == "preseason", F.col("week") + 1).otherwise(F.col("week")).alias("week"),
        F.when(F.col("home_region") == "ASIA", "XXX").otherwise(F.col("away")).alias("winner"), F.col("home").alias("opponent")).distinct()
    good, bad = season.resolve_picks(picks, teams, t.games())
    cols = [big("season_year"), big("week"), "winner", "opponent"]
    return good.select(*cols, "game_id", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select(*cols, F.lit(None).cast("bigint").alias("game_id"), "error"))


# --- signals ------------------------------------------------------------------------------

cte("market_model", "SELECT user_id AS market_id, avg(value / (value + 40)) AS model_probability FROM events GROUP BY user_id")


def market_model(t: Tables) -> DataFrame:
    e = t.source("events")
    return e.groupBy(F.col("user_id").alias("market_id")).agg(F.avg(F.col("value") / (F.col("value") + 40)).alias("model_probability"))


@query("j7_market_model_join", with_ctes(f"SELECT quote_id, market_id, yes_price, {q6('model_probability')} AS model_probability FROM quotes JOIN market_model USING (market_id)"))
def _(t: Tables) -> DataFrame:
    return t.quotes().join(market_model(t), "market_id").select("quote_id", "market_id", "yes_price", r6("model_probability"))


@query("g1_value", with_ctes(f"""
SELECT quote_id, market_id::VARCHAR AS market_id, CASE WHEN ey >= 0.03 THEN 'YES' ELSE 'NO' END AS side, {q6('CASE WHEN ey >= 0.03 THEN ey ELSE en END')} AS edge,
       {q6('least(1.0, 0.5 + CASE WHEN ey >= 0.03 THEN ey ELSE en END)')} AS confidence
FROM (SELECT *, model_probability - yes_price AS ey, (1 - model_probability) - no_price AS en FROM quotes JOIN market_model USING (market_id)) AS q WHERE ey >= 0.03 OR en >= 0.03"""))
def _(t: Tables) -> DataFrame:
    return signals.value_signals(t.quotes(), market_model(t), keep=("quote_id",)).select("quote_id", "market_id", "side", r6("edge"), r6("confidence"))


@query("g2_arbitrage", with_ctes(f"""
SELECT event_id::VARCHAR AS market_id, {q6('1 - tot')} AS edge, {q6('least(1.0, 0.6 + 1 - tot)')} AS confidence
FROM (SELECT event_id, 1 / max(home_decimal_odds) + 1 / max(away_decimal_odds) AS tot FROM book_odds GROUP BY event_id) AS b WHERE tot < 0.99"""))
def _(t: Tables) -> DataFrame:
    return signals.arbitrage_signals(t.book_odds()).select("market_id", r6("edge"), r6("confidence"))


cte("book_mean", "SELECT event_id AS market_id, avg(1 / home_decimal_odds) AS mean_probability FROM book_odds GROUP BY event_id")


@query("j8_consensus_join", with_ctes(f"SELECT quote_id, market_id, {q6('mean_probability')} AS mean_probability FROM quotes JOIN book_mean USING (market_id)"))
def _(t: Tables) -> DataFrame:
    mean = t.book_odds().groupBy(F.col("event_id").alias("market_id")).agg(F.avg(1 / F.col("home_decimal_odds")).alias("mean_probability"))
    return t.quotes().join(mean, "market_id").select("quote_id", "market_id", r6("mean_probability"))


@query("g3_consensus", with_ctes(f"""
SELECT quote_id, market_id::VARCHAR AS market_id, CASE WHEN gap > 0 THEN 'YES' ELSE 'NO' END AS side, {q6('abs(gap)')} AS edge, {q6('least(1.0, 0.55 + abs(gap))')} AS confidence
FROM (SELECT *, mean_probability - yes_price AS gap FROM quotes JOIN book_mean USING (market_id)) AS q WHERE abs(gap) >= 0.3"""))
def _(t: Tables) -> DataFrame:
    return signals.consensus_signals(t.quotes(), t.book_odds(), 0.3, keep=("quote_id",)).select("quote_id", "market_id", "side", r6("edge"), r6("confidence"))


@query("g4_momentum", with_ctes(f"""
SELECT market_id::VARCHAR AS market_id, CASE WHEN mv > 0 THEN 'YES' ELSE 'NO' END AS side, {q6('abs(mv)')} AS edge, {q6('least(1.0, 0.5 + abs(mv))')} AS confidence FROM (
  SELECT market_id, yes_price / lag(yes_price, 5) OVER w - 1 AS mv, row_number() OVER (PARTITION BY market_id ORDER BY ts DESC, quote_id DESC) AS k
  FROM quotes WINDOW w AS (PARTITION BY market_id ORDER BY ts, quote_id)) AS m WHERE k = 1 AND abs(mv) >= 0.5"""))
def _(t: Tables) -> DataFrame:
    return signals.momentum_signals(t.quotes(), 5, 0.5).select("market_id", "side", r6("edge"), r6("confidence"))


cte("bets", """
SELECT event_type AS strategy, event_id, (floor(value)::INTEGER % 2) AS outcome, yes_price AS win_probability, 1.2::DOUBLE + (event_id % 20) / 10.0::DOUBLE AS decimal_odds
FROM events JOIN quotes ON quote_id = event_id""")


def bets(t: Tables) -> DataFrame:
    e = t.source("events").select("event_id", F.col("event_type").alias("strategy"), (F.floor("value") % 2).cast("int").alias("outcome"))
    return e.join(t.quotes(), F.col("event_id") == F.col("quote_id")).select(
        "strategy", "event_id", "outcome", F.col("yes_price").alias("win_probability"),
        (F.lit(1.2) + (F.col("event_id") % 20) / F.lit(10.0)).alias("decimal_odds"))


@query("g5_backtest", with_ctes(f"""
SELECT strategy, count(*) AS trades, count(*) FILTER (WHERE outcome = 1) AS wins, count(*) FILTER (WHERE outcome <> 1) AS losses,
       round(10000 * exp(sum(ln(CASE WHEN outcome = 1 THEN 1 + 0.001::DOUBLE * (decimal_odds - 1) ELSE 0.999::DOUBLE END))), 2) AS ending_bankroll
FROM bets WHERE win_probability > 1 / decimal_odds GROUP BY strategy"""))
def _(t: Tables) -> DataFrame:
    return signals.binary_backtest(bets(t), ["strategy"], 0.001).select("strategy", big("trades"), big("wins"), big("losses"), "ending_bankroll")


@query("g6_kelly_stakes", with_ctes(f"""
SELECT event_id, {q6('f')} AS fraction, {q6('greatest(0.0, 5000 * f)')} AS stake FROM (
  SELECT event_id, greatest(0.0, least(0.05::DOUBLE, ((decimal_odds - 1) * win_probability - (1 - win_probability)) / (decimal_odds - 1))) AS f FROM bets) AS b"""))
def _(t: Tables) -> DataFrame:
    return signals.kelly_stakes(bets(t), "win_probability", "decimal_odds", 5000.0).select("event_id", r6("fraction"), r6("stake"))
