"""Queries over sides, as-of totals, strengths and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast import constants as K
from gridcast.functions import expr as X
from gridcast.operators import forecast as FC
from gridcast.operators import schedule, sides, strength, turnovers
from gridcast.operators.asof import asof_aggregate
from gridcast.plans import sqltext as Q
from gridcast.plans.fixtures import Tables
from gridcast.plans.registry import big, q6, qstamp, query, r6, stamp, with_ctes


def tested(t: Tables) -> DataFrame:
    return sides.with_result(sides.with_cutoff(sides.select_test_games(t.games())))


def probes(t: Tables) -> DataFrame:
    return sides.side_probes(tested(t))


def totals(t: Tables) -> DataFrame:
    return strength.scoring_totals(probes(t), t.games())


def key() -> list:
    return [big("team_id"), big("season_year"), stamp("cutoff")]


KEY_SQL = f"team_id::BIGINT AS team_id, season_year::BIGINT AS season_year, {qstamp('cutoff')} AS cutoff"


@query("j1_side_expansion", with_ctes(
    "SELECT game_id, is_home, team_id::BIGINT AS team_id, opponent_id::BIGINT AS opponent_id, pf AS points_for, pa AS points_against FROM sides"))
def _(t: Tables) -> DataFrame:
    return sides.team_games(t.games()).select(
        "game_id", "is_home", big("team_id"), big("opponent_id"), "points_for", "points_against")


@query("j2_asof_join", with_ctes(f"""
SELECT team_id::BIGINT AS team_id, season_year::BIGINT AS season_year, {qstamp('cutoff')} AS cutoff, cur_n AS games, cur_pf AS points FROM totals"""))
def _(t: Tables) -> DataFrame:
    facts = sides.scoring_facts(t.games())
    got = asof_aggregate(
        probes(t), facts, ["team_id", "season_year"], "kickoff_at",
        {"games": ("sum", F.lit(1).cast("bigint")), "points": ("sum", F.col("points_for"))}, probe_ts="cutoff")
    return got.select(*key(), big("games"), big("points"))


@query("j3_season_pairs", with_ctes("""
SELECT a.team_id::BIGINT AS team_id, a.season_year::BIGINT AS season_year, round(a.ppg_for, 6) AS ppg_for, round(b.ppg_for, 6) AS next_ppg_for,
       round(a.ppg_against, 6) AS ppg_against, round(b.ppg_against, 6) AS next_ppg_against
FROM team_seasons AS a JOIN team_seasons AS b ON b.team_id = a.team_id AND b.season_year = a.season_year + 1"""))
def _(t: Tables) -> DataFrame:
    from gridcast.operators.fitting import season_pairs

    return season_pairs(t.games()).select(
        big("team_id"), big("season_year"), r6("ppg_for"), r6("next_ppg_for"), r6("ppg_against"), r6("next_ppg_against"))


@query("j4_both_sides", with_ctes(f"""
SELECT game_id, {q6('home_strength')} AS home_strength, {q6('away_strength')} AS away_strength FROM rated"""))
def _(t: Tables) -> DataFrame:
    return FC.rated_games(tested(t), t.games()).select("game_id", r6("home_strength"), r6("away_strength"))


@query("a1_asof_points", with_ctes(f"""
SELECT {KEY_SQL}, cur_n AS games, cur_pf AS points_for, cur_pa AS points_against, {qstamp('cur_first')} AS first_kickoff
FROM (SELECT t.*, f.cur_first FROM totals AS t JOIN (
  SELECT p.team_id, p.season_year, p.cutoff, min(f.kickoff_at) AS cur_first FROM probes AS p
  LEFT JOIN facts AS f ON f.team_id = p.team_id AND f.season_year = p.season_year AND f.kickoff_at < p.cutoff
  GROUP BY ALL) AS f USING (team_id, season_year, cutoff)) AS j"""))
def _(t: Tables) -> DataFrame:
    got = asof_aggregate(
        probes(t), sides.scoring_facts(t.games()), ["team_id", "season_year"], "kickoff_at",
        {
            "games": ("sum", F.lit(1).cast("bigint")),
            "points_for": ("sum", F.col("points_for")),
            "points_against": ("sum", F.col("points_against")),
            "first_kickoff": ("min", F.col("kickoff_at")),
        },
        probe_ts="cutoff")
    return got.select(*key(), big("games"), big("points_for"), big("points_against"), stamp("first_kickoff"))


@query("a2_season_totals", with_ctes(
    f"SELECT {KEY_SQL}, cur_n, cur_pf, cur_pa, prior_n, prior_pf, prior_pa FROM totals"))
def _(t: Tables) -> DataFrame:
    return totals(t).select(*key(), *[big(c) for c in ("cur_n", "cur_pf", "cur_pa", "prior_n", "prior_pf", "prior_pa")])


@query("a3_training_window", with_ctes(f"SELECT {KEY_SQL}, {qstamp('coalesce(first_kickoff, cutoff)')} AS window_start FROM totals"))
def _(t: Tables) -> DataFrame:
    return totals(t).select(*key(), stamp(F.coalesce("first_kickoff", "cutoff"), "window_start"))


@query("a4_shrinkage", with_ctes(f"""
SELECT {KEY_SQL}, {q6(Q.shrink('cf', 'cur_n', 'prf'))} AS blended, {q6(Q.weight('cf', 'cur_n', 'prf'))} AS weight
FROM ({Q.rates_sql('totals')}) AS r"""))
def _(t: Tables) -> DataFrame:
    cur, prior, n = X.rate(F.col("cur_pf"), F.col("cur_n")), X.rate(F.col("prior_pf"), F.col("prior_n")), F.col("cur_n")
    return totals(t).select(*key(), r6(X.shrink(cur, n, prior), "blended"), r6(X.shrink_weight(cur, n, prior), "weight"))


@query("a5_blended_points", with_ctes(f"SELECT {KEY_SQL}, {q6('ppg_for')} AS ppg_for, {q6('ppg_against')} AS ppg_against FROM strengths"))
def _(t: Tables) -> DataFrame:
    c = F.col
    return totals(t).select(
        *key(),
        r6(X.blended_rate(c("cur_pf"), c("cur_n"), c("prior_pf"), c("prior_n")), "ppg_for"),
        r6(X.blended_rate(c("cur_pa"), c("cur_n"), c("prior_pa"), c("prior_n")), "ppg_against"))


@query("a6_pythagorean", with_ctes(f"""
SELECT season_year::BIGINT AS season_year, team_id::BIGINT AS team_id, {q6(Q.pyth('ppg_for', 'ppg_against'))} AS expectation FROM team_seasons"""))
def _(t: Tables) -> DataFrame:
    return strength.team_season_points(t.games()).select(
        big("season_year"), big("team_id"), r6(X.pythagorean(F.col("ppg_for"), F.col("ppg_against")), "expectation"))


@query("a7_team_strength", with_ctes(f"SELECT {KEY_SQL}, {q6('strength')} AS strength, {q6('shrink_weight')} AS shrink_weight, reason FROM strengths"))
def _(t: Tables) -> DataFrame:
    return strength.team_strength(totals(t)).select(*key(), r6("strength"), r6("shrink_weight"), "reason")


cte_change = """
change_points AS (
  SELECT DISTINCT t.team_id, t.season_year, f.kickoff_at FROM season_teams AS t
  JOIN facts AS f ON f.team_id = t.team_id AND f.season_year BETWEEN t.season_year - 1 AND t.season_year),
change_probes AS (SELECT team_id, season_year, kickoff_at + INTERVAL 1 MICROSECOND AS cutoff FROM change_points)"""


@query("a8_strength_timeline", with_ctes(f"""
WITH {cte_change}
SELECT team_id::BIGINT AS team_id, season_year::BIGINT AS season_year, {qstamp('cutoff')} AS changed_at,
       cur_n, prior_n, {q6('strength')} AS strength
FROM ({Q.strengths_sql(Q.rates_sql('(' + Q.totals_sql('change_probes') + ') AS ct'))}) AS s"""))
def _(t: Tables) -> DataFrame:
    return strength.strength_timeline(t.games()).select(
        big("team_id"), big("season_year"), stamp("changed_at"), big("cur_n"), big("prior_n"), r6("strength"))


@query("a9_calibrated_strength", with_ctes(f"SELECT {KEY_SQL}, {q6('strength')} AS strength, reason FROM calibrated"))
def _(t: Tables) -> DataFrame:
    return strength.calibrated_strength(totals(t), t.games()).select(*key(), r6("strength"), "reason")


@query("a10_league_points", with_ctes(f"SELECT season_year::BIGINT AS season_year, {q6('lp')} AS league_points FROM league_points"))
def _(t: Tables) -> DataFrame:
    return strength.league_average_points(t.games()).select(big("season_year"), r6("league_points"))


@query("a11_league_ppg", with_ctes(f"SELECT season_year::BIGINT AS season_year, {q6('lf')} AS league_for, {q6('la')} AS league_against FROM league_ppg"))
def _(t: Tables) -> DataFrame:
    return strength.league_average_ppg(t.games()).select(big("season_year"), r6("league_for"), r6("league_against"))


@query("a12_regressed_strength", with_ctes(f"SELECT {KEY_SQL}, {q6('strength')} AS strength, reason FROM regressed"))
def _(t: Tables) -> DataFrame:
    return strength.regressed_strength(totals(t), t.games()).select(*key(), r6("strength"), "reason")


@query("a13_win_rate_strength", with_ctes(f"""
SELECT {KEY_SQL}, {q6(Q.shrink(Q.rate('cur_wins', 'cur_n'), 'cur_n', Q.rate('prior_wins', 'prior_n')))} AS win_rate FROM totals"""))
def _(t: Tables) -> DataFrame:
    return strength.win_rate_strength(totals(t)).select(*key(), r6("win_rate"))


@query("a14_turnovers_committed", with_ctes("SELECT game_id, team_id::BIGINT AS team_id, turnovers FROM committed"))
def _(t: Tables) -> DataFrame:
    return turnovers.turnovers_committed(t.statlines()).select("game_id", big("team_id"), big("turnovers"))


@query("a15_turnover_margin", with_ctes("SELECT game_id, team_id::BIGINT AS team_id, turnover_margin FROM margins"))
def _(t: Tables) -> DataFrame:
    return turnovers.turnover_margins(t.games(), t.statlines()).select("game_id", big("team_id"), big("turnover_margin"))


@query("a15_turnover_form", with_ctes(f"SELECT {KEY_SQL}, margin_n, {q6('turnover_form')} AS turnover_form FROM form"))
def _(t: Tables) -> DataFrame:
    return turnovers.turnover_form(probes(t), t.games(), t.statlines()).select(*key(), big("margin_n"), r6("turnover_form"))


@query("a16_schedule_factor", with_ctes(f"""
SELECT {KEY_SQL}, opponents_rated, league_rated, {q6('league_mean')} AS league_strength, {q6('factor')} AS schedule_factor FROM factors"""))
def _(t: Tables) -> DataFrame:
    return schedule.schedule_factor(probes(t), t.games()).select(
        *key(), big("opponents_rated"), big("league_rated"), r6("league_strength"), r6("schedule_factor"))


# --- shared expressions over whole tables ------------------------------------------


@query("m1_log5", with_ctes(f"SELECT game_id, {q6(Q.log5('home_strength', 'away_strength'))} AS p FROM rated"))
def _(t: Tables) -> DataFrame:
    return FC.rated_games(tested(t), t.games()).select("game_id", r6(X.log5(F.col("home_strength"), F.col("away_strength")), "p"))


@query("m2_logit_sigmoid", with_ctes(f"SELECT quote_id, {q6(Q.logit('yes_price'))} AS z, {q6(Q.sigmoid(Q.logit('yes_price') + ' / 2'))} AS half FROM quotes"))
def _(t: Tables) -> DataFrame:
    z = X.logit(F.col("yes_price"))
    return t.quotes().select("quote_id", r6(z, "z"), r6(X.sigmoid(z / 2), "half"))


@query("m3_home_field", with_ctes(f"SELECT game_id, {q6(Q.home_field(Q.log5('home_strength', 'away_strength')))} AS p FROM rated"))
def _(t: Tables) -> DataFrame:
    p = X.with_home_field(X.log5(F.col("home_strength"), F.col("away_strength")), F.col("neutral_site"))
    return FC.rated_games(tested(t), t.games()).select("game_id", r6(p, "p"))


@query("m4_uncertainty", with_ctes(f"SELECT game_id, {q6('least(1.0 / sqrt(least(home_cur_n, away_cur_n) + 1), 1.0)')} AS uncertainty FROM rated"))
def _(t: Tables) -> DataFrame:
    return FC.rated_games(tested(t), t.games()).select(
        "game_id", r6(X.forecast_uncertainty(F.col("home_cur_n"), F.col("away_cur_n")), "uncertainty"))


@query("m5_contract_payout", with_ctes(f"""
SELECT game_id, {q6('p + 0.5 * tie')} AS home_payout, {q6('(1 - p - tie) + 0.5 * tie')} AS away_payout
FROM (SELECT game_id, p, 0.002::DOUBLE AS tie FROM baseline) AS b"""))
def _(t: Tables) -> DataFrame:
    p = F.col("home_win_probability")
    tie = F.lit(0.002)
    return FC.baseline_forecast(tested(t), t.games()).select(
        "game_id", r6(X.home_payout(p, tie), "home_payout"), r6(X.away_payout(p, tie), "away_payout"))


@query("m6_platt_apply", with_ctes(f"SELECT game_id, {q6(Q.sigmoid('0.1 + 0.9 * ' + Q.logit('p')))} AS p FROM baseline"))
def _(t: Tables) -> DataFrame:
    return FC.baseline_forecast(tested(t), t.games()).select("game_id", r6(X.platt(F.col("home_win_probability"), 0.1, 0.9), "p"))


@query("m7_kelly", with_ctes(f"""
SELECT quote_id, {q6('f')} AS fraction, {q6('greatest(0.0, 10000 * f)')} AS stake FROM (
  SELECT quote_id, greatest(0.0, least(0.05, CASE WHEN b > 0 THEN (b * yes_price - (1 - yes_price)) / b ELSE 0.0 END)) AS f
  FROM (SELECT *, (1.8 + (quote_id % 10) / 10.0::DOUBLE) - 1.0 AS b FROM quotes) AS q) AS k"""))
def _(t: Tables) -> DataFrame:
    odds = F.lit(1.8) + (F.col("quote_id") % 10) / F.lit(10.0)
    f = X.kelly_fraction(F.col("yes_price"), odds)
    return t.quotes().select("quote_id", r6(f, "fraction"), r6(X.position_size(F.lit(10000.0), f), "stake"))


# --- forecasts ---------------------------------------------------------------------


@query("f1_baseline_forecast", with_ctes(f"""
SELECT 'forecast:' || substr(sha256('forecast' || chr(30) || game_id::VARCHAR || chr(31) || '{K.MODEL_VERSION}' || chr(31) || {qstamp('cutoff')}), 1, 32) AS id,
       game_id, '{K.MODEL_VERSION}' AS model_version, '{K.UNCALIBRATED}' AS calibration_version, {qstamp('cutoff')} AS feature_cutoff_at,
       {qstamp('coalesce(least(home_first_kickoff, away_first_kickoff), cutoff)')} AS training_window_start,
       p AS home_win_probability, CASE WHEN abstain_reason IS NULL THEN 0.0::DOUBLE END AS tie_probability,
       CASE WHEN abstain_reason IS NULL THEN {q6('least(1.0 / sqrt(least(home_cur_n, away_cur_n) + 1), 1.0)')} END AS uncertainty,
       {K.PYTHAGOREAN_EXPONENT}::DOUBLE AS exponent, home_cur_n::BIGINT AS home_games_played, away_cur_n::BIGINT AS away_games_played,
       CASE WHEN abstain_reason IS NULL THEN {q6('home_shrink_weight')} END AS home_shrinkage_weight,
       CASE WHEN abstain_reason IS NULL THEN {q6('away_shrink_weight')} END AS away_shrinkage_weight,
       NOT neutral_site AS home_field_applied, abstain_reason IS NOT NULL AS abstained, abstain_reason,
       CASE WHEN abstain_reason IS NULL THEN 0.0::DOUBLE END AS injury_adjustment, CASE WHEN abstain_reason IS NULL THEN '' END AS adjusted_players FROM baseline"""))
def _(t: Tables) -> DataFrame:
    record = FC.forecast_record(FC.baseline_forecast(tested(t), t.games()))
    return record.withColumns({
        "feature_cutoff_at": stamp("feature_cutoff_at"), "training_window_start": stamp("training_window_start"),
        "home_games_played": big("home_games_played"), "away_games_played": big("away_games_played"),
        "adjusted_players": F.array_join("adjusted_players", ",")})


@query("f2_home_field_only", with_ctes(f"SELECT game_id, {q6('p')} AS p FROM f2"))
def _(t: Tables) -> DataFrame:
    return FC.add_home_field_only(tested(t)).select("game_id", r6("home_field_only_probability", "p"))


@query("f3_prior_win_rate", with_ctes(f"SELECT game_id, {q6('p')} AS p, reason FROM f3"))
def _(t: Tables) -> DataFrame:
    return FC.add_prior_win_rate(FC.rated_games(tested(t), t.games())).select(
        "game_id", r6("prior_win_pct_probability", "p"), F.col("prior_win_pct_reason").alias("reason"))


@query("f4_raw_pythagorean", with_ctes(f"SELECT game_id, {q6('p')} AS p, reason FROM f4"))
def _(t: Tables) -> DataFrame:
    return FC.add_raw_pythagorean(FC.rated_games(tested(t), t.games())).select(
        "game_id", r6("raw_pythagorean_probability", "p"), F.col("raw_pythagorean_reason").alias("reason"))


@query("f5_turnover_forecast", with_ctes(f"SELECT game_id, {q6('p')} AS p, reason FROM f5"))
def _(t: Tables) -> DataFrame:
    rated = FC.rated_games(tested(t), t.games())
    return FC.add_turnover_normalized(rated, probes(t), t.games(), t.statlines()).select(
        "game_id", r6("turnover_normalized_probability", "p"), F.col("turnover_normalized_reason").alias("reason"))


@query("f6_sos_forecast", with_ctes(f"SELECT game_id, {q6('p')} AS p, reason FROM f6"))
def _(t: Tables) -> DataFrame:
    rated = FC.rated_games(tested(t), t.games())
    return FC.add_schedule_adjusted(rated, probes(t), t.games()).select(
        "game_id", r6("sos_adjusted_probability", "p"), F.col("sos_adjusted_reason").alias("reason"))


@query("f7_prior_regressed_forecast", with_ctes(f"SELECT game_id, {q6('raw_p')} AS p, abstain_reason FROM f7"))
def _(t: Tables) -> DataFrame:
    return FC.prior_regressed_forecast(tested(t), t.games()).select("game_id", r6("raw_probability", "p"), "abstain_reason")


@query("f8_calibrated_forecast", with_ctes(f"""
SELECT game_id, {q6(Q.sigmoid('0.05 + 0.8 * ' + Q.logit('raw_p')))} AS home_win_probability,
       CASE WHEN abstain_reason IS NULL THEN {q6('least(1.0 / sqrt(least(home_cur_n, away_cur_n) + 1), 1.0)')} END AS uncertainty,
       '{K.PLATT}' AS calibration_version, abstain_reason FROM f8"""))
def _(t: Tables) -> DataFrame:
    return FC.calibrated_forecast(tested(t), t.games(), platt=(0.05, 0.8)).select(
        "game_id", "home_win_probability", "uncertainty", "calibration_version", "abstain_reason")


_margin = "(coalesce({0}_ppg_for, 0) - coalesce({0}_ppg_against, 0))"
_home_term = f"CASE WHEN neutral_site THEN 0.0 ELSE {K.HOME_FIELD_MARGIN_POINTS}::DOUBLE END"
Q.cte("f9", f"""
SELECT *, coalesce(home_reason, away_reason) AS abstain_reason, {_home_term} AS home_only,
       CASE WHEN coalesce(home_reason, away_reason) IS NULL
            THEN {_margin.format('home')} - {_margin.format('away')} + {_home_term} END AS expected_margin FROM rated""")


@query("f9_expected_margin", with_ctes(f"SELECT game_id, {q6('expected_margin')} AS expected_margin, abstain_reason FROM f9"))
def _(t: Tables) -> DataFrame:
    return FC.add_expected_margin(FC.rated_games(tested(t), t.games())).select("game_id", r6("expected_margin"), "abstain_reason")


@query("f12_margin_baselines", with_ctes(f"SELECT game_id, {q6('home_only')} AS home_only_margin, 0.0::DOUBLE AS zero_margin FROM f9"))
def _(t: Tables) -> DataFrame:
    return FC.add_expected_margin(FC.rated_games(tested(t), t.games())).select("game_id", r6("home_only_margin"), "zero_margin")
