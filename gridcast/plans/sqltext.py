"""SQL building blocks of the check queries, written apart from the DataFrame code."""

from __future__ import annotations

from gridcast import constants as K
from gridcast.plans.fixtures import ABBREVIATIONS
from gridcast.plans.registry import cte

INF = "'infinity'::DOUBLE"


def rate(total: str, n: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN {total}::DOUBLE / {n} END)"


def shrink(cur: str, n: str, prior: str, k: float = K.TEAM_PSEUDOGAMES) -> str:
    return (
        f"(CASE WHEN {cur} IS NULL THEN {prior} WHEN {prior} IS NULL THEN {cur} "
        f"ELSE {n}::DOUBLE / ({n} + {k}) * {cur} + (1.0::DOUBLE - {n}::DOUBLE / ({n} + {k})) * {prior} END)"
    )


def weight(cur: str, n: str, prior: str, k: float = K.TEAM_PSEUDOGAMES) -> str:
    return f"(CASE WHEN {cur} IS NULL THEN 0.0::DOUBLE WHEN {prior} IS NULL THEN 1.0::DOUBLE ELSE {n}::DOUBLE / ({n} + {k}) END)"


def pyth(pf: str, pa: str, x: float | str = K.PYTHAGOREAN_EXPONENT) -> str:
    return f"(CASE WHEN {pf} > 0 AND {pa} > 0 THEN pow({pf}, {x}::DOUBLE) / (pow({pf}, {x}::DOUBLE) + pow({pa}, {x}::DOUBLE)) END)"


def log5(a: str, b: str) -> str:
    return f"(CASE WHEN {a} + {b} - 2.0 * {a} * {b} <= 0 THEN 0.5 ELSE ({a} - {a} * {b}) / ({a} + {b} - 2.0 * {a} * {b}) END)"


def clamp(p: str, eps: str = "1e-6") -> str:
    return f"(CASE WHEN {p} IS NOT NULL THEN least(greatest({p}, {eps}::DOUBLE), 1 - {eps}::DOUBLE) END)"


def logit(p: str) -> str:
    return f"ln({clamp(p)} / (1 - {clamp(p)}))"


def sigmoid(z: str) -> str:
    return f"(CASE WHEN {z} < -700 THEN 0.0 ELSE 1.0 / (1.0 + exp(-({z}))) END)"


def home_field(p: str, neutral: str = "neutral_site") -> str:
    return f"(CASE WHEN coalesce({neutral}, false) THEN {p} ELSE {sigmoid(logit(p) + ' + 0.25')} END)"


def loss(p: str, y: str) -> str:
    q = clamp(p, "1e-12")
    return f"(-({y} * ln({q}) + (1 - {y}) * ln(1 - {q})))"


def uniform(*parts: str) -> str:
    joined = ", ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5(concat_ws('|', {joined})), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


# --- mapped views ---------------------------------------------------------------

cte(
    "games",
    """
SELECT o_orderkey AS game_id, year(o_orderdate)::INTEGER AS season_year,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'preseason' ELSE 'regular' END AS season_type,
       (1 + floor((dayofyear(o_orderdate) - 1) / 15))::INTEGER AS week,
       o_orderdate AS kickoff_at, c_nationkey AS home_team_id, s_nationkey AS away_team_id,
       CASE WHEN n >= 2 THEN hp END AS home_score, CASE WHEN n >= 2 THEN ap END AS away_score,
       n >= 2 AS completed, o_orderpriority = '5-LOW' AS neutral_site
FROM orders
JOIN customer ON c_custkey = o_custkey
JOIN (SELECT l_orderkey, min(l_suppkey) AS sk, count(*) AS n,
             coalesce(sum(l_quantity) FILTER (WHERE l_linenumber % 2 = 1), 0)::BIGINT AS hp,
             coalesce(sum(l_quantity) FILTER (WHERE l_linenumber % 2 = 0), 0)::BIGINT AS ap
      FROM lineitem GROUP BY l_orderkey) AS li ON l_orderkey = o_orderkey
JOIN supplier ON s_suppkey = sk
WHERE c_nationkey <> s_nationkey""",
)
_abbr = ", ".join(f"'{a}'" for a in ABBREVIATIONS)
cte(
    "teams",
    f"""
SELECT n_nationkey AS team_id, ([{_abbr}])[n_nationkey + 1] AS abbreviation, n_name AS display_name, r_name AS region
FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
cte(
    "statlines",
    """
SELECT game_id, CASE WHEN l_linenumber % 2 = 1 THEN home_team_id ELSE away_team_id END AS team_id,
       l_suppkey AS player_id, l_linenumber AS line,
       (['fumbles', 'passing', 'rushing', 'receiving', 'defensive'])[l_linenumber % 5 + 1] AS stat_category,
       CASE l_linenumber % 5 WHEN 0 THEN ['FUM', 'LOST'] WHEN 1 THEN ['C/ATT', 'YDS', 'TD', 'INT']
            WHEN 2 THEN ['CAR', 'YDS', 'TD'] WHEN 3 THEN ['REC', 'YDS', 'TD'] ELSE ['TOT', 'SACKS', 'TD'] END AS stat_labels,
       CASE l_linenumber % 5 WHEN 0 THEN [tot, lost] WHEN 1 THEN [tot || '/' || yds, yds, td, lost]
            WHEN 2 THEN [tot, yds, td] WHEN 3 THEN [tot, yds, td] ELSE [tot, lost, td] END AS stat_values
FROM (SELECT *, (l_quantity * 10)::INTEGER::VARCHAR AS yds, l_quantity::INTEGER::VARCHAR AS tot,
             round(l_tax * 100)::INTEGER::VARCHAR AS td, (round(l_discount * 100)::INTEGER % 4)::VARCHAR AS lost
      FROM lineitem) AS l JOIN games ON game_id = l_orderkey""",
)
cte(
    "reports",
    """
SELECT event_id AS report_id, user_id AS player_id,
       'source-' || (json_extract_string(props, '$.k')::INTEGER % 3) AS source,
       cls AS report_class,
       (CASE cls WHEN 'injury_status' THEN ['Out', ' doubtful ', 'QUESTIONABLE', 'day to day']
            WHEN 'practice_participation' THEN ['Did Not Participate', 'limited participation', 'Full Participation', 'resting']
            WHEN 'gameday_inactive' THEN ['Inactive', 'active', 'inactive', 'INACTIVE']
            WHEN 'roster_status' THEN ['Injured Reserve', 'reserve/injured', 'active', 'Non-Football Injury']
            ELSE ['left the game', 'has returned', 'questionable to return', 'being evaluated'] END)[floor(value)::INTEGER % 4 + 1] AS status_text,
       ts AS event_time, ts + to_minutes(event_id % 7) AS retrieved_at,
       CASE WHEN event_id % 17 = 0 THEN 'retracted' ELSE 'original' END AS correction_state
FROM (SELECT *, CASE event_type WHEN 'click' THEN 'injury_status' WHEN 'view' THEN 'practice_participation'
                  WHEN 'purchase' THEN 'in_game_incident' WHEN 'signup' THEN 'roster_status'
                  ELSE 'gameday_inactive' END AS cls FROM events) AS e""",
)
cte(
    "season_reports",
    """
SELECT * REPLACE (event_time + to_days((player_id % 12 * 30 - 8766)::INTEGER) AS event_time,
                  retrieved_at + to_days((player_id % 12 * 30 - 8766)::INTEGER) AS retrieved_at) FROM reports""",
)
cte(
    "quotes",
    """
SELECT event_id AS quote_id, user_id AS market_id, ts, yes_price, round(1.0::DOUBLE - yes_price, 4) AS no_price
FROM (SELECT *, round(least(greatest(value / (value + 50), 0.01::DOUBLE), 0.99::DOUBLE), 4) AS yes_price FROM events) AS e""",
)
cte(
    "book_odds",
    """
SELECT l_orderkey AS event_id, l_suppkey AS book, 1.0::DOUBLE + l_quantity / 40 AS home_decimal_odds,
       1.0::DOUBLE + (51.0::DOUBLE - l_quantity) / 40 AS away_decimal_odds FROM lineitem""",
)

# --- as-of core, by plain inequality join ------------------------------------------

cte(
    "sides",
    """
SELECT game_id, season_year, season_type, week, kickoff_at, completed, neutral_site, true AS is_home,
       home_team_id AS team_id, away_team_id AS opponent_id,
       coalesce(home_score, 0)::BIGINT AS pf, coalesce(away_score, 0)::BIGINT AS pa FROM games
UNION ALL
SELECT game_id, season_year, season_type, week, kickoff_at, completed, neutral_site, false,
       away_team_id, home_team_id, coalesce(away_score, 0)::BIGINT, coalesce(home_score, 0)::BIGINT FROM games""",
)
cte("facts", "SELECT * FROM sides WHERE season_type = 'regular' AND completed")
cte(
    "test_games",
    """
SELECT *, kickoff_at - INTERVAL 24 HOUR AS cutoff, home_score = away_score AS is_tie,
       CASE WHEN home_score <> away_score THEN (home_score > away_score)::INTEGER END AS home_won
FROM games WHERE season_type = 'regular' AND completed""",
)
cte(
    "probes",
    """
SELECT home_team_id AS team_id, season_year, cutoff FROM test_games
UNION SELECT away_team_id, season_year, cutoff FROM test_games""",
)


def totals_sql(probes: str) -> str:
    cur, prior = "f.season_year = p.season_year", "f.season_year = p.season_year - 1"
    parts = []
    for name, cond in (("cur", cur), ("prior", prior)):
        parts += [
            f"(count(*) FILTER (WHERE {cond}))::BIGINT AS {name}_n",
            f"coalesce(sum(f.pf) FILTER (WHERE {cond}), 0)::BIGINT AS {name}_pf",
            f"coalesce(sum(f.pa) FILTER (WHERE {cond}), 0)::BIGINT AS {name}_pa",
            f"(count(*) FILTER (WHERE {cond} AND f.pf > f.pa))::BIGINT AS {name}_wins",
        ]
    return (
        f"SELECT p.team_id, p.season_year, p.cutoff, {', '.join(parts)}, min(f.kickoff_at) AS first_kickoff\n"
        f"FROM {probes} AS p LEFT JOIN facts AS f ON f.team_id = p.team_id AND f.kickoff_at < p.cutoff\n"
        "  AND f.season_year BETWEEN p.season_year - 1 AND p.season_year\n"
        "GROUP BY p.team_id, p.season_year, p.cutoff"
    )


cte("totals", totals_sql("probes"))


def rates_sql(totals: str) -> str:
    return (
        f"SELECT *, {rate('cur_pf', 'cur_n')} AS cf, {rate('cur_pa', 'cur_n')} AS ca, "
        f"{rate('prior_pf', 'prior_n')} AS prf, {rate('prior_pa', 'prior_n')} AS pra FROM {totals}"
    )


def strengths_sql(rates: str, x: float | str = K.PYTHAGOREAN_EXPONENT) -> str:
    return (
        f"SELECT *, {pyth('ppg_for', 'ppg_against', x)} AS strength,\n"
        f"  CASE WHEN cur_n = 0 AND prior_n = 0 THEN '{K.NO_HISTORY}'\n"
        f"       WHEN {pyth('ppg_for', 'ppg_against', x)} IS NULL THEN '{K.BAD_SCORING}' END AS reason\n"
        f"FROM (SELECT *, {shrink('cf', 'cur_n', 'prf')} AS ppg_for, {shrink('ca', 'cur_n', 'pra')} AS ppg_against,\n"
        f"  {weight('cf', 'cur_n', 'prf')} AS shrink_weight FROM ({rates}) AS r) AS b"
    )


cte("strengths", strengths_sql(rates_sql("totals")))


def both_sides(games: str, features: str, columns: list[str]) -> str:
    cols = ", ".join([f"h.{c} AS home_{c}" for c in columns] + [f"a.{c} AS away_{c}" for c in columns])
    return (
        f"SELECT g.*, {cols} FROM {games} AS g\n"
        f"LEFT JOIN {features} AS h ON h.team_id = g.home_team_id AND h.season_year = g.season_year AND h.cutoff = g.cutoff\n"
        f"LEFT JOIN {features} AS a ON a.team_id = g.away_team_id AND a.season_year = g.season_year AND a.cutoff = g.cutoff"
    )


RATED = [
    "cur_n", "cur_pf", "cur_pa", "cur_wins", "prior_n", "prior_pf", "prior_pa", "prior_wins", "first_kickoff",
    "ppg_for", "ppg_against", "shrink_weight", "strength", "reason",
]
cte("rated", both_sides("test_games", "strengths", RATED))


def baseline_sql(rated: str) -> str:
    return (
        "SELECT *, coalesce(home_reason, away_reason) AS abstain_reason,\n"
        "  CASE WHEN coalesce(home_reason, away_reason) IS NULL THEN\n"
        f"    round({home_field(log5('home_strength', 'away_strength'))}, 6) END AS p FROM {rated}"
    )


cte("baseline", baseline_sql("rated"))

cte(
    "league_points",
    """
SELECT season_year, sum(coalesce(home_score, 0) + coalesce(away_score, 0))::DOUBLE / (count(*) * 2) AS lp
FROM games WHERE season_type = 'regular' AND completed GROUP BY season_year""",
)
cte(
    "team_seasons",
    """
SELECT season_year, team_id, count(*) AS games, sum(pf)::BIGINT AS pf, sum(pa)::BIGINT AS pa,
       sum(pf)::DOUBLE / count(*) AS ppg_for, sum(pa)::DOUBLE / count(*) AS ppg_against,
       count(*) FILTER (WHERE pf > pa) AS wins
FROM facts GROUP BY season_year, team_id""",
)
cte(
    "league_ppg",
    "SELECT season_year, avg(ppg_for) AS lf, avg(ppg_against) AS la FROM team_seasons GROUP BY season_year",
)
_k8 = shrink("prf", "prior_n", "lp", K.LEAGUE_PSEUDOGAMES)
_k8a = shrink("pra", "prior_n", "lp", K.LEAGUE_PSEUDOGAMES)


def calibrated_sql(totals: str) -> str:
    return strengths_sql(
        f"SELECT r.* REPLACE (CASE WHEN prf IS NOT NULL THEN {_k8} END AS prf, CASE WHEN pra IS NOT NULL THEN {_k8a} END AS pra)\n"
        f"FROM ({rates_sql(totals)}) AS r LEFT JOIN league_points AS l ON l.season_year = r.season_year - 1"
    )


cte("calibrated", calibrated_sql("totals"))
cte(
    "regressed",
    strengths_sql(
        f"SELECT r.* REPLACE (lf + {K.PRIOR_CARRYOVER_FOR}::DOUBLE * (prf - lf) AS prf, la + {K.PRIOR_CARRYOVER_AGAINST}::DOUBLE * (pra - la) AS pra)\n"
        f"FROM ({rates_sql('totals')}) AS r LEFT JOIN league_ppg AS l ON l.season_year = r.season_year - 1"
    ),
)
cte(
    "committed",
    """
SELECT game_id, team_id, sum(lost)::BIGINT AS turnovers FROM (
  SELECT game_id, team_id, CASE stat_category WHEN 'passing' THEN try_cast(stat_values[list_position(stat_labels, 'INT')] AS INTEGER)
         ELSE try_cast(stat_values[list_position(stat_labels, 'LOST')] AS INTEGER) END AS lost
  FROM statlines WHERE stat_category IN ('passing', 'fumbles')) AS t
WHERE lost IS NOT NULL GROUP BY game_id, team_id""",
)
cte(
    "margins",
    """
SELECT s.*, (coalesce(o.turnovers, 0) - coalesce(m.turnovers, 0))::BIGINT AS turnover_margin FROM sides AS s
LEFT JOIN committed AS m ON m.game_id = s.game_id AND m.team_id = s.team_id
LEFT JOIN committed AS o ON o.game_id = s.game_id AND o.team_id = s.opponent_id""",
)
cte(
    "form",
    """
SELECT p.team_id, p.season_year, p.cutoff, count(m.game_id) AS margin_n, avg(m.turnover_margin) AS turnover_form
FROM probes AS p LEFT JOIN margins AS m ON m.team_id = p.team_id AND m.season_year = p.season_year
  AND m.kickoff_at < p.cutoff AND m.completed
GROUP BY p.team_id, p.season_year, p.cutoff""",
)
# every team of the season at every cutoff: the brute-force grid
cte(
    "season_teams",
    "SELECT DISTINCT season_year, team_id FROM sides WHERE season_type = 'regular'",
)
cte(
    "grid_probes",
    """
SELECT t.team_id, t.season_year, c.cutoff FROM season_teams AS t
JOIN (SELECT DISTINCT season_year, cutoff FROM probes) AS c ON c.season_year = t.season_year""",
)
cte("grid", strengths_sql(rates_sql(f"({totals_sql('grid_probes')}) AS gt")))
cte(
    "league_strength",
    "SELECT season_year, cutoff, avg(strength) AS league_mean, count(strength) AS league_rated FROM grid GROUP BY season_year, cutoff",
)
cte(
    "met",
    "SELECT season_year, team_id, opponent_id, min(kickoff_at) AS first_met FROM facts GROUP BY season_year, team_id, opponent_id",
)
cte(
    "factors",
    """
SELECT p.team_id, p.season_year, p.cutoff, count(g.strength) AS opponents_rated, any_value(l.league_rated) AS league_rated,
       any_value(l.league_mean) AS league_mean,
       coalesce(avg(g.strength) / any_value(l.league_mean), 1.0) AS factor
FROM probes AS p
JOIN league_strength AS l ON l.season_year = p.season_year AND l.cutoff = p.cutoff
LEFT JOIN met AS m ON m.season_year = p.season_year AND m.team_id = p.team_id AND m.first_met < p.cutoff
LEFT JOIN grid AS g ON g.team_id = m.opponent_id AND g.season_year = p.season_year AND g.cutoff = p.cutoff
GROUP BY p.team_id, p.season_year, p.cutoff""",
)
_hp = pyth(rate("home_cur_pf", "home_cur_n"), rate("home_cur_pa", "home_cur_n"))
_ap = pyth(rate("away_cur_pf", "away_cur_n"), rate("away_cur_pa", "away_cur_n"))


def _wp(side: str) -> str:
    return shrink(rate(f"{side}_cur_wins", f"{side}_cur_n"), f"{side}_cur_n", rate(f"{side}_prior_wins", f"{side}_prior_n"))


def _turnover(side: str) -> str:
    shift = f"{K.POINTS_PER_TURNOVER_MARGIN}::DOUBLE * coalesce({side}_turnover_form, 0) / 2"
    return pyth(
        f"greatest(coalesce({side}_ppg_for, 0) - {shift}, 1e-3::DOUBLE)",
        f"greatest(coalesce({side}_ppg_against, 0) + {shift}, 1e-3::DOUBLE)",
    )


def _sos(side: str) -> str:
    return pyth(
        f"greatest(coalesce({side}_ppg_for, 0) * coalesce({side}_factor, 1), 1e-3::DOUBLE)",
        f"greatest(coalesce({side}_ppg_against, 0) / coalesce({side}_factor, 1), 1e-3::DOUBLE)",
    )


cte(
    "f2",
    f"SELECT game_id, CASE WHEN neutral_site THEN 0.5 ELSE {sigmoid('0.25::DOUBLE')} END AS p, NULL::VARCHAR AS reason FROM test_games",
)
cte(
    "f3",
    f"""
SELECT game_id, CASE WHEN h IS NULL OR a IS NULL THEN '{K.NO_HISTORY}' END AS reason,
       CASE WHEN h IS NOT NULL AND a IS NOT NULL THEN {home_field(log5('greatest(h, 1e-6::DOUBLE)', 'greatest(a, 1e-6::DOUBLE)'))} END AS p
FROM (SELECT *, {_wp('home')} AS h, {_wp('away')} AS a FROM rated) AS r""",
)
cte(
    "f4",
    f"""
SELECT game_id, CASE WHEN home_cur_n = 0 OR away_cur_n = 0 THEN '{K.NO_HISTORY}' WHEN h IS NULL OR a IS NULL THEN '{K.BAD_SCORING}' END AS reason,
       CASE WHEN h IS NOT NULL AND a IS NOT NULL THEN {home_field(log5('h', 'a'))} END AS p
FROM (SELECT *, {_hp} AS h, {_ap} AS a FROM rated) AS r""",
)
cte("rated_form", both_sides("rated", "form", ["turnover_form"]))
cte(
    "f5",
    f"""
SELECT game_id, coalesce(home_reason, away_reason) AS reason,
       CASE WHEN coalesce(home_reason, away_reason) IS NULL THEN {home_field(log5('h', 'a'))} END AS p
FROM (SELECT *, {_turnover('home')} AS h, {_turnover('away')} AS a FROM rated_form) AS r""",
)
cte("rated_factors", both_sides("rated", "factors", ["factor"]))
cte(
    "f6",
    f"""
SELECT game_id, reason, CASE WHEN reason IS NULL THEN {home_field(log5('h', 'a'))} END AS p
FROM (SELECT *, {_sos('home')} AS h, {_sos('away')} AS a,
             CASE WHEN home_reason = '{K.NO_HISTORY}' OR away_reason = '{K.NO_HISTORY}' THEN '{K.NO_HISTORY}'
                  ELSE coalesce(home_reason, away_reason) END AS reason FROM rated_factors) AS r""",
)


def strength_forecast_sql(games: str, strengths: str) -> str:
    inner = both_sides(games, strengths, ["strength", "reason", "cur_n"])
    return (
        f"SELECT *, coalesce(home_reason, away_reason) AS abstain_reason, "
        f"CASE WHEN coalesce(home_reason, away_reason) IS NULL THEN {home_field(log5('home_strength', 'away_strength'))} END AS raw_p\n"
        f"FROM ({inner}) AS s"
    )


cte("f7", strength_forecast_sql("test_games", "regressed"))
cte("f8", strength_forecast_sql("test_games", "calibrated"))
