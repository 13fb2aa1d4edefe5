"""Queries over player usage, impact, availability and the adjusted forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast import constants as K
from gridcast.functions import expr as X
from gridcast.operators import availability as A
from gridcast.operators import candidates as C
from gridcast.operators import evaluation as E
from gridcast.operators import metrics, players
from gridcast.operators.sides import side_probes
from gridcast.plans import sqltext as Q
from gridcast.plans.evaluation_queries import METRICS, losses, metric_outputs
from gridcast.plans.fixtures import Tables
from gridcast.plans.registry import big, cte, off_tie, q6, q_off_tie, qstamp, query, r6, stamp, with_ctes
from gridcast.session import stage

RESAMPLES = K.IMPACT_RESAMPLES

_num = "try_cast(stat_values[{}] AS DOUBLE)"
cte("productions", f"""
SELECT *, CASE stat_category
  WHEN 'passing' THEN 0.04::DOUBLE * {_num.format(2)} + 4.0::DOUBLE * {_num.format(3)} - 2.0::DOUBLE * {_num.format(4)}
  WHEN 'rushing' THEN 0.1::DOUBLE * {_num.format(2)} + 6.0::DOUBLE * {_num.format(3)}
  WHEN 'receiving' THEN 0.1::DOUBLE * {_num.format(2)} + 6.0::DOUBLE * {_num.format(3)}
  WHEN 'defensive' THEN 0.5::DOUBLE * {_num.format(1)} + 2.0::DOUBLE * {_num.format(2)} + 6.0::DOUBLE * {_num.format(3)}
  ELSE 0.0::DOUBLE END AS score FROM statlines""")
cte("scored", """
SELECT p.game_id, g.season_year, g.kickoff_at, p.team_id, p.player_id, p.stat_category AS category, p.score
FROM productions AS p JOIN games AS g ON g.game_id = p.game_id WHERE p.stat_category <> 'fumbles'""")


def usages_sql(probes: str) -> str:
    return f"""
SELECT * FROM (
  SELECT *, total / games AS mean, row_number() OVER (PARTITION BY team_id, season_year, cutoff, player_id ORDER BY total DESC, category) AS k
  FROM (SELECT p.team_id, p.season_year, p.cutoff, s.player_id, s.category, round(sum(s.score), 6) AS total, count(*) AS games
        FROM {probes} AS p JOIN scored AS s ON s.team_id = p.team_id AND s.season_year = p.season_year AND s.kickoff_at < p.cutoff
        GROUP BY ALL) AS t) AS r WHERE k = 1"""


cte("usages", usages_sql("probes"))
cte("chart", """
SELECT *, row_number() OVER (PARTITION BY team_id, season_year, cutoff, category ORDER BY total DESC, player_id) AS place,
       avg(mean) OVER (PARTITION BY team_id, season_year, cutoff, category) AS prior FROM usages""")
cte("starters", f"""
SELECT a.*, b.player_id AS repl, b.games AS repl_games, b.mean AS repl_mean FROM chart AS a
LEFT JOIN chart AS b ON b.team_id = a.team_id AND b.season_year = a.season_year AND b.cutoff = a.cutoff AND b.category = a.category AND b.place = 2
WHERE a.place = 1 AND a.games >= {K.MINIMUM_STARTER_GAMES}""")
cte("game_starters", """
SELECT g.game_id, g.neutral_site, g.side_home AS is_home, g.opponent_id, s.* FROM (
  SELECT game_id, neutral_site, season_year, cutoff, true AS side_home, home_team_id AS tid, away_team_id AS opponent_id FROM test_games
  UNION ALL SELECT game_id, neutral_site, season_year, cutoff, false, away_team_id, home_team_id FROM test_games) AS g
JOIN starters AS s ON s.team_id = g.tid AND s.season_year = g.season_year AND s.cutoff = g.cutoff""")
cte("absent", """
SELECT s.* FROM game_starters AS s ANTI JOIN statlines AS t ON t.game_id = s.game_id AND t.player_id = s.player_id""")
cte("conversion", """
SELECT (SELECT sum(home_score + away_score) FROM games WHERE completed)::DOUBLE / sum(p.score) AS c
FROM productions AS p SEMI JOIN (SELECT game_id FROM games WHERE completed) AS g ON g.game_id = p.game_id""")


def win_sql(pf: str, pa: str) -> str:
    return Q.home_field(Q.log5(Q.pyth(f"greatest({pf}, 1e-3::DOUBLE)", f"greatest({pa}, 1e-3::DOUBLE)"), "opp_strength"))


def impact_rows(source: str) -> str:
    return f"""
SELECT s.*, own.ppg_for, own.ppg_against, opp.strength AS opp_strength FROM {source} AS s
JOIN strengths AS own ON own.team_id = s.team_id AND own.season_year = s.season_year AND own.cutoff = s.cutoff
JOIN strengths AS opp ON opp.team_id = s.opponent_id AND opp.season_year = s.season_year AND opp.cutoff = s.cutoff
WHERE s.repl IS NOT NULL AND own.reason IS NULL AND opp.reason IS NULL"""


def with_without(rows: str, mean: str) -> str:
    kept = Q.shrink(mean, "games", "prior", K.PLAYER_PSEUDOGAMES)
    filled = Q.shrink("repl_mean", "repl_games", "prior", K.PLAYER_PSEUDOGAMES)
    off = "category <> 'defensive'"
    return f"""
SELECT * EXCLUDE (s1, s2), {Q.home_field(Q.log5('s1', 'opp_strength'))} AS p_with, {Q.home_field(Q.log5('s2', 'opp_strength'))} AS p_without FROM (
  SELECT *, {Q.pyth('greatest(ppg_for, 1e-3::DOUBLE)', 'greatest(ppg_against, 1e-3::DOUBLE)')} AS s1,
         {Q.pyth(f'greatest(ppg_for - CASE WHEN {off} THEN gap ELSE 0 END, 1e-3::DOUBLE)', f'greatest(ppg_against + CASE WHEN {off} THEN 0 ELSE gap END, 1e-3::DOUBLE)')} AS s2
  FROM (SELECT *, ({kept} - {filled}) * (SELECT c FROM conversion) AS gap FROM {rows}) AS g) AS h"""


def impacts_sql(rows: str, tag: str) -> str:
    """Chain of CTE bodies estimating the impact of ``rows``."""
    return f"""
SELECT game_id, team_id, player_id, category, is_home, repl, games, avg(p_with - p_without) AS mean_impact, stddev_pop(p_with - p_without) AS stdev
FROM ({with_without(f'''(
  SELECT r.*, m.rm FROM {rows} AS r JOIN {tag} AS m ON m.team_id = r.team_id AND m.season_year = r.season_year
   AND m.player_id = r.player_id AND m.category = r.category AND m.games = r.games) AS x''', 'rm')}) AS w
GROUP BY game_id, team_id, player_id, category, is_home, repl, games"""


def resampled_sql(rows: str) -> str:
    return f"""
SELECT st.team_id, st.season_year, st.player_id, st.category, st.games, d.replicate, sum(l.score) / st.games AS rm
FROM (SELECT DISTINCT team_id, season_year, player_id, category, games FROM {rows}) AS st
JOIN (SELECT games, replicate, floor({Q.uniform(str(K.SEED), 'replicate', 'slot')} * games)::BIGINT AS place
      FROM (SELECT games, replicate, unnest(range(games)) AS slot FROM (SELECT DISTINCT games FROM {rows}) AS q, range({RESAMPLES}) AS r(replicate)) AS z) AS d
  ON d.games = st.games
JOIN (SELECT *, row_number() OVER (PARTITION BY team_id, season_year, player_id, category ORDER BY kickoff_at, game_id, score) - 1 AS place FROM scored) AS l
  ON l.team_id = st.team_id AND l.season_year = st.season_year AND l.player_id = st.player_id AND l.category = st.category AND l.place = d.place
GROUP BY st.team_id, st.season_year, st.player_id, st.category, st.games, d.replicate"""


cte("absent_rows", impact_rows("absent"))
cte("absent_means", resampled_sql("absent_rows"))
cte("absent_impacts", impacts_sql("absent_rows", "absent_means"))
cte("absent_delta", """
SELECT game_id, sum(CASE WHEN is_home THEN -mean_impact ELSE mean_impact END) AS delta, count(*) AS players_out FROM absent_impacts GROUP BY game_id""")


def scored(t: Tables) -> DataFrame:
    return stage(players.scored_statlines(t.statlines(), t.games()))


def tests(t: Tables) -> DataFrame:
    return E.test_set(t.games())


def probes(t: Tables) -> DataFrame:
    return side_probes(tests(t))


def where() -> list:
    return [big("team_id"), big("season_year"), stamp("cutoff")]


WHERE = f"team_id::BIGINT AS team_id, season_year::BIGINT AS season_year, {qstamp('cutoff')} AS cutoff"


@query("m8_production_score", with_ctes(f"SELECT game_id, player_id, line::BIGINT AS line, {q6('score')} AS score FROM productions"))
def _(t: Tables) -> DataFrame:
    score = players.production(F.col("stat_category"), F.col("stat_labels"), F.col("stat_values"))
    return t.statlines().select("game_id", "player_id", big("line"), r6(score, "score"))


@query("p1_player_usage", with_ctes(f"""
WITH changes AS (SELECT DISTINCT team_id, season_year, player_id, kickoff_at FROM scored)
SELECT team_id::BIGINT AS team_id, season_year::BIGINT AS season_year, player_id, {qstamp('kickoff_at')} AS changed_at, category, games, {q6('total')} AS total
FROM (SELECT *, row_number() OVER (PARTITION BY team_id, season_year, player_id, kickoff_at ORDER BY total DESC, category) AS k
      FROM (SELECT c.*, s.category, round(sum(s.score), 6) AS total, count(*) AS games FROM changes AS c
            JOIN scored AS s ON s.team_id = c.team_id AND s.season_year = c.season_year AND s.player_id = c.player_id AND s.kickoff_at <= c.kickoff_at
            GROUP BY ALL) AS u) AS r WHERE k = 1"""))
def _(t: Tables) -> DataFrame:
    return players.usage_timeline(scored(t)).select(
        big("team_id"), big("season_year"), "player_id", stamp("changed_at"), "category", big("games"), r6("total"))


cte("year_end", "SELECT DISTINCT team_id, season_year, make_timestamp(season_year + 1, 1, 1, 0, 0, 0.0) AS cutoff FROM scored")
cte("end_usages", usages_sql("year_end"))


def end_usages(t: Tables) -> DataFrame:
    s = scored(t)
    ends = t.games().select("season_year").distinct().withColumn(
        "cutoff", F.make_timestamp_ntz(F.col("season_year") + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return players.usages_at(s, ends)


@query("p2_replacement", with_ctes("""
SELECT u.team_id::BIGINT AS team_id, u.season_year::BIGINT AS season_year, u.player_id,
       (SELECT o.player_id FROM end_usages AS o WHERE o.team_id = u.team_id AND o.season_year = u.season_year AND o.category = u.category
          AND o.player_id <> u.player_id ORDER BY o.total DESC, o.player_id LIMIT 1) AS replacement_id FROM end_usages AS u"""))
def _(t: Tables) -> DataFrame:
    return players.replacements(end_usages(t), ["team_id", "season_year", "category"]).select(
        big("team_id"), big("season_year"), "player_id", "replacement_id")


@query("p3_usual_starters", with_ctes(f"SELECT {WHERE}, category, player_id, games, {q6('total')} AS total FROM starters"))
def _(t: Tables) -> DataFrame:
    return players.usual_starters(players.depth_chart(probes(t), scored(t))).select(
        *where(), "category", "player_id", big("games"), r6("total"))


@query("p4_category_prior", with_ctes(f"SELECT {WHERE}, category, count(*) AS players, {q_off_tie('avg(mean)')} AS category_mean FROM usages GROUP BY ALL"))
def _(t: Tables) -> DataFrame:
    s = scored(t)
    chart = players.depth_chart(probes(t), s).filter("place = 1")
    return players.category_prior(chart, s).select(*where(), "category", big("players"), off_tie("category_mean"))


@query("p5_player_shrinkage", with_ctes(f"""
SELECT {WHERE}, category, player_id, {q_off_tie(Q.shrink('mean', 'games', 'prior', K.PLAYER_PSEUDOGAMES))} AS shrunk_mean FROM starters"""))
def _(t: Tables) -> DataFrame:
    s = scored(t)
    # staged, as it is read on both sides of the join
    starters = stage(players.usual_starters(players.depth_chart(probes(t), s)))
    known = starters.join(players.category_prior(starters, s), ["team_id", "season_year", "cutoff", "category"])
    shrunk = X.shrink(F.col("mean"), F.col("games"), F.col("category_mean"), K.PLAYER_PSEUDOGAMES)
    return known.select(*where(), "category", "player_id", off_tie(shrunk, "shrunk_mean"))


@query("p6_with_and_without", with_ctes(f"""
WITH start_rows AS ({impact_rows('game_starters')})
SELECT game_id, team_id::BIGINT AS team_id, player_id, category, {q6('p_with')} AS p_with, {q6('p_without')} AS p_without
FROM ({with_without('start_rows', 'mean')}) AS w"""))
def _(t: Tables) -> DataFrame:
    table = players.starter_table(tests(t), scored(t)).filter(F.col("replacement_id").isNotNull())
    rows = players._with_strengths(table, tests(t), t.games(), K.PYTHAGOREAN_EXPONENT)
    conversion = players.points_per_production(t.statlines(), t.games()).scalar()
    return players.with_and_without(rows, F.col("mean"), conversion).select(
        "game_id", big("team_id"), "player_id", "category", r6("p_with"), r6("p_without"))


@query("j5_missing_starters", with_ctes("SELECT game_id, team_id::BIGINT AS team_id, category, player_id FROM absent"))
def _(t: Tables) -> DataFrame:
    table = players.starter_table(tests(t), scored(t))
    return players.missing_from_box_score(table, t.statlines()).select("game_id", big("team_id"), "category", "player_id")


def impacts(t: Tables) -> DataFrame:
    return C.missing_starter_impacts(t.games(), t.statlines(), tests(t), RESAMPLES)


@query("p7_player_impact", with_ctes(f"""
SELECT game_id, team_id::BIGINT AS team_id, player_id, category, repl AS replacement_id, {q6('mean_impact')} AS mean_impact, {q6('stdev')} AS impact_stdev FROM absent_impacts"""))
def _(t: Tables) -> DataFrame:
    return impacts(t).filter(F.col("abstain_reason").isNull()).select(
        "game_id", big("team_id"), "player_id", "category", "replacement_id", r6("mean_impact"), r6("impact_stdev"))


@query("p7_abstained_impacts", with_ctes(f"""
SELECT s.game_id, s.team_id::BIGINT AS team_id, s.player_id, s.category, s.repl AS replacement_id,
       CASE WHEN s.repl IS NULL THEN '{K.NO_REPLACEMENT}' ELSE coalesce(own.reason, opp.reason) END AS abstain_reason FROM absent AS s
JOIN strengths AS own ON own.team_id = s.team_id AND own.season_year = s.season_year AND own.cutoff = s.cutoff
JOIN strengths AS opp ON opp.team_id = s.opponent_id AND opp.season_year = s.season_year AND opp.cutoff = s.cutoff
WHERE s.repl IS NULL OR own.reason IS NOT NULL OR opp.reason IS NOT NULL"""))
def _(t: Tables) -> DataFrame:
    return impacts(t).filter(F.col("abstain_reason").isNotNull()).select("game_id", big("team_id"), "player_id", "category", "replacement_id", "abstain_reason")


cte("injured", f"""
SELECT b.game_id, b.season_year, b.week, b.is_tie, b.home_won, b.abstain_reason, b.p, d.delta,
       CASE WHEN b.p IS NOT NULL THEN {Q.clamp('b.p + coalesce(d.delta, 0)')} END AS hurt
FROM baseline AS b LEFT JOIN absent_delta AS d ON d.game_id = b.game_id""")


@query("f10_missing_starter_forecast", with_ctes(f"SELECT game_id, {q6('delta')} AS injury_delta, {q6('hurt')} AS p FROM injured"))
def _(t: Tables) -> DataFrame:
    base = E.baseline_samples(t.games())
    df = base.join(players.game_delta(impacts(t)), "game_id", "left")
    return df.select("game_id", r6("injury_delta"), r6(players.shift_probability(F.col("p"), F.col("injury_delta")), "p"))


cte("blends", f"""
SELECT i.*, t.p AS turnover, t.reason AS treason, s.p AS sos, s.reason AS sreason,
  CASE WHEN i.p IS NOT NULL THEN {Q.clamp(Q.sigmoid(
      f"{Q.logit('i.p')} + ({Q.logit('coalesce(t.p, i.p)')} - {Q.logit('i.p')}) + ({Q.logit('coalesce(s.p, i.p)')} - {Q.logit('i.p')})"
  ) + ' + coalesce(delta, 0)')} END AS blended
FROM injured AS i JOIN f5 AS t ON t.game_id = i.game_id JOIN f6 AS s ON s.game_id = i.game_id""")


@query("f11_blend", with_ctes(f"SELECT game_id, {q6('blended')} AS p FROM blends"))
def _(t: Tables) -> DataFrame:
    return C.candidate_forecasts(t.games(), t.statlines(), resamples=RESAMPLES).select("game_id", r6("blended", "p"))


cte("candidate_long", f"""
SELECT game_id, is_tie, home_won, model, p, CASE WHEN abstain_reason IS NOT NULL THEN abstain_reason WHEN p IS NULL THEN '{K.NO_HISTORY}' END AS reason FROM (
  SELECT game_id, is_tie, home_won, abstain_reason, 'baseline' AS model, p FROM blends
  UNION ALL SELECT game_id, is_tie, home_won, abstain_reason, 'injuries_only', hurt FROM blends
  UNION ALL SELECT game_id, is_tie, home_won, abstain_reason, 'turnover_only', turnover FROM blends
  UNION ALL SELECT game_id, is_tie, home_won, abstain_reason, 'sos_only', sos FROM blends
  UNION ALL SELECT game_id, is_tie, home_won, abstain_reason, 'blended', blended FROM blends) AS u""")


@query("e12_candidate_comparison", with_ctes(f"SELECT model, {METRICS} FROM ({losses('candidate_long')}) AS l GROUP BY model"))
def _(t: Tables) -> DataFrame:
    df = C.candidate_forecasts(t.games(), t.statlines(), resamples=RESAMPLES)
    return metrics.score(C.candidate_samples(df), ["model"]).select("model", *metric_outputs())


cte("missing_long", f"""
SELECT b.is_tie, b.home_won, 'baseline' AS model, b.p, b.abstain_reason AS reason FROM baseline AS b JOIN absent_delta AS d ON d.game_id = b.game_id
 WHERE b.abstain_reason IS NULL AND NOT b.is_tie
UNION ALL SELECT b.is_tie, b.home_won, 'adjusted', {Q.clamp('b.p + d.delta')}, b.abstain_reason FROM baseline AS b JOIN absent_delta AS d ON d.game_id = b.game_id
 WHERE b.abstain_reason IS NULL AND NOT b.is_tie""")


@query("e21_missing_starter_evaluation", with_ctes(f"SELECT model, {METRICS} FROM ({losses('missing_long')}) AS l GROUP BY model"))
def _(t: Tables) -> DataFrame:
    return C.missing_starter_scores(impacts(t), E.baseline_samples(t.games())).select("model", *metric_outputs())


@query("e21_games", with_ctes("""
SELECT (SELECT count(*) FROM baseline) AS games_considered,
  (SELECT count(*) FROM baseline AS b JOIN absent_delta AS d ON d.game_id = b.game_id WHERE b.abstain_reason IS NULL AND NOT b.is_tie) AS games_with_missing_starters"""))
def _(t: Tables) -> DataFrame:
    return C.missing_starter_games(t.games(), t.statlines(), tests(t), E.baseline_samples(t.games()))


@query("e21_samples_by_category", with_ctes("""
SELECT a.category, count(*) AS samples FROM absent_impacts AS a JOIN baseline AS b ON b.game_id = a.game_id
WHERE b.abstain_reason IS NULL AND NOT b.is_tie GROUP BY a.category"""))
def _(t: Tables) -> DataFrame:
    counted = E.baseline_samples(t.games()).filter(metrics.is_scored()).select("game_id")
    return impacts(t).filter(F.col("abstain_reason").isNull()).join(counted, "game_id", "left_semi").groupBy("category").agg(F.count(F.lit(1)).alias("samples"))


# --- availability -------------------------------------------------------------------

_class_rank = "list_position([" + ", ".join(f"'{c}'" for c in K.REPORT_CLASSES) + "], report_class)"


def _status_case() -> str:
    arms = []
    for c, by_text in K.STATUS_TEXT.items():
        for text, s in by_text.items():
            arms.append(f"WHEN report_class = '{c}' AND words = '{text}' THEN '{s}'")
    return (
        "CASE " + " ".join(arms)
        + " WHEN report_class = 'in_game_incident' AND words LIKE '%return%' AND words NOT LIKE '%question%' AND words NOT LIKE '%doubt%' THEN 'returned'"
        + " WHEN report_class = 'in_game_incident' AND (words LIKE '%left%' OR words LIKE '%exit%') THEN 'left_game'"
        + " WHEN report_class = 'in_game_incident' THEN 'tentative' END"
    )


def live_sql(reports: str) -> str:
    return (
        f"SELECT *, greatest(event_time, retrieved_at) AS visible_at, {_status_case()} AS status, report_class IN ('gameday_inactive', 'roster_status') AS official "
        f"FROM (SELECT *, lower(trim(status_text)) AS words FROM {reports}) AS w"
    )


cte("mapped_reports", live_sql("reports"))
cte("live", "SELECT * FROM mapped_reports WHERE correction_state <> 'retracted'")
cte("decisions", """
SELECT player_id, as_of FROM (SELECT DISTINCT player_id FROM reports) AS p,
  (SELECT TIMESTAMP '2024-01-01 12:00:00' + to_days(i::INTEGER) AS as_of FROM range(31) AS r(i)) AS d""")


def seen_sql(decisions: str, live: str) -> str:
    return f"SELECT d.as_of, r.* FROM {decisions} AS d JOIN {live} AS r ON r.player_id = d.player_id AND r.visible_at <= d.as_of"


def confirm_sql(decisions: str, seen: str, keys: list[str]) -> str:
    """Confirmation per decision by looking at every pair of visible reports."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in [*keys, "as_of"])
    cols = ", ".join(f"{{0}}.{k}" for k in [*keys, "as_of"])
    return f"""
SELECT {cols.format('d')}, CASE WHEN basis IS NULL THEN 'tentative' WHEN basis + INTERVAL 24 HOUR < d.as_of THEN 'stale' ELSE 'confirmed' END AS confirmation
FROM {decisions} AS d LEFT JOIN (
  SELECT {cols.format('q')}, coalesce(max(q.event_time) FILTER (WHERE q.official), any_value(a.latest)) AS basis
  FROM {seen} AS q LEFT JOIN (
    SELECT {cols.format('w')}, min_by(w.latest, w.event_time) AS latest FROM (
      SELECT {cols.format('x')}, x.event_time, max(y.event_time) AS latest, count(DISTINCT y.source) AS n
      FROM {seen} AS x JOIN {seen} AS y ON {on('x', 'y')} AND NOT y.official
        AND y.event_time BETWEEN x.event_time - INTERVAL 2 HOUR AND x.event_time + INTERVAL 2 HOUR
      WHERE NOT x.official GROUP BY {cols.format('x')}, x.report_id, x.event_time) AS w
    WHERE n >= 2 GROUP BY ALL) AS a ON {on('q', 'a')}
  GROUP BY {cols.format('q')}) AS b ON {on('d', 'b')}"""


def resolved_sql(decisions: str, seen: str, top: str, settled: str) -> str:
    status = "list_distinct(list(q.status) FILTER (WHERE q.status IS NOT NULL))"
    return f"""
SELECT d.player_id, d.as_of, t.report_class, coalesce(t.n, 0) AS reports,
  CASE WHEN t.report_class IS NULL THEN 'no visible report' WHEN k = 0 THEN 'no recognized status' WHEN k > 1 THEN 'conflicting statuses'
       WHEN c.confirmation = 'stale' THEN 'stale' WHEN c.confirmation = 'tentative' THEN 'not corroborated' END AS reason,
  CASE WHEN k = 1 THEN c.confirmation END AS confirmation,
  CASE WHEN k = 1 AND c.confirmation = 'confirmed' THEN one WHEN k = 1 AND c.confirmation = 'tentative' THEN 'tentative' ELSE 'unknown' END AS status
FROM {decisions} AS d LEFT JOIN (
  SELECT q.player_id, q.as_of, any_value(q.report_class) AS report_class, count(*) AS n, count(DISTINCT q.status) AS k, any_value(q.status) AS one
  FROM {seen} AS q JOIN {top} AS m ON m.player_id = q.player_id AND m.as_of = q.as_of AND m.report_class = q.report_class
  GROUP BY q.player_id, q.as_of) AS t ON t.player_id = d.player_id AND t.as_of = d.as_of
LEFT JOIN {settled} AS c ON c.player_id = d.player_id AND c.as_of = d.as_of AND c.report_class = t.report_class"""


cte("seen", seen_sql("decisions", "live"))
cte("top_class", f"SELECT player_id, as_of, arg_min(report_class, {_class_rank}) AS report_class FROM seen GROUP BY ALL")
cte("confirmed_players", confirm_sql("decisions", "seen", ["player_id"]))
cte("class_settled", confirm_sql("top_class", "seen", ["player_id", "report_class"]))
cte("resolved", resolved_sql("decisions", "seen", "top_class", "class_settled"))


def decisions(t: Tables) -> DataFrame:
    days = F.sequence(F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"), F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"), F.expr("INTERVAL 1 DAY"))
    return t.reports().select("player_id").distinct().withColumn("as_of", F.explode(days))


@query("m9_status_text", with_ctes("SELECT report_id, report_class, status FROM mapped_reports"))
def _(t: Tables) -> DataFrame:
    return t.reports().select("report_id", "report_class", A.status_of_text(F.col("report_class"), F.col("status_text")).alias("status"))


@query("j9_corroboration", with_ctes(f"""
SELECT x.report_id, {qstamp('greatest(x.visible_at, min(y.visible_at))')} AS corroborated_at FROM live AS x JOIN live AS y
  ON y.player_id = x.player_id AND y.source <> x.source AND NOT y.official AND NOT x.official
  AND y.event_time BETWEEN x.event_time - INTERVAL 2 HOUR AND x.event_time + INTERVAL 2 HOUR
GROUP BY x.report_id, x.visible_at"""))
def _(t: Tables) -> DataFrame:
    unofficial = A.with_official(t.reports()).filter("not official")
    return A.corroborated_at(unofficial, ["player_id"]).select("report_id", stamp("corroborated_at"))


@query("p9_visible_reports", with_ctes(f"""
SELECT {qstamp('d.as_of')} AS as_of, r.player_id, r.report_id FROM (
  SELECT player_id, max(event_time) - INTERVAL 3 DAY AS as_of FROM reports GROUP BY player_id) AS d
JOIN reports AS r ON r.player_id = d.player_id AND greatest(r.event_time, r.retrieved_at) <= d.as_of"""))
def _(t: Tables) -> DataFrame:
    asked = t.reports().groupBy("player_id").agg((F.max("event_time") - F.expr("INTERVAL 3 DAY")).alias("as_of"))
    return A.visible_reports(asked, t.reports()).select(stamp("as_of"), "player_id", "report_id")


@query("p9_visible_prefix", with_ctes(f"""
SELECT {qstamp('d.as_of')} AS as_of, d.player_id, count(r.report_id) AS reports FROM decisions AS d
LEFT JOIN reports AS r ON r.player_id = d.player_id AND greatest(r.event_time, r.retrieved_at) <= d.as_of GROUP BY d.player_id, d.as_of"""))
def _(t: Tables) -> DataFrame:
    return A.visible_prefix(decisions(t), t.reports()).select(stamp("as_of"), "player_id", "reports")


@query("p9_report_positions", with_ctes("""
SELECT report_id, player_id, report_class, row_number() OVER (PARTITION BY player_id, report_class ORDER BY visible_at, report_id) AS position FROM live"""))
def _(t: Tables) -> DataFrame:
    return A.report_positions(A.live_reports(t.reports()), ["player_id", "report_class"]).select("report_id", "player_id", "report_class", "position")


@query("p10_confirmation", with_ctes(f"SELECT player_id, {qstamp('as_of')} AS as_of, confirmation, confirmation = 'confirmed' AS executable FROM confirmed_players"))
def _(t: Tables) -> DataFrame:
    return A.confirm_players(decisions(t), t.reports()).select("player_id", stamp("as_of"), "confirmation", "executable")


@query("p11_availability", with_ctes(f"""
SELECT r.player_id, {qstamp('r.as_of')} AS as_of, r.report_class, r.reports, r.status, r.confirmation, r.reason, coalesce(i.ids, '') AS report_ids
FROM resolved AS r LEFT JOIN (
  SELECT q.player_id, q.as_of, array_to_string(list_sort(list(q.report_id)), ',') AS ids FROM seen AS q
  JOIN top_class AS m ON m.player_id = q.player_id AND m.as_of = q.as_of AND m.report_class = q.report_class
  GROUP BY q.player_id, q.as_of) AS i ON i.player_id = r.player_id AND i.as_of = r.as_of"""))
def _(t: Tables) -> DataFrame:
    resolved = stage(A.resolve_availability(decisions(t), t.reports()))
    return A.with_report_ids(resolved, t.reports()).select(
        "player_id", stamp("as_of"), "report_class", big("reports"), "status", "confirmation", "reason",
        F.array_join(F.col("report_ids").cast("array<string>"), ",").alias("report_ids"))


cte("season_live", f"SELECT * FROM ({live_sql('season_reports')}) AS l WHERE correction_state <> 'retracted'")
cte("starter_decisions", "SELECT DISTINCT player_id, cutoff AS as_of FROM game_starters")
cte("starter_seen", seen_sql("starter_decisions", "season_live"))
cte("starter_top", f"SELECT player_id, as_of, arg_min(report_class, {_class_rank}) AS report_class FROM starter_seen GROUP BY ALL")
# the pairwise check below is only run on classes without an official word, as an official report settles alone
cte("starter_settled", f"""
SELECT t.player_id, t.report_class, t.as_of, CASE WHEN max(q.event_time) + INTERVAL 24 HOUR < t.as_of THEN 'stale' ELSE 'confirmed' END AS confirmation
FROM starter_top AS t JOIN starter_seen AS q ON q.player_id = t.player_id AND q.as_of = t.as_of AND q.report_class = t.report_class AND q.official
GROUP BY t.player_id, t.as_of, t.report_class
UNION ALL
{confirm_sql("(SELECT * FROM starter_top WHERE report_class NOT IN ('gameday_inactive', 'roster_status'))",
             "(SELECT s.* FROM starter_seen AS s JOIN starter_top AS tt ON tt.player_id = s.player_id AND tt.as_of = s.as_of AND tt.report_class = s.report_class WHERE NOT s.official)",
             ["player_id", "report_class"])}""")
cte("starter_resolved", resolved_sql("starter_decisions", "starter_seen", "starter_top", "starter_settled"))
cte("out_starters", """
SELECT g.* FROM game_starters AS g JOIN starter_resolved AS r ON r.player_id = g.player_id AND r.as_of = g.cutoff AND r.status IN ('out', 'inactive')""")
cte("out_rows", impact_rows("out_starters"))
cte("out_means", resampled_sql("out_rows"))
cte("out_impacts", impacts_sql("out_rows", "out_means"))


@query("p8_injury_adjustment", with_ctes(f"""
SELECT b.game_id, d.players_out, coalesce(d.ids, '') AS adjusted_players, {q6('d.delta')} AS injury_delta,
  CASE WHEN b.abstain_reason IS NULL THEN CASE WHEN d.delta IS NULL THEN {q6('b.p')}
       ELSE {q6(Q.clamp(Q.home_field(Q.log5('b.home_strength', 'b.away_strength')) + ' + d.delta'))} END END AS adjusted_probability,
  coalesce(b.abstain_reason, CASE WHEN d.delta IS NULL THEN 'no starter out' END) AS reason
FROM baseline AS b LEFT JOIN (SELECT game_id, count(*) AS players_out, array_to_string(list_sort(list(player_id)), ',') AS ids,
                              sum(CASE WHEN is_home THEN -mean_impact ELSE mean_impact END) AS delta
                         FROM out_impacts GROUP BY game_id) AS d ON d.game_id = b.game_id"""))
def _(t: Tables) -> DataFrame:
    df = C.injury_adjusted_forecast(tests(t), t.games(), t.statlines(), t.season_reports(), RESAMPLES)
    reason = F.coalesce("abstain_reason", F.when(F.col("injury_delta").isNull(), F.lit("no starter out")))
    ids = F.coalesce(F.array_join(F.col("adjusted_players").cast("array<string>"), ","), F.lit("")).alias("adjusted_players")
    return df.select("game_id", big("players_out"), ids, r6("injury_delta"), "adjusted_probability", reason.alias("reason"))
