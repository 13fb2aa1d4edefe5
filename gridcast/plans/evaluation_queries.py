"""Queries over metrics, evaluations, resampling and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast import constants as K
from gridcast.operators import evaluation as E
from gridcast.operators import metrics, resample, significance
from gridcast.plans import sqltext as Q
from gridcast.plans.fixtures import Tables
from gridcast.plans.registry import big, cte, off_tie, q6, q_off_tie, qstamp, query, r6, stamp, with_ctes

cte("model_samples", """
SELECT game_id, season_year, week, kickoff_at, home_team_id, away_team_id, is_tie, home_won,
       'model' AS model, p, abstain_reason AS reason FROM baseline""")
cte("all_samples", "SELECT game_id, season_year, week, is_tie, home_won, model, p, reason FROM model_samples\n" + "\n".join(
    f"UNION ALL SELECT g.game_id, season_year, week, is_tie, home_won, '{name}', f.p, f.reason FROM test_games AS g JOIN {src} AS f ON f.game_id = g.game_id"
    for name, src in (("home_field_only", "f2"), ("prior_win_pct", "f3"), ("raw_pythagorean", "f4"),
                      ("turnover_normalized", "f5"), ("sos_adjusted", "f6"))))


def losses(samples: str) -> str:
    return (
        "SELECT *, CASE WHEN ok THEN pow(p - home_won, 2) END AS se, "
        f"CASE WHEN ok THEN {Q.loss('p', 'home_won')} END AS ll, "
        "CASE WHEN ok THEN ((p >= 0.5) = (home_won = 1))::INTEGER::DOUBLE END AS hit\n"
        f"FROM (SELECT *, reason IS NULL AND NOT is_tie AS ok FROM {samples}) AS s"
    )


METRICS = (f"count(se) AS sample_count, count(*) - count(se) AS excluded_count, {q6('avg(se)')} AS brier, "
           f"{q6('avg(ll)')} AS log_loss, {q6('avg(hit)')} AS accuracy")
cte("model_losses", losses("model_samples"))
cte("all_losses", losses("all_samples"))


def metric_outputs() -> list:
    return [big("sample_count"), big("excluded_count"), r6("brier"), r6("log_loss"), r6("accuracy")]


def samples(t: Tables) -> DataFrame:
    return E.baseline_samples(t.games())


@query("walk_forward_brier", with_ctes(f"SELECT season_year::BIGINT AS season_year, {METRICS} FROM model_losses GROUP BY season_year"))
def walk_forward_brier(t: Tables) -> DataFrame:
    return metrics.score(samples(t), ["season_year"]).select(big("season_year"), *metric_outputs())


@query("e1_brier", with_ctes(f"SELECT model, {q6('avg(se)')} AS brier FROM model_losses GROUP BY model"))
def _(t: Tables) -> DataFrame:
    return metrics.score(samples(t), ["model"]).select("model", r6("brier"))


@query("e2_log_loss", with_ctes(f"SELECT week::BIGINT AS week, {q6('avg(ll)')} AS log_loss FROM model_losses GROUP BY week"))
def _(t: Tables) -> DataFrame:
    return metrics.score(samples(t), ["week"]).select(big("week"), r6("log_loss"))


@query("e3_accuracy", with_ctes(f"SELECT season_year::BIGINT AS season_year, {q6('avg(hit)')} AS accuracy FROM model_losses GROUP BY season_year"))
def _(t: Tables) -> DataFrame:
    return metrics.score(samples(t), ["season_year"]).select(big("season_year"), r6("accuracy"))


@query("e4_reliability_bins", with_ctes(f"""
SELECT bin::BIGINT AS bin, count(*) AS n, {q6('avg(p)')} AS mean_predicted, {q6('avg(home_won)')} AS actual_rate
FROM model_losses JOIN (SELECT i AS bin, i * 0.1::DOUBLE AS lo, (i + 1) * 0.1::DOUBLE AS hi FROM range(10) AS r(i)) AS b
  ON p >= lo AND (p < hi OR (bin = 9 AND p >= hi))
WHERE ok GROUP BY bin"""))
def _(t: Tables) -> DataFrame:
    return metrics.reliability(samples(t)).select(big("bin"), big("n"), r6("mean_predicted"), r6("actual_rate"))


_R = K.BOOTSTRAP_RESAMPLES
_STEPS = " + ".join(f"(u >= {step})::INTEGER" for step in resample.poisson_steps())


def replicate_means(rows: str, keys: str) -> str:
    """SQL for the weighted means of se and ll of the scored ``rows`` in each replicate, by ``keys``."""
    return f"""
  SELECT {keys}, replicate, sum(w * se) / sum(w) AS se, sum(w * ll) / sum(w) AS ll FROM (
    SELECT *, {_STEPS} AS w FROM (
      SELECT *, (a * h + c) % {resample.PRIME} AS u FROM (
        SELECT *, ('0x' || substr(md5('{K.SEED}|' || game_id), 1, 8))::BIGINT % {resample.PRIME} AS h FROM {rows} WHERE ok
      ) AS hashed, (
        SELECT replicate, ('0x' || substr(d, 1, 8))::BIGINT % {resample.PRIME - 1} + 1 AS a, ('0x' || substr(d, 9, 8))::BIGINT % {resample.PRIME} AS c
        FROM (SELECT i AS replicate, md5('{K.SEED}|' || i) AS d FROM range({_R}) AS q(i)) AS q) AS r) AS drawn) AS weighted
  GROUP BY {keys}, replicate HAVING sum(w) > 0"""


def _end(value: str, place: str) -> str:
    return f"list_sort(list({value}))[{place}]"


_LOW, _HIGH = "greatest(0, floor(count(*) * (2.5 / 100)::DOUBLE)::INTEGER - 1) + 1", "least(count(*) - 1, floor(count(*) * (97.5 / 100)::DOUBLE)::INTEGER) + 1"


def intervals(keys: str, source: str) -> str:
    ends = ", ".join(f"{_end(v, place)} AS {v}_{name}" for v in ("se", "ll") for name, place in (("low", _LOW), ("high", _HIGH)))
    return f"SELECT {keys}, {ends} FROM {source} GROUP BY {keys}"


@query("e5_bootstrap_interval", with_ctes(f"""
WITH placed AS (
  SELECT model, se, ll, row_number() OVER (PARTITION BY model ORDER BY md5('{K.SEED}|' || game_id), game_id) - 1 AS pos, count(*) OVER (PARTITION BY model) AS n
  FROM model_losses WHERE ok),
draws AS (
  SELECT model, r.replicate, floor({Q.uniform(str(K.SEED), 'r.replicate', 'pos')} * n)::BIGINT AS pos
  FROM placed, (SELECT i AS replicate FROM range({_R}) AS q(i)) AS r),
reps AS (SELECT model, replicate, avg(se) AS se, avg(ll) AS ll FROM draws JOIN placed USING (model, pos) GROUP BY model, replicate),
ends AS ({intervals('model', 'reps')})
SELECT model, {q6('se_low')} AS squared_error_low, {q6('se_high')} AS squared_error_high, {q6('ll_low')} AS log_loss_low, {q6('ll_high')} AS log_loss_high
FROM ends WHERE (SELECT count(se) FROM model_losses) >= 2"""))
def _(t: Tables) -> DataFrame:
    scored = metrics.with_losses(samples(t)).filter(metrics.is_scored())
    got = resample.drawn_interval(scored.select("model", "game_id", "squared_error", "log_loss"), "game_id", ["model"], ["squared_error", "log_loss"])
    return got.select("model", *[r6(f"{v}_{e}") for v in ("squared_error", "log_loss") for e in ("low", "high")])


def metric_sets_sql(rows: str) -> str:
    """SQL for the whole metric set of ``rows`` per model, per model and season, and per model and week, each grouping on its own."""
    return f"""
WITH sets AS (
  SELECT *, 0 AS grouping, -1 AS s, -1 AS k FROM {rows} UNION ALL SELECT *, 1, season_year, -1 FROM {rows} UNION ALL SELECT *, 2, -1, week FROM {rows}
), base AS (
  SELECT grouping, model, s, k, {METRICS}, count(*) FILTER (WHERE is_tie) AS ties, count(*) FILTER (WHERE NOT is_tie AND reason = '{K.NO_HISTORY}') AS no_history,
         count(*) FILTER (WHERE NOT is_tie AND reason = '{K.BAD_SCORING}') AS bad_scoring FROM sets GROUP BY grouping, model, s, k
), binned AS (
  SELECT grouping, model, s, k, bin, count(*) AS n, sum(p) AS sp, sum(home_won)::BIGINT AS won
  FROM sets JOIN (SELECT i AS bin, i * 0.1::DOUBLE AS lo, (i + 1) * 0.1::DOUBLE AS hi FROM range(10) AS r(i)) AS b ON p >= lo AND (p < hi OR (bin = 9 AND p >= hi))
  WHERE ok GROUP BY grouping, model, s, k, bin
), bins AS (
  SELECT grouping, model, s, k, string_agg(bin || ':' || n || ':' || round(sp * 1000000)::BIGINT || ':' || won, ' ' ORDER BY bin) AS reliability
  FROM binned GROUP BY grouping, model, s, k
), reps AS ({replicate_means('sets', 'grouping, model, s, k')}
), ends AS ({intervals('grouping, model, s, k', 'reps')}
)
SELECT base.grouping::BIGINT AS grouping, base.model, base.s::BIGINT AS season_year, base.k::BIGINT AS week, sample_count, excluded_count, brier, log_loss, accuracy, ties, no_history, bad_scoring,
       coalesce(reliability, '') AS reliability, {', '.join(f"CASE WHEN sample_count >= 2 THEN {q6(c)} END AS {n}" for c, n in (('se_low', 'brier_low'), ('se_high', 'brier_high'), ('ll_low', 'log_loss_low'), ('ll_high', 'log_loss_high')))}
FROM base LEFT JOIN bins ON (base.grouping, base.model, base.s, base.k) = (bins.grouping, bins.model, bins.s, bins.k)
LEFT JOIN ends ON (base.grouping, base.model, base.s, base.k) = (ends.grouping, ends.model, ends.s, ends.k)"""


def set_outputs() -> list:
    reason = lambda name: F.coalesce(F.try_element_at("exclusion_reasons", F.lit(name)), F.lit(0))
    # Bins are shown by their sums: means of a few six-digit numbers would end in rounding ties.
    parts = lambda b: F.concat_ws(":", b["bin"], b["n"], F.round(b["mean_predicted"] * b["n"] * 1000000).cast("bigint"), F.round(b["actual_rate"] * b["n"]).cast("bigint"))
    return [
        *metric_outputs(), *[r6(c) for c in ("brier_low", "brier_high", "log_loss_low", "log_loss_high")], big(reason("tie"), "ties"),
        big(reason(K.NO_HISTORY), "no_history"), big(reason(K.BAD_SCORING), "bad_scoring"), F.array_join(F.transform("reliability", parts), " ").alias("reliability"),
    ]


def whole_sets(samples: DataFrame) -> DataFrame:
    whole = [big(F.coalesce(c, F.lit(-1)), c) for c in ("season_year", "week")]
    return E.walk_forward_report(samples).select(big("grouping"), "model", *whole, *set_outputs())


@query("e6_metric_set", with_ctes(f"SELECT * EXCLUDE (grouping, model, week) FROM ({metric_sets_sql('model_losses')}) AS m WHERE grouping = 1"))
def _(t: Tables) -> DataFrame:
    return metrics.metric_set(samples(t), ["season_year"]).select(big("season_year"), *set_outputs())


@query("e7_metrics_grouping_sets", with_ctes(metric_sets_sql("model_losses")))
def _(t: Tables) -> DataFrame:
    return whole_sets(samples(t))


@query("e8_walk_forward", with_ctes(metric_sets_sql("all_losses")))
def _(t: Tables) -> DataFrame:
    return whole_sets(E.walk_forward_samples(t.games(), t.statlines()))


def written(column: str) -> str:
    return f"coalesce(length({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


@query("e9_dataset_checksum", with_ctes(f"""
SELECT n, sha256(concat_ws('|', n::VARCHAR, a::VARCHAR, b::VARCHAR)) AS checksum FROM (
  SELECT count(*) AS n, sum(('0x' || substr(h, 1, 13))::UBIGINT::HUGEINT) AS a, sum(('0x' || substr(h, 14, 13))::UBIGINT::HUGEINT) AS b
  FROM (SELECT sha256(concat_ws('|', {written('game_id')}, {written('home_score')}, {written('away_score')})) AS h FROM test_games) AS r) AS s"""))
def _(t: Tables) -> DataFrame:
    return metrics.fingerprint(E.test_set(t.games()), ["game_id", "home_score", "away_score"])


_MARGIN = (f"count(predicted) AS sample_count, count(*) - count(predicted) AS excluded_count, {q6('avg(abs(actual - predicted))')} AS mae, "
           f"{q6('sqrt(avg(pow(actual - predicted, 2)))')} AS rmse, {q6('var_samp(actual - predicted)')} AS residual_variance, "
           f"{q6('stddev_samp(actual - predicted)')} AS residual_stdev")
cte("margin_long", """
SELECT season_year, 'model' AS model, expected_margin AS predicted, (home_score - away_score)::DOUBLE AS actual FROM f9
UNION ALL SELECT season_year, 'home_field_only', home_only, (home_score - away_score)::DOUBLE FROM f9
UNION ALL SELECT season_year, 'always_zero', 0.0, (home_score - away_score)::DOUBLE FROM f9""")


def margin_outputs() -> list:
    return [big("sample_count"), big("excluded_count"), r6("mae"), r6("rmse"), r6("residual_variance"), r6("residual_stdev")]


@query("e10_margin_metrics", with_ctes(f"SELECT season_year::BIGINT AS season_year, {_MARGIN} FROM margin_long WHERE model = 'model' GROUP BY season_year"))
def _(t: Tables) -> DataFrame:
    got = metrics.margin_score(E.margin_samples(t.games()).filter("model = 'model'"), ["season_year"])
    return got.select(big("season_year"), *margin_outputs())


@query("e11_margin_walk_forward", with_ctes(f"SELECT model, {_MARGIN} FROM margin_long GROUP BY model"))
def _(t: Tables) -> DataFrame:
    return metrics.margin_score(E.margin_samples(t.games()), ["model"]).select("model", *margin_outputs())


cte("pairs", """
SELECT b.game_id, b.season_year, b.week, b.is_tie, b.home_won, b.p AS bp, b.abstain_reason AS br, c.raw_p AS cp, c.abstain_reason AS cr
FROM baseline AS b JOIN f7 AS c ON c.game_id = b.game_id""")
cte("pair_long", """
SELECT game_id, season_year, week, is_tie, home_won, 'baseline' AS model, bp AS p, br AS reason FROM pairs
UNION ALL SELECT game_id, season_year, week, is_tie, home_won, 'candidate', cp, cr FROM pairs""")
cte("pair_losses", losses("pair_long"))
cte("pair_hits", """
SELECT *, (bp >= 0.5) = (home_won = 1) AS bh, (cp >= 0.5) = (home_won = 1) AS ch, pow(bp - home_won, 2) - pow(cp - home_won, 2) AS diff
FROM pairs WHERE br IS NULL AND cr IS NULL AND NOT is_tie""")


def pairs(t: Tables) -> DataFrame:
    return E.paired_prior_samples(t.games())


@query("j10_paired_samples", with_ctes(f"SELECT game_id, {q6('bp')} AS baseline_p, {q6('cp')} AS candidate_p, bh AS baseline_hit, ch AS candidate_hit FROM pair_hits"))
def _(t: Tables) -> DataFrame:
    return E.paired_hits(pairs(t)).select("game_id", r6("baseline_p"), r6("candidate_p"), "baseline_hit", "candidate_hit")


@query("e13_prior_shrinkage_comparison", with_ctes(f"""
SELECT model, part, {METRICS} FROM (
  SELECT *, 'full season' AS part FROM pair_losses UNION ALL SELECT *, 'week 1' FROM pair_losses WHERE week = 1) AS u GROUP BY model, part"""))
def _(t: Tables) -> DataFrame:
    parts = F.explode(F.when(F.col("week") == 1, F.array(F.lit("full season"), F.lit("week 1"))).otherwise(F.array(F.lit("full season"))))
    long = E.paired_long(pairs(t).withColumn("part", parts), [*E.SAMPLE_KEYS, "part"])
    return metrics.score(long, ["model", "part"]).select("model", "part", *metric_outputs())


@query("e14_weekly_trajectory", with_ctes(f"SELECT model, week::BIGINT AS week, {METRICS} FROM pair_losses GROUP BY model, week"))
def _(t: Tables) -> DataFrame:
    return metrics.score(E.paired_long(pairs(t)), ["model", "week"]).select("model", big("week"), *metric_outputs())


_weeks = ", ".join(f"({w})" for w in K.CUMULATIVE_WEEKS)


@query("e14_cumulative_windows", with_ctes(f"""
SELECT model, n::BIGINT AS through_week, {METRICS} FROM pair_losses JOIN (VALUES {_weeks}) AS w(n) ON week <= n GROUP BY model, n"""))
def _(t: Tables) -> DataFrame:
    long = E.paired_long(E.early_windows(pairs(t)), [*E.SAMPLE_KEYS, "through_week"])
    return metrics.score(long, ["model", "through_week"]).select("model", big("through_week"), *metric_outputs())


@query("e15_paired_z", with_ctes(f"""
SELECT season_year::BIGINT AS season_year, n, {q6('md')} AS mean_difference, {q6('z')} AS z, {q6('1 - 2 * area')} AS p_value FROM (
  SELECT s.season_year, any_value(n) AS n, any_value(md) AS md, any_value(z) AS z,
         sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(abs(z) * i / 2000.0::DOUBLE, 2) / 2)
             / sqrt(2 * pi())) * any_value(abs(z)) / 2000.0::DOUBLE / 3 AS area
  FROM (SELECT season_year, count(*) AS n, avg(diff) AS md, avg(diff) / (stddev_samp(diff) / sqrt(count(*))) AS z
        FROM pair_hits GROUP BY season_year HAVING stddev_samp(diff) > 0) AS s, range(2001) AS g(i) GROUP BY s.season_year) AS r
UNION ALL
SELECT season_year::BIGINT, count(*), {q6('avg(diff)')}, NULL, NULL FROM pair_hits GROUP BY season_year
HAVING count(*) < 2 OR stddev_samp(diff) = 0"""))
def _(t: Tables) -> DataFrame:
    from gridcast.functions.expr import squared_error

    y = F.col("home_won").cast("double")
    diffs = E.paired_hits(pairs(t)).withColumn("d", squared_error(F.col("baseline_p"), y) - squared_error(F.col("candidate_p"), y))
    return significance.paired_z(diffs, ["season_year"], "d").select(
        big("season_year"), big("n"), r6("mean_difference"), r6("z"), r6("p_value"))


cte("hit_counts", """
SELECT week, count(*) AS n, count(*) FILTER (WHERE bh) AS b, count(*) FILTER (WHERE ch) AS c,
       count(*) FILTER (WHERE bh AND NOT ch) AS ob, count(*) FILTER (WHERE ch AND NOT bh) AS oc FROM pair_hits GROUP BY week""")


def _lc(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


def _hyper(x: str) -> str:
    return f"exp({_lc('r1', x)} + {_lc('r2', f'(c1 - {x})')} - {_lc('nn', 'c1')})"


cte("fisher", f"""
SELECT week, sum(CASE WHEN px <= seen * (1 + 1e-7::DOUBLE) THEN px END) AS p FROM (
  SELECT week, {_hyper('x')} AS px, {_hyper('a')} AS seen FROM (
    SELECT week, b::DOUBLE AS a, n::DOUBLE AS r1, n::DOUBLE AS r2, (b + c)::DOUBLE AS c1, (2 * n)::DOUBLE AS nn,
           unnest(range(greatest(0, b + c - n), least(n, b + c) + 1))::DOUBLE AS x FROM hit_counts) AS s) AS q GROUP BY week""")
cte("mcnemar", f"""
SELECT week, least(1.0, 2 * sum(exp({_lc('m', 'x')} - m * ln(2)))) AS p FROM (
  SELECT week, (ob + oc)::DOUBLE AS m, unnest(range(0, least(ob, oc) + 1))::DOUBLE AS x FROM hit_counts) AS s GROUP BY week""")


def exact_tests(rows: str, key: str) -> str:
    """SQL for the hit counts and both exact p-values of ``rows`` by ``key``, on the tables of each group."""
    return f"""
WITH k AS (
  SELECT {key}, count(*) AS n, count(*) FILTER (WHERE bh) AS b, count(*) FILTER (WHERE ch) AS c,
         count(*) FILTER (WHERE bh AND NOT ch) AS ob, count(*) FILTER (WHERE ch AND NOT bh) AS oc FROM ({rows}) AS u GROUP BY {key}
), f AS (
  SELECT {key}, sum(CASE WHEN px <= seen * (1 + 1e-7::DOUBLE) THEN px END) AS p FROM (
    SELECT {key}, {_hyper('x')} AS px, {_hyper('a')} AS seen FROM (
      SELECT {key}, b::DOUBLE AS a, n::DOUBLE AS r1, n::DOUBLE AS r2, (b + c)::DOUBLE AS c1, (2 * n)::DOUBLE AS nn,
             unnest(range(greatest(0, b + c - n), least(n, b + c) + 1))::DOUBLE AS x FROM k) AS s) AS q GROUP BY {key}
), m AS (
  SELECT {key}, least(1.0, 2 * sum(exp({_lc('m', 'x')} - m * ln(2)))) AS p FROM (
    SELECT {key}, (ob + oc)::DOUBLE AS m, unnest(range(0, least(ob, oc) + 1))::DOUBLE AS x FROM k) AS s GROUP BY {key}
)
SELECT k.{key}, n AS sample_count, b AS baseline_correct, c AS candidate_correct, {q6('f.p')} AS fisher_p, {q_off_tie('m.p')} AS mcnemar_p
FROM k JOIN f ON f.{key} = k.{key} JOIN m ON m.{key} = k.{key}"""


def tested_parts(rows: DataFrame, key: str) -> DataFrame:
    found = significance.paired_significance(rows, [key])
    return found.select(key, *[big(c) for c in ("sample_count", "baseline_correct", "candidate_correct")], r6("fisher_p"), off_tie("mcnemar_p"))


@query("e13_part_significance", with_ctes(exact_tests("SELECT *, 'full season' AS part FROM pair_hits UNION ALL SELECT *, 'week 1' FROM pair_hits WHERE week = 1", "part")))
def _(t: Tables) -> DataFrame:
    parts = F.when(F.col("week") == 1, F.array(F.lit("full season"), F.lit("week 1"))).otherwise(F.array(F.lit("full season")))
    return tested_parts(E.paired_hits(pairs(t)).withColumn("part", F.explode(parts)), "part")


@query("e14_window_significance", with_ctes(exact_tests(f"SELECT h.*, w::BIGINT AS through_week FROM pair_hits AS h JOIN (VALUES {_weeks}) AS v(w) ON week <= w", "through_week")))
def _(t: Tables) -> DataFrame:
    windows = E.early_windows(E.paired_hits(pairs(t))).withColumn("through_week", F.col("through_week").cast("bigint"))
    return tested_parts(windows, "through_week")


def week_counts(t: Tables) -> DataFrame:
    return significance.paired_counts(E.paired_hits(pairs(t)), ["week"])


@query("e16_fisher_exact", with_ctes(f"SELECT week::BIGINT AS week, {q6('p')} AS fisher_p FROM fisher"))
def _(t: Tables) -> DataFrame:
    c = week_counts(t)
    cells = c.select(
        "week", F.col("baseline_correct").alias("a"), (F.col("sample_count") - F.col("baseline_correct")).alias("b"),
        F.col("candidate_correct").alias("c"), (F.col("sample_count") - F.col("candidate_correct")).alias("d"))
    return significance.fisher_exact(cells, ["week"]).select(big("week"), r6("fisher_p"))


@query("e17_mcnemar_exact", with_ctes(f"SELECT week::BIGINT AS week, {q_off_tie('p')} AS mcnemar_p FROM mcnemar"))
def _(t: Tables) -> DataFrame:
    return significance.mcnemar_exact(week_counts(t), ["week"], "only_baseline", "only_candidate").select(big("week"), off_tie("mcnemar_p"))


@query("e18_paired_significance", with_ctes(f"""
SELECT h.week::BIGINT AS week, n AS sample_count, b AS baseline_correct, c AS candidate_correct, ob AS only_baseline, oc AS only_candidate,
       {q6('f.p')} AS fisher_p, {q_off_tie('m.p')} AS mcnemar_p
FROM hit_counts AS h JOIN fisher AS f ON f.week = h.week JOIN mcnemar AS m ON m.week = h.week"""))
def _(t: Tables) -> DataFrame:
    return significance.paired_significance(E.paired_hits(pairs(t)), ["week"]).select(
        big("week"), *[big(c) for c in ("sample_count", "baseline_correct", "candidate_correct", "only_baseline", "only_candidate")],
        r6("fisher_p"), off_tie("mcnemar_p"))


cte("holdout", f"""
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('{K.SEED}|' || game_id), game_id) AS k, count(*) OVER () AS n
               FROM model_losses WHERE ok) AS r WHERE k <= round_even(n * {K.HOLDOUT_FRACTION}, 0)""")


@query("e19_holdout_sample", with_ctes("SELECT game_id FROM holdout"))
def _(t: Tables) -> DataFrame:
    scored = samples(t).filter(metrics.is_scored())
    return resample.holdout(scored, "game_id", ["model"]).select("game_id")


@query("j6_scorecard_labels", with_ctes("""
SELECT g.game_id, coalesce(h.abbreviation, home_team_id::VARCHAR, '?') AS home_team, coalesce(a.abbreviation, away_team_id::VARCHAR, '?') AS away_team
FROM games AS g LEFT JOIN teams AS h ON h.team_id = home_team_id AND h.region <> 'ASIA' LEFT JOIN teams AS a ON a.team_id = away_team_id AND a.region <> 'ASIA'"""))
def _(t: Tables) -> DataFrame:
    return E.label_teams(t.games(), t.teams().filter("region <> 'ASIA'")).select("game_id", "home_team", "away_team")


@query("e20_scorecard", with_ctes(f"""
SELECT game_id, {qstamp('kickoff_at')} AS kickoff_at, h.abbreviation AS home_team, a.abbreviation AS away_team, p, home_won::BIGINT AS home_won, hit = 1 AS correct
FROM holdout JOIN teams AS h ON h.team_id = home_team_id JOIN teams AS a ON a.team_id = away_team_id"""))
def _(t: Tables) -> DataFrame:
    return E.holdout_scorecard(t.games(), t.teams()).select(
        "game_id", stamp("kickoff_at"), "home_team", "away_team", "p", big("home_won"), "correct")


@query("e20_holdout_metrics", with_ctes(f"""
SELECT 'holdout' AS part, {METRICS} FROM holdout UNION ALL SELECT 'full', {METRICS} FROM model_losses WHERE ok"""))
def _(t: Tables) -> DataFrame:
    return E.holdout_metrics(t.games()).select("part", *metric_outputs())
