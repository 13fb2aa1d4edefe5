"""Walk-forward evaluations: every test game forecast at its own cutoff, all in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast import constants as K
from gridcast.functions import expr as X
from gridcast.operators import forecast as FC
from gridcast.operators import metrics, resample
from gridcast.operators.sides import select_test_games, side_probes, with_cutoff, with_result
from gridcast.session import stage

MODELS = ("model", "home_field_only", "prior_win_pct", "raw_pythagorean", "turnover_normalized", "sos_adjusted")


def test_set(games: DataFrame, seasons: Sequence[int] | None = None) -> DataFrame:
    return with_result(with_cutoff(select_test_games(games, seasons)))


def _long(df: DataFrame, parts: dict[str, tuple[Column, Column]], keep: Sequence[str]) -> DataFrame:
    """Wide forecasts to one sample row per model, in the same pass."""
    rows = [
        F.struct(F.lit(name).alias("model"), p.cast("double").alias("p"), reason.cast("string").alias("reason"))
        for name, (p, reason) in parts.items()
    ]
    return df.withColumn("_s", F.explode(F.array(*rows))).select(*keep, "_s.*")


SAMPLE_KEYS = ["game_id", "season_year", "week", "is_tie", "home_won"]


def baseline_samples(games: DataFrame, seasons: Sequence[int] | None = None, exponent: float = K.PYTHAGOREAN_EXPONENT) -> DataFrame:
    """Samples of the baseline model only."""
    df = FC.baseline_forecast(test_set(games, seasons), games, exponent)
    return df.select(
        *SAMPLE_KEYS, "kickoff_at", "home_team_id", "away_team_id",
        F.lit("model").alias("model"), F.col("home_win_probability").alias("p"), F.col("abstain_reason").alias("reason"),
    )


def walk_forward_samples(
    games: DataFrame, statlines: DataFrame, seasons: Sequence[int] | None = None, exponent: float = K.PYTHAGOREAN_EXPONENT
) -> DataFrame:
    """Samples of the model and its five baselines in long form."""
    tests = test_set(games, seasons)
    probes = stage(side_probes(tests))
    df = FC.baseline_columns(FC.rated_games(tests, games, exponent, probes))
    df = FC.add_home_field_only(df)
    df = FC.add_prior_win_rate(df)
    df = FC.add_raw_pythagorean(df, exponent)
    df = FC.add_turnover_normalized(df, probes, games, statlines, exponent)
    df = FC.add_schedule_adjusted(df, probes, games, exponent)
    parts = {"model": (F.col("home_win_probability"), F.col("abstain_reason"))}
    parts |= {m: (F.col(f"{m}_probability"), F.col(f"{m}_reason")) for m in MODELS[1:]}
    return _long(df, parts, SAMPLE_KEYS)


REPORT_SETS = (["model"], ["model", "season_year"], ["model", "week"])


def walk_forward_report(samples: DataFrame) -> DataFrame:
    """The metric set, with intervals and reliability bins, per model overall, by season and by week, from one scan of the samples."""
    return metrics.metric_sets(samples, REPORT_SETS)


def margin_samples(games: DataFrame, seasons: Sequence[int] | None = None, home_points: float = K.HOME_FIELD_MARGIN_POINTS) -> DataFrame:
    """Expected margin and the two constant margins against the actual one."""
    df = FC.add_expected_margin(FC.rated_games(test_set(games, seasons), games), home_points)
    actual = (F.col("home_score") - F.col("away_score")).cast("double")
    rows = [
        F.struct(F.lit(name).alias("model"), F.col(column).alias("predicted"))
        for name, column in (("model", "expected_margin"), ("home_field_only", "home_only_margin"), ("always_zero", "zero_margin"))
    ]
    return df.withColumn("actual", actual).withColumn("_s", F.explode(F.array(*rows))).select(
        "game_id", "season_year", "week", "actual", "_s.*"
    )


def paired_prior_samples(games: DataFrame, seasons: Sequence[int] | None = None) -> DataFrame:
    """Baseline and prior-regressed probability of the same games, side by side."""
    tests = test_set(games, seasons)
    base = FC.baseline_forecast(tests, games).select(
        *SAMPLE_KEYS, F.col("home_win_probability").alias("baseline_p"), F.col("abstain_reason").alias("baseline_reason")
    )
    other = FC.prior_regressed_forecast(tests, games).select(
        "game_id", F.col("raw_probability").alias("candidate_p"), F.col("abstain_reason").alias("candidate_reason")
    )
    return base.join(other, "game_id")


def paired_long(pairs: DataFrame, keep: Sequence[str] = SAMPLE_KEYS) -> DataFrame:
    parts = {name: (F.col(f"{name}_p"), F.col(f"{name}_reason")) for name in ("baseline", "candidate")}
    return _long(pairs, parts, keep)


def paired_hits(pairs: DataFrame) -> DataFrame:
    """Pairs on which both predictors count, with their hit flags."""
    usable = F.col("baseline_reason").isNull() & F.col("candidate_reason").isNull() & ~F.col("is_tie")
    home = F.col("home_won") == 1
    return (
        pairs.filter(usable)
        .withColumn("baseline_hit", (F.col("baseline_p") >= 0.5) == home)
        .withColumn("candidate_hit", (F.col("candidate_p") >= 0.5) == home)
    )


def early_windows(pairs: DataFrame, weeks: Sequence[int] = K.CUMULATIVE_WEEKS) -> DataFrame:
    """Each sample once per cumulative window ``week <= N`` it belongs to (a few copies)."""
    windows = F.filter(F.array(*[F.lit(w) for w in weeks]), lambda w: F.col("week") <= w)
    return pairs.withColumn("through_week", F.explode(windows))


def holdout_scorecard(
    games: DataFrame, teams: DataFrame, seasons: Sequence[int] | None = None,
    fraction: float = K.HOLDOUT_FRACTION, seed: int = K.SEED,
) -> DataFrame:
    """Predicted against actual for a reproducible subset of the scored games, with team labels."""
    scored = baseline_samples(games, seasons).filter(metrics.is_scored()).withColumn("_all", F.lit(1))
    chosen = resample.holdout(scored, "game_id", ["_all"], fraction, seed).drop("_all")
    return label_teams(chosen, teams).withColumn("correct", metrics.is_correct())


def label_teams(rows: DataFrame, teams: DataFrame) -> DataFrame:
    """Team abbreviation of both sides; the id where the team is not known, ``?`` without an id."""
    for side in ("home", "away"):
        names = teams.select(F.col("team_id").alias(f"{side}_team_id"), F.col("abbreviation").alias(f"{side}_team"))
        rows = rows.join(names, f"{side}_team_id", "left").withColumn(
            f"{side}_team", F.coalesce(f"{side}_team", F.col(f"{side}_team_id").cast("string"), F.lit("?"))
        )
    return rows


def holdout_metrics(
    games: DataFrame, seasons: Sequence[int] | None = None, fraction: float = K.HOLDOUT_FRACTION, seed: int = K.SEED
) -> DataFrame:
    """The same metrics on the holdout and on all scored games."""
    scored = stage(baseline_samples(games, seasons).filter(metrics.is_scored()).withColumn("_all", F.lit(1)))
    chosen = resample.holdout(scored, "game_id", ["_all"], fraction, seed).withColumn("part", F.lit("holdout"))
    return metrics.score(scored.withColumn("part", F.lit("full")).unionByName(chosen), ["part"])


def exponent_scores(
    games: DataFrame, exponents: Sequence[float], seasons: Sequence[int] | None = None
) -> DataFrame:
    """Brier score of every candidate exponent.

    The as-of features do not depend on the exponent, so they are built once and
    each game is scored under the short candidate list.
    """
    rated = FC.rated_games(test_set(games, seasons), games)
    x = F.col("exponent")
    tried = rated.withColumn("exponent", F.explode(F.array(*[F.lit(float(e)) for e in exponents])))
    tried = tried.withColumn("home_strength", X.pythagorean(F.col("home_ppg_for"), F.col("home_ppg_against"), x)).withColumn(
        "away_strength", X.pythagorean(F.col("away_ppg_for"), F.col("away_ppg_against"), x)
    )
    df = FC.baseline_columns(tried).withColumn("p", F.col("home_win_probability")).withColumn("reason", F.col("abstain_reason"))
    return metrics.score(df, ["exponent"])
