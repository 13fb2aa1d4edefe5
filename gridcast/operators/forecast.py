"""Forecasts: one row per game, every game in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast import constants as K
from gridcast.functions import expr as X
from gridcast.operators.schedule import schedule_factor
from gridcast.operators.sides import attach_sides, side_probes
from gridcast.operators.strength import (
    TOTALS,
    calibrated_strength,
    regressed_strength,
    scoring_totals,
    team_strength,
    win_rate_strength,
)
from gridcast.operators.turnovers import turnover_form
from gridcast.sources.canonical import record_key

_RATED = [*TOTALS, "ppg_for", "ppg_against", "shrink_weight", "strength", "reason"]


def _first_reason() -> Column:
    """The home side is looked at first, as its failure hides the away side's."""
    return F.coalesce("home_reason", "away_reason")


def _home_win(home: Column, away: Column) -> Column:
    return X.with_home_field(X.log5(home, away), F.col("neutral_site"))


def rated_games(
    games: DataFrame, history: DataFrame, exponent: float = K.PYTHAGOREAN_EXPONENT, probes: DataFrame | None = None
) -> DataFrame:
    """``games`` (with a cutoff) plus both sides' totals and strength as of the cutoff."""
    totals = scoring_totals(side_probes(games) if probes is None else probes, history)
    return attach_sides(games, team_strength(totals, exponent), _RATED)


def baseline_columns(rated: DataFrame) -> DataFrame:
    """Published forecast columns from :func:`rated_games`; probabilities carry six decimals."""
    reason = _first_reason()
    p = _home_win(F.col("home_strength"), F.col("away_strength"))
    ok = reason.isNull()
    return rated.withColumns(
        {
            "abstain_reason": reason,
            "abstained": ~ok,
            "home_win_probability": F.when(ok, F.round(p, 6)),
            "uncertainty": F.when(ok, F.round(X.forecast_uncertainty(F.col("home_cur_n"), F.col("away_cur_n")), 6)),
            "training_window_start": F.coalesce(F.least("home_first_kickoff", "away_first_kickoff"), "cutoff"),
            "home_field_applied": ~F.coalesce("neutral_site", F.lit(False)),
        }
    )


def baseline_forecast(games: DataFrame, history: DataFrame, exponent: float = K.PYTHAGOREAN_EXPONENT) -> DataFrame:
    """Pythagorean / log5 / home-field forecast of every game at its own cutoff."""
    return baseline_columns(rated_games(games, history, exponent))


def forecast_record(forecasts: DataFrame, exponent: float = K.PYTHAGOREAN_EXPONENT) -> DataFrame:
    """The stored record of every forecast from :func:`baseline_forecast`, or from the injury-adjusted one.

    The id depends on game, model version and cutoff only, so a rerun gives the same record. Without an injury step the adjustment
    is 0 and the list of adjusted players empty; an abstained forecast keeps its reason and has no probability.
    """
    adjusted = "injury_delta" in forecasts.columns
    ok = ~F.col("abstained")
    delta = F.coalesce("injury_delta", F.lit(0.0)) if adjusted else F.lit(0.0)
    players = F.col("adjusted_players") if adjusted else F.array().cast("array<string>")
    made = F.date_format("cutoff", "yyyy-MM-dd HH:mm:ss")
    return forecasts.select(
        record_key("forecast", F.col("game_id"), F.lit(K.MODEL_VERSION), made).alias("id"),
        "game_id",
        F.lit(K.MODEL_VERSION).alias("model_version"),
        F.lit(K.UNCALIBRATED).alias("calibration_version"),
        F.col("cutoff").alias("feature_cutoff_at"),
        "training_window_start",
        F.col("adjusted_probability" if adjusted else "home_win_probability").alias("home_win_probability"),
        F.when(ok, F.lit(0.0)).alias("tie_probability"),
        "uncertainty",
        F.lit(float(exponent)).alias("exponent"),
        *[F.col(f"{side}_cur_n").alias(f"{side}_games_played") for side in ("home", "away")],
        *[F.when(ok, F.round(f"{side}_shrink_weight", 6)).alias(f"{side}_shrinkage_weight") for side in ("home", "away")],
        "home_field_applied",
        "abstained",
        "abstain_reason",
        F.when(ok, F.round(delta, 6)).alias("injury_adjustment"),
        F.when(ok, F.coalesce(players, F.array().cast(forecasts.schema["adjusted_players"].dataType if adjusted else "array<string>"))).alias("adjusted_players"),
    )


def _probability(df: DataFrame, name: str, p: Column, reason: Column) -> DataFrame:
    return df.withColumn(f"{name}_reason", reason).withColumn(
        f"{name}_probability", F.when(F.col(f"{name}_reason").isNull(), p)
    )


def add_home_field_only(df: DataFrame) -> DataFrame:
    return _probability(df, "home_field_only", X.home_field_only(F.col("neutral_site")), F.lit(None).cast("string"))


def add_prior_win_rate(rated: DataFrame) -> DataFrame:
    """Win percentages only, blended like strength, then log5 and home field."""
    def pct(side: str) -> Column:
        c = lambda n: F.col(f"{side}_{n}")
        return X.blended_rate(c("cur_wins"), c("cur_n"), c("prior_wins"), c("prior_n"))

    home, away = F.col("_home"), F.col("_away")
    df = rated.withColumn("_home", pct("home")).withColumn("_away", pct("away"))
    reason = F.when(home.isNull() | away.isNull(), F.lit(K.NO_HISTORY))
    floor = F.lit(K.PROBABILITY_FLOOR)
    p = _home_win(F.greatest(home, floor), F.greatest(away, floor))
    return _probability(df, "prior_win_pct", p, reason).drop("_home", "_away")


def add_raw_pythagorean(rated: DataFrame, exponent: float = K.PYTHAGOREAN_EXPONENT) -> DataFrame:
    """Current season only, no shrinkage; abstains while either side has no game."""
    def s(side: str) -> Column:
        n = F.col(f"{side}_cur_n")
        return X.pythagorean(X.rate(F.col(f"{side}_cur_pf"), n), X.rate(F.col(f"{side}_cur_pa"), n), exponent)

    home, away = F.col("_home"), F.col("_away")
    df = rated.withColumn("_home", s("home")).withColumn("_away", s("away"))
    reason = F.when((F.col("home_cur_n") == 0) | (F.col("away_cur_n") == 0), F.lit(K.NO_HISTORY)).when(
        home.isNull() | away.isNull(), F.lit(K.BAD_SCORING)
    )
    return _probability(df, "raw_pythagorean", _home_win(home, away), reason).drop("_home", "_away")


def add_turnover_normalized(
    rated: DataFrame,
    probes: DataFrame,
    history: DataFrame,
    statlines: DataFrame,
    exponent: float = K.PYTHAGOREAN_EXPONENT,
    points: float = K.POINTS_PER_TURNOVER_MARGIN,
) -> DataFrame:
    """Take half the points worth of turnover margin off scoring and put half on conceding."""
    form = turnover_form(probes, history, statlines)
    df = attach_sides(rated, form, ["turnover_form"])
    floor = F.lit(K.RATE_FLOOR)

    def s(side: str) -> Column:
        shift = F.lit(points) * F.coalesce(f"{side}_turnover_form", F.lit(0.0)) / 2
        pf = F.coalesce(f"{side}_ppg_for", F.lit(0.0)) - shift
        pa = F.coalesce(f"{side}_ppg_against", F.lit(0.0)) + shift
        return X.pythagorean(F.greatest(pf, floor), F.greatest(pa, floor), exponent)

    df = df.withColumn("_home", s("home")).withColumn("_away", s("away"))
    return _probability(df, "turnover_normalized", _home_win(F.col("_home"), F.col("_away")), _first_reason()).drop("_home", "_away")


def add_schedule_adjusted(
    rated: DataFrame, probes: DataFrame, history: DataFrame, exponent: float = K.PYTHAGOREAN_EXPONENT
) -> DataFrame:
    """Scale scoring up and conceding down by the schedule factor, and the reverse for an easy one.

    A missing history is reported before unusable scoring, whichever side has it.
    """
    df = attach_sides(rated, schedule_factor(probes, history, exponent), ["schedule_factor"])
    floor = F.lit(K.RATE_FLOOR)

    def s(side: str) -> Column:
        factor = F.coalesce(f"{side}_schedule_factor", F.lit(1.0))
        pf = F.coalesce(f"{side}_ppg_for", F.lit(0.0)) * factor
        pa = F.coalesce(f"{side}_ppg_against", F.lit(0.0)) / factor
        return X.pythagorean(F.greatest(pf, floor), F.greatest(pa, floor), exponent)

    missing = (F.col("home_reason") == K.NO_HISTORY) | (F.col("away_reason") == K.NO_HISTORY)
    reason = F.when(F.coalesce(missing, F.lit(False)), F.lit(K.NO_HISTORY)).otherwise(_first_reason())
    df = df.withColumn("_home", s("home")).withColumn("_away", s("away"))
    return _probability(df, "sos_adjusted", _home_win(F.col("_home"), F.col("_away")), reason).drop("_home", "_away")


def _strength_forecast(games: DataFrame, strengths: DataFrame) -> DataFrame:
    df = attach_sides(games, strengths, ["cur_n", "shrink_weight", "first_kickoff", "strength", "reason"])
    reason = _first_reason()
    p = _home_win(F.col("home_strength"), F.col("away_strength"))
    return df.withColumn("abstain_reason", reason).withColumn("raw_probability", F.when(reason.isNull(), p))


def prior_regressed_forecast(
    games: DataFrame,
    history: DataFrame,
    exponent: float = K.PYTHAGOREAN_EXPONENT,
    carry_for: float = K.PRIOR_CARRYOVER_FOR,
    carry_against: float = K.PRIOR_CARRYOVER_AGAINST,
) -> DataFrame:
    """Forecast from strengths whose prior season is pulled toward the league mean."""
    totals = scoring_totals(side_probes(games), history)
    return _strength_forecast(games, regressed_strength(totals, history, carry_for, carry_against, exponent))


def calibrated_forecast(
    games: DataFrame,
    history: DataFrame,
    platt: tuple[float, float] | None = None,
    exponent: float = K.PYTHAGOREAN_EXPONENT,
) -> DataFrame:
    """League-regressed strengths, then Platt scaling when coefficients are given."""
    totals = scoring_totals(side_probes(games), history)
    df = _strength_forecast(games, calibrated_strength(totals, history, exponent))
    p = F.col("raw_probability") if platt is None else X.platt(F.col("raw_probability"), *platt)
    ok = F.col("abstain_reason").isNull()
    return df.withColumns(
        {
            "home_win_probability": F.when(ok, F.round(p, 6)),
            "uncertainty": F.when(ok, F.round(X.forecast_uncertainty(F.col("home_cur_n"), F.col("away_cur_n")), 6)),
            "calibration_version": F.lit(K.UNCALIBRATED if platt is None else K.PLATT),
        }
    )


def add_expected_margin(rated: DataFrame, home_points: float = K.HOME_FIELD_MARGIN_POINTS) -> DataFrame:
    """Difference of the blended scoring margins plus the home term off neutral ground."""
    zero = F.lit(0.0)

    def margin(side: str) -> Column:
        return F.coalesce(f"{side}_ppg_for", zero) - F.coalesce(f"{side}_ppg_against", zero)

    home_term = F.when(F.coalesce("neutral_site", F.lit(False)), zero).otherwise(F.lit(home_points))
    reason = _first_reason()
    ok = reason.isNull()
    return rated.withColumns(
        {
            "abstain_reason": reason,
            "home_blended_margin": F.when(ok, margin("home")),
            "away_blended_margin": F.when(ok, margin("away")),
            "expected_margin": F.when(ok, (margin("home") - margin("away")) + home_term),
            "home_only_margin": home_term,
            "zero_margin": zero,
        }
    )


def win_rates(games: DataFrame, history: DataFrame) -> DataFrame:
    """Blended win percentage of every (team, season, cutoff) that ``games`` asks for."""
    return win_rate_strength(scoring_totals(side_probes(games), history))
