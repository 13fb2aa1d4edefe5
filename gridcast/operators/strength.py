"""Team strength as of a cutoff, and the league averages it leans on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast import constants as K
from gridcast.functions import expr as X
from gridcast.operators.asof import Measures, asof_aggregate, timeline
from gridcast.operators.sides import scoring_facts, team_games

TOTALS = [
    "cur_n", "cur_pf", "cur_pa", "cur_wins", "prior_n", "prior_pf", "prior_pa", "prior_wins", "first_kickoff",
]


def _season_roles(facts: DataFrame) -> DataFrame:
    """Each side row once as a game of its own season and once as a prior game of the next.

    One running total keyed by (team, season) then serves the current and the
    prior season together, with the cutoff applied to both.
    """
    return facts.withColumn("_role", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "season_year", F.col("season_year") + F.col("_role")
    )


def _role_measures() -> Measures:
    won = (F.col("points_for") > F.col("points_against")).cast("bigint")
    measures: Measures = {}
    for role, name in ((0, "cur"), (1, "prior")):
        mine = (F.col("_role") == role).cast("bigint")
        measures |= {
            f"{name}_n": ("sum", mine),
            f"{name}_pf": ("sum", mine * F.col("points_for")),
            f"{name}_pa": ("sum", mine * F.col("points_against")),
            f"{name}_wins": ("sum", mine * won),
        }
    measures["first_kickoff"] = ("min", F.col("kickoff_at"))
    return measures


def scoring_totals(probes: DataFrame, games: DataFrame) -> DataFrame:
    """Games, points for and against, wins and first game used, current and prior season, per probe.

    ``probes`` holds (team_id, season_year, cutoff). Only completed regular-season
    games kicking off strictly before the cutoff count, also in the prior season.
    """
    return asof_aggregate(
        probes,
        _season_roles(scoring_facts(games)),
        ["team_id", "season_year"],
        "kickoff_at",
        _role_measures(),
        probe_ts="cutoff",
    )


def _ppg(prefix: str = "") -> dict[str, Column]:
    c = lambda name: F.col(prefix + name)
    return {
        "cur_for": X.rate(c("cur_pf"), c("cur_n")),
        "cur_against": X.rate(c("cur_pa"), c("cur_n")),
        "prior_for": X.rate(c("prior_pf"), c("prior_n")),
        "prior_against": X.rate(c("prior_pa"), c("prior_n")),
    }


def _finish(rates: DataFrame, exponent: float | Column, k: float) -> DataFrame:
    """Blend the four per-game rates and turn them into a strength with an abstain reason."""
    n = F.col("cur_n")
    blended = (
        rates.withColumn("ppg_for", X.shrink(F.col("cur_for"), n, F.col("prior_for"), k))
        .withColumn("ppg_against", X.shrink(F.col("cur_against"), n, F.col("prior_against"), k))
        .withColumn("shrink_weight", X.shrink_weight(F.col("cur_for"), n, F.col("prior_for"), k))
    )
    return (
        blended.withColumn("strength", X.pythagorean(F.col("ppg_for"), F.col("ppg_against"), exponent))
        .withColumn(
            "reason",
            F.when((n == 0) & (F.col("prior_n") == 0), F.lit(K.NO_HISTORY)).when(
                F.col("strength").isNull(), F.lit(K.BAD_SCORING)
            ),
        )
        .drop("cur_for", "cur_against", "prior_for", "prior_against")
    )


def _with_rates(totals: DataFrame) -> DataFrame:
    return totals.withColumns(_ppg())


def team_strength(totals: DataFrame, exponent: float | Column = K.PYTHAGOREAN_EXPONENT, k: float = K.TEAM_PSEUDOGAMES) -> DataFrame:
    """Shrunk strength from the output of :func:`scoring_totals`.

    ``strength`` is null with ``reason`` set where there is no history or where a
    blended scoring rate is not strictly positive.
    """
    return _finish(_with_rates(totals), exponent, k)


def league_average_points(games: DataFrame) -> DataFrame:
    """Average points per team-game of each season, over all its completed regular games."""
    done = games.filter((F.col("season_type") == "regular") & F.col("completed"))
    points = F.coalesce("home_score", F.lit(0)) + F.coalesce("away_score", F.lit(0))
    return done.groupBy("season_year").agg(
        (F.sum(points).cast("double") / (F.count(F.lit(1)) * 2)).alias("league_points")
    )


def team_season_points(games: DataFrame) -> DataFrame:
    """Points per game for and against of every (season, team)."""
    return (
        scoring_facts(games)
        .groupBy("season_year", "team_id")
        .agg(
            F.count(F.lit(1)).alias("games"),
            F.sum("points_for").alias("points_for"),
            F.sum("points_against").alias("points_against"),
            F.sum((F.col("points_for") > F.col("points_against")).cast("bigint")).alias("wins"),
        )
        .withColumn("ppg_for", F.col("points_for") / F.col("games"))
        .withColumn("ppg_against", F.col("points_against") / F.col("games"))
    )


def league_average_ppg(games: DataFrame) -> DataFrame:
    """Mean over teams of their points per game, for and against (each team weighs the same)."""
    return team_season_points(games).groupBy("season_year").agg(
        F.avg("ppg_for").alias("league_for"), F.avg("ppg_against").alias("league_against")
    )


def _of_prior_season(averages: DataFrame) -> DataFrame:
    return averages.withColumn("season_year", F.col("season_year") + 1)


def calibrated_strength(totals: DataFrame, games: DataFrame, exponent: float | Column = K.PYTHAGOREAN_EXPONENT) -> DataFrame:
    """Strength whose prior-season rate is first shrunk toward that season's league average."""
    rates = _with_rates(totals).join(_of_prior_season(league_average_points(games)), "season_year", "left")
    league, n = F.col("league_points"), F.col("prior_n")
    for side in ("for", "against"):
        prior = F.col(f"prior_{side}")
        rates = rates.withColumn(
            f"prior_{side}", F.when(prior.isNotNull(), X.shrink(prior, n, league, K.LEAGUE_PSEUDOGAMES))
        )
    return _finish(rates.drop("league_points"), exponent, K.TEAM_PSEUDOGAMES)


def regressed_strength(
    totals: DataFrame,
    games: DataFrame,
    carry_for: float = K.PRIOR_CARRYOVER_FOR,
    carry_against: float = K.PRIOR_CARRYOVER_AGAINST,
    exponent: float | Column = K.PYTHAGOREAN_EXPONENT,
) -> DataFrame:
    """Strength whose prior-season rate keeps only a share of its distance from the league mean."""
    rates = _with_rates(totals).join(_of_prior_season(league_average_ppg(games)), "season_year", "left")
    for side, share in (("for", carry_for), ("against", carry_against)):
        league, prior = F.col(f"league_{side}"), F.col(f"prior_{side}")
        rates = rates.withColumn(
            f"prior_{side}", F.when(prior.isNotNull(), league + F.lit(share) * (prior - league))
        )
    return _finish(rates.drop("league_for", "league_against"), exponent, K.TEAM_PSEUDOGAMES)


def win_rate_strength(totals: DataFrame) -> DataFrame:
    """Blended win percentage (a tie is not a win); null without any game."""
    return totals.withColumn(
        "win_rate",
        X.blended_rate(F.col("cur_wins"), F.col("cur_n"), F.col("prior_wins"), F.col("prior_n")),
    )


def strength_timeline(games: DataFrame, exponent: float = K.PYTHAGOREAN_EXPONENT) -> DataFrame:
    """Every team's strength at every cutoff, as a step function.

    One row per (team, season, change): ``strength`` holds for cutoffs in
    ``(changed_at, valid_to]``; ``strength_before`` held just before. A grid of all
    teams at all cutoffs is the same information at (teams x cutoffs) rows; this
    is linear in the games. Teams are those with a regular game in the season.
    """
    in_season = (
        team_games(games.filter(F.col("season_type") == "regular")).select("team_id", "season_year").distinct()
    )
    steps = timeline(_season_roles(scoring_facts(games)), ["team_id", "season_year"], "kickoff_at", _role_measures())
    steps = steps.join(in_season, ["team_id", "season_year"], "left_semi")

    def strength_of(prefix: str) -> Column:
        r = _ppg(prefix)
        n = F.col(prefix + "cur_n")
        return X.pythagorean(
            X.shrink(r["cur_for"], n, r["prior_for"]), X.shrink(r["cur_against"], n, r["prior_against"]), exponent
        )

    return steps.select(
        "team_id",
        "season_year",
        F.col("kickoff_at").alias("changed_at"),
        "valid_to",
        "cur_n",
        "prior_n",
        strength_of("").alias("strength"),
        strength_of("before_").alias("strength_before"),
    )
